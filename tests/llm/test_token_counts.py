"""Counts by the transducer against the library's own."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioscan.llm import token_counts, transducer
from folioscan.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def made():
    return transducer.Transducer(PATH)


def some_texts(pieces, n, seed):
    """Entries joined at random, runs of one string, words without spaces, characters of all kinds, control and special strings."""
    rng = random.Random(seed)
    kinds = [
        lambda: "".join(rng.choices(pieces, k=rng.randint(1, 40))).replace("▁", " "),
        lambda: "".join(rng.choices(pieces, k=rng.randint(1, 300))),
        lambda: "".join(rng.choices(" ▁\n\taA1é日本　", k=rng.randint(0, 600))),
        lambda: "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1FAFF)])) for _ in range(rng.randint(0, 500))),
        lambda: "".join(rng.choices("etaoinsr", k=rng.randint(0, 900))),
        lambda: rng.choice(["a", "ab", "=", "-", "ha", "  ", " a", "<s>", "</s> <unk>", "<0x41>", "\0"]) * rng.randint(1, 700),
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def same(made, library, texts):
    want = [len(ids) for ids in library.encode(texts, num_threads=1)]
    assert [(t[:80], n) for t, n in zip(texts, made.counts(texts), strict=True)] == [(t[:80], n) for t, n in zip(texts, want, strict=True)]


def test_any_text(made, library):
    same(made, library, ["", " ", "  ", "a", " a", "a ", "\n", *some_texts(list(made.score), 1500, 3)])


def test_chunks_and_portions(made, library, monkeypatch):
    """Chunks that start within words, texts longer than a portion, states started anew between portions."""
    texts = some_texts(list(made.score), 250, 4)
    monkeypatch.setattr(transducer, "CHUNK", 5)
    monkeypatch.setattr(transducer, "WARM_UP", 0)  # so that nearly all guesses are wrong, and are read again
    same(made, library, texts)
    monkeypatch.setattr(transducer, "PORTION", 50)
    monkeypatch.setattr(made, "most_states", 100)
    same(made, library, texts)


def test_transitions_add_up(made):
    """Each transition's annotation is the difference of the counts before and after it."""
    state, total = made.start, 0
    text = "▁unbelievable▁▁▁▁antidisestablishmentarianism..............end"
    for k, ch in enumerate(text, 1):
        state, more = made._transition(state, ch)
        total += more
        assert total == made.counts([text[1:k].replace("▁", " ")])[0] or k == 1


def test_scan():
    import numpy as np

    head = np.array([True, False, False, True, True, *[False] * 6])
    assert transducer.scanned(head, np.arange(11)).tolist() == [0, 1, 3, 3, 4, 9, 15, 22, 30, 39, 49]


def test_other_kinds_are_refused(tmp_path):
    (tmp_path / "x.model").write_bytes(b"")
    with pytest.raises(Exception):  # noqa: B017
        transducer.Transducer(str(tmp_path / "x.model"))


def test_documents(spark, library):
    long = " ".join(random.Random(1).choices(["alpha", "beta,", "γάμμα", "d" * 50], k=200_000))
    rows = [(1, "Some text."), (2, None), (3, ""), (None, "no id"), (1, "Some text."), (4, long), (5, "x" * 900_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_bytes", "n_tokens", "over_limit", "counts"):
        docs = docs.withColumn(name, F.lit("x"))
    got = token_counts.count_tokens(docs.repartition(3), PATH).collect()
    key = lambda r: (r[0] or -1, r[1])
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_query(spark, sf_dir, library):
    from folioscan.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op12_token_counts"](spark, sf_dir).collect()}
    assert got == {k: len(library.encode(t or "")) for k, t in texts.items()}

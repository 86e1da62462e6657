"""run() against a plain version over one small corpus."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscan.llm import pii, quality
from folioscan.llm.near_dedup import SIMILAR, WIDTH
from folioscan.llm.queries import tokenizer_path

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmn", k=rng.randint(2, 8))) for _ in range(3000)]
    item = rng.choices(words, k=25)
    docs = []
    for k in range(150):
        w = rng.choices(words, k=rng.randint(55, 300))
        if k % 10 == 3:
            w = [f"{x}%%%" for x in w]
        if k % 10 == 4:
            w[5:5] = item
        if k % 10 == 5:
            w[7] = f"name{k}@mail.example.com"
        docs.append((k, " ".join(w)))
    for k in range(30):  # near copies of near copies
        t = docs[k * 2 % 40][1].split(" ")
        t[rng.randrange(len(t))] = "other"
        docs.append((200 + k, " ".join(t)))
    docs += [(300, None), (301, ""), (302, "too short"), (None, " ".join(rng.choices(words, k=90))), (6, docs[6][1]), (6, docs[6][1]), (6, docs[8][1] + " one more"), (7, " ".join(rng.choices(words, k=120)))]
    folder = str(tmp_path_factory.mktemp("sf"))
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "rule", "n_words", "_id", "rep", "item", "own_terms", "length"):
        made = made.withColumn(name, F.lit("x"))
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 != 3), 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, item


def plainly(docs, item):
    """(doc_id, text) after all stages but packing."""
    docs = [(i, t) for i, t in docs if len((t or "").split()) >= 50 and "%%%" not in t]
    docs, often = list(dict.fromkeys(docs)), Counter(i for i, _ in docs)
    ids = [None if i is None else i if often[i] == 1 else 10_000 + k for k, (i, _) in enumerate(docs)]
    sets = {}
    for k, (_, t) in zip(ids, docs, strict=True):
        w = t.lower().split()
        sets[k] = {tuple(w[j : j + WIDTH]) for j in range(len(w) - WIDTH + 1)}
    label = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                inter = len(sets[a] & sets[b])
                if label[a] < label[b] and 100 * inter >= SIMILAR * (len(sets[a]) + len(sets[b]) - inter):
                    label[b], changed = label[a], True
    docs = [x for k, x in zip(ids, docs, strict=True) if k is None or label[k] == k]
    grams = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    kept = []
    for i, t in docs:
        w = WORD.findall(t.lower())
        if not any(tuple(w[k : k + 10]) in grams for k in range(len(w))):
            kept.append((i, pii.sanitised(t, pii.base_spans(t))))
    return kept


def test_run(spark, made):
    folder, docs, item = made
    kept = plainly(docs, item)
    assert any("[EMAIL]" in t for _, t in kept) and 60 < len(kept) < 130
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for i, t in kept:
        x = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert len(x) <= 2048
        expected[i, 0, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == expected
    assert sum(i == 7 for i, *_ in expected) == 2 and sum(i in (6, 8) for i, *_ in expected) == 1


def test_stages_one_by_one(spark, made):
    folder, docs, _ = made
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == corpus_pipeline.COLUMNS
        assert stage(spark, frame.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame.limit(0), folder).count() == 0
    rules = quality.learn(quality.with_counts(frame), quality.sampled(spark.read.parquet(f"{folder}/labels.parquet")))
    assert rules and all(t.statistic in quality.STATISTICS for r in rules for t in r)
    assert frame.filter(F.col("doc_id") == 6).count() == 4 and len(docs) == frame.count()


def test_ids_at_the_ends_of_the_range(spark, made):
    """Ids that take all of the long's range, some of them shared: nothing overflows, the smallest id stays, shared ones come last. More columns are dropped."""
    folder, _, _ = made
    low, high = -(1 << 63), (1 << 63) - 1
    text = " ".join(f"word{k}" for k in range(90))
    other = " ".join(f"other{k}" for k in range(90))
    rows = [(high, text), (low, text + " end"), (5, text + " more"), (5, other), (5, other), (high - 1, other + " end"), (None, text), (7, "alone " * 3)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_id", F.lit("x")).withColumn("_shared", F.lit("y"))
    got = corpus_pipeline.near_duplicates(spark, frame, folder)
    assert got.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(low, text + " end"), (high - 1, other + " end"), (None, text), (7, "alone " * 3)])

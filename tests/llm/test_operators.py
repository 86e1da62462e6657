"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import common, decontaminate, language, licences, lm, near_dedup, packing, pii, quality, token_files, toxicity
from folioscan.llm.components import components
from folioscan.llm.queries import tokenizer_path
from folioscan.llm.wavelet import WaveletMatrix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(150)]
    base = [" ".join(rng.choices(words, k=rng.randint(8, 200))) for _ in range(n)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(12):  # near copies, some a word away
        t = base[k % 4].split(" ")
        t[rng.randrange(len(t))] = "changed"
        rows.append((100 + k, " ".join(t)))
    rows += [(200, base[0]), (201, base[0].upper()), (202, base[0] + "  "), (203, None), (204, ""), (205, " \n\t"), (206, "one"), (207, "One"), (208, "one two"), (None, "a null id"), (209, " ".join(rng.choices(words, k=30000))), (3, base[3]), (3, base[3])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    # Names that the operators use inside.
    for name in ("n_words", "rep", "label", "part", "held_out", "score", "kept", "row", "th", "words", "_n", "block"):
        made = made.withColumn(name, F.lit("x"))
    return made.repartition(5)


def multiset(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("width", "most"), [(2, 500_000), (5, 0)])
def test_near_duplicates(docs, rows, width, most, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", most)
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            inter = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    expected = Counter((i, len(sets[i]), root(i) if i is not None else None, i is None or root(i) == i) for i, _ in rows)
    assert multiset(near_dedup.near_duplicates(docs, width), ["doc_id", "n_shingles", "component_id", "kept"]) == expected
    assert near_dedup.near_duplicates(docs.limit(0), width).count() == 0


def test_near_duplicates_beyond_pivots(spark, monkeypatch):
    """A family whose members mostly don't link to its pivot, in many small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", (100, 300, 5))
    monkeypatch.setattr(near_dedup, "BLOCK_SIGNATURES", (3, 7, 1))
    monkeypatch.setattr(near_dedup, "BLOCK_STAR", (100, 300, 5))
    rng = random.Random(8)
    base, made = [str(rng.random()) for _ in range(60)], []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(60)] = f"w{rng.randrange(30)}"
        made.append((k, " ".join(t)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    sets = {i: frozenset(t.split(" ")) for i, t in made}
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(60):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, 1).collect()}
    assert got == {i: root(i) for i in range(60)} and 1 < len(set(got.values())) < 40


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 70), (9, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 50, 50: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_lm(docs, rows):
    got = lm.score(docs, block_tokens=500).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    learnt = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(learnt.values()), len(learnt)
    expected = defaultdict(list)
    for i, t in rows:
        w = tokens(t)
        expected[i].append((len(w), sum(learnt[x] > 0 for x in w), sum(math.log10((learnt[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    assert len(got) == len(rows)
    for r in got:
        assert any(r.n_tokens == a and r.n_known == b and abs(r.base_score - c) < 1e-6 for a, b, c in expected[r.doc_id])
        assert r.train_tokens == n and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and r.score < 0
    learnt_rows = [r for r in got if not r.held_out]
    assert sum(r.score for r in learnt_rows) > sum(r.base_score for r in learnt_rows)
    assert lm.score(docs.limit(0)).count() == 0
    only = docs.filter(F.col("doc_id") == next(i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 1))
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in lm.score(only).collect())


@pytest.mark.parametrize("most", [200_000, 0])
def test_sanitising_keeps_columns(spark, monkeypatch, most):
    """Columns come back as they are, also those with names that are used inside."""
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    made = [(k, f"mail a{k}.b@mail.com now", k * 2, f"r{k}") for k in range(20)] + [(99, None, None, None)]
    frame = spark.createDataFrame(made, "doc_id long, text string, own_terms long, _row string").withColumn("_ROW_", F.lit("z"))
    got = pii.sanitise(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == sorted([(k, "mail [EMAIL] now", 2 * k, f"r{k}", "z") for k in range(20)] + [(99, None, None, None, "z")])


def test_lm_of_any_size(spark, sf_dir):
    """The filter's transport, by one broadcast or by its segments, changes no score; nor do partitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = lambda df, **how: {r.doc_id: r.score for r in lm.score(df, block_tokens=20_000, **how).collect()}
    whole = scores(docs)
    assert len(whole) == docs.count()
    assert scores(docs, max_bits=0) == pytest.approx(whole, rel=1e-12) == scores(docs.repartition(7), max_bits=1 << 40)


def test_lm_beyond_the_broadcast(spark):
    """With far more bigrams than a broadcast filter may hold, scores are those of the counts."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.random() ** 2 * 400)}" for _ in range(rng.randint(0, 400))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, both = Counter(), Counter()
    tokens = [[*t.encode().split(), lm.END] for t in texts]
    for k, t in enumerate(tokens):
        if zlib.crc32(str(k).encode()) % 5 != 1:
            words.update(t)
            both.update(zip([lm.END, *t], t, strict=False))
    n, v = sum(words.values()), len(words)

    def quantised(c):
        return min(n, 0.75 * 2 ** c.bit_length() - 0.5) if c else 0

    def model(t):
        total = 0.0
        for a, b in zip([lm.END, *t], t, strict=False):
            x, y = quantised(words[a]), quantised(words[b])
            total += math.log10((min(quantised(both[a, b]), x, y) + lm.MU * (y + 0.5) / (n + 0.5 * (v + 1))) / (x + lm.MU))
        return total

    got = {r.doc_id: r.score for r in lm.score(docs, block_tokens=3000, max_bits=1 << 13).collect()}
    assert len(got) == len(texts) and sum(len(t) for t in tokens) * lm.FILTER_BITS_EACH > 1 << 14
    # False hits are few: a raised bigram raises a score, a raised context lowers it. Within the bound as beyond it.
    for scores in (got, {r.doc_id: r.score for r in lm.score(docs, block_tokens=3000).collect()}):
        far = [abs(scores[k] - model(t)) for k, t in enumerate(tokens)]
        assert sum(far) <= 0.03 * sum(map(len, tokens)) and sum(x < 1e-9 for x in far) > 0


def test_bloom_levels():
    rng = np.random.default_rng(6)
    pairs = np.unique(rng.integers(0, 1 << 48, 3000, dtype=np.uint64))
    bits = np.zeros((4, 4096), np.uint8)
    level = rng.integers(1, 6, len(pairs))
    where = lm._bucket(pairs, 4)
    assert (np.diff(where) >= 0).all() and where.max() == 3
    for b in range(4):
        row = np.zeros(4096 * 8, bool)
        for q in range(1, 6):
            for at in lm._places(pairs[(where == b) & (level >= q)], q, 4096 * 8, 3):
                row[at] = True
        bits[b] = np.packbits(row, bitorder="little")
    found = lm.levels_of(pairs, bits)
    assert (found >= level).all() and (found == level).mean() > 0.95
    assert (lm.levels_of(rng.integers(0, 1 << 48, 3000, dtype=np.uint64), bits) > 0).mean() < 0.2


def encoded(rows):
    t = Tokenizer.from_file(tokenizer_path())
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")) for i, x in rows]


def test_token_files(spark, docs, rows):
    shards = token_files.write_shards(docs, tokenizer_path(), shard_tokens=2000)
    got = token_files.read_shards(shards).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in encoded(rows))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    first = WaveletMatrix(token_files.shard_bytes(shards, 0, 0))
    assert first.access(0) == first.decode()[0] and token_files.shard_bytes(shards, 0, 10_000) is None
    assert token_files.read_shards(token_files.write_shards(docs.limit(0), tokenizer_path())).count() == 0


def test_packing(docs, rows):
    got = packing.pack(docs, tokenizer_path(), 64).collect()
    expected = Counter()
    for i, x in encoded(rows):
        stops = list(range(len(x) % 64 or min(len(x), 64), len(x) + 1, 64))
        for k, (a, b) in enumerate(zip([0, *stops], stops, strict=False)):
            expected[(i, k, a, b - a, zlib.crc32(x[a:b].tobytes()))] += 1
    assert Counter(tuple(r[:5]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 64 + 2
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_personal_data(spark, docs, rows):
    extra = [(300, "mail a.b+c@d-e.fr.com, 10.0.0.1 and 256.1.1.1"), (301, "4111 1111-1111 1111 or 4111 1111 1111 1112, +44 (20) 7946 0958")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], SCHEMA)
    got = {r.doc_id: r for r in pii.find(docs.select(frame.columns).unionByName(frame)).collect()}
    assert got[300].spans == "email:5:21,ip:23:31" and got[301].spans.startswith("card:0:19,phone:") and got[203].n_email == 0
    assert got[203].base_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == len({i for i, _ in rows}) + 2
    assert pii.find(docs.limit(0)).count() == 0
    clean = {r.doc_id: r for r in pii.sanitise(frame).collect()}
    assert clean[300].text == "mail [EMAIL], [IP] and 256.1.1.1" and clean[300].lang == "en"
    assert multiset(pii.sanitise(docs), ["doc_id", "text", "rep"]) == multiset(docs, ["doc_id", "text", "rep"])


@pytest.mark.parametrize("most", [200_000, 0])
def test_revealing_terms(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    texts = [" ".join(word() for _ in range(30)) for _ in range(1400)]
    for k in range(8):  # a name that always stands beside one address
        texts[k] += f" {word()} zorbas {word()} zed@example.org {word()}"
    texts += ["so zorbas came here today"] + [texts[20] + " common other@example.org"] * 50  # copies are one piece of evidence
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r.term: r.kind for r in pii.revealing_terms(frame).collect()}
    assert terms == {"zorbas": "term"}
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert got[1400].spans == "term:3:9" and got[0].n_terms == 1 and got[20].n_terms == 0


def plain_terms(texts):
    """term: kind, from all counts held at once."""
    texts_of, both, alone = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        words = [(m[0].lower(), *m.span()) for m in pii.WORD.finditer(t)]
        beside = [(words[k - 1][0] if k else "", words[k + 1][0] if k + 1 < len(words) else "") for k in range(len(words))]
        for (w, _, _), c in zip(words, beside, strict=True):
            alone[w].add(c)
        for kind, b, e in pii.base_spans(t):
            entity = f"{kind}:{t[b:e].lower()}"
            texts_of[entity].add(t)
            left, right = [k for k, w in enumerate(words) if w[2] <= b], [k for k, w in enumerate(words) if w[1] >= e]
            for k in left[-pii.WINDOW :] + right[: pii.WINDOW]:
                both[words[k][0], entity].add(beside[k])
    out = {}
    for (w, entity), found in both.items():
        share = len(found) / len(alone[w])
        if len(found) >= pii.LEAST_CONTEXTS and share >= pii.GENERALISE_AT and math.log2(share * len(set(texts)) / len(texts_of[entity])) >= pii.LEAST_BITS:
            out[w] = "term" if share >= pii.REMOVE_AT or out.get(w) == "term" else "general"
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_terms_are_those_of_plain_counts(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    monkeypatch.setattr(pii, "HELD_CONTEXTS", 50)
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    people = [(word() + "İx", f"p{k}@mail{k}.org") for k in range(6)]
    texts = []
    for k in range(900):
        w = [word() for _ in range(20)]
        if k % 30 == 0:
            name, mail = people[k // 30 % 6]
            w[4], w[4 + rng.randint(1, 9)] = name, mail
        elif k % 300 == 7:
            w[7] = people[2][0]  # one name stands elsewhere too
        texts.append(" ".join(w))
    texts += texts[:50] + ["", "nothing"]
    got = {r.term: r.kind for r in pii.revealing_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == plain_terms(texts) and {"term", "general"} == set(got.values())


def plain_counts(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(10)
    texts = [None, "", " ", "a", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "#*$%&|<>", "é b c\x0bd\x0c e\rf"] + ["".join(rng.choices(["a", "b", " ", "\n", "c ", "#"], k=rng.randint(1, 200))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.with_counts(frame).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_quality_rules(spark, docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    made = []
    for k in range(600):
        w = [word() for _ in range(80)]
        made.append((k, " ".join(f"{x}%%%" for x in w) if k % 5 == 0 else " ".join(w)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(500)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.quality_rules(frame, labels).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) and not r.base_failed for r in got) and len(got) == 600
    without = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in without) and quality.quality_rules(docs.limit(0), labels).count() == 0
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in without)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_decontamination(spark, docs, monkeypatch, most):
    for name in ("BROADCAST_SEEDS", "BROADCAST_WORDS", "BROADCAST_IDS"):
        monkeypatch.setattr(decontaminate, name, most)
    rng = random.Random(12)
    item = [f"w{rng.randrange(1000)}" for _ in range(30)]
    short, tiny = [f"v{rng.randrange(1000)}" for _ in range(9)], ["just", "five", "words", "are", "here"]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, " ".join(tiny)), (5, " ".join(item)), (6, "...")], "item_id long, text string")
    noise = lambda n: [f"n{rng.randrange(1000)}" for _ in range(n)]
    substituted = [("x" if k in (4, 13, 22) else w) for k, w in enumerate(item)]
    made = {
        1: noise(50) + item + noise(50), 2: item, 3: noise(9) + substituted + noise(3), 4: noise(80), 5: noise(3) + item[:7] + noise(30),
        6: short, 7: noise(5) + short + noise(5), 8: noise(4) + tiny, 14: [*tiny[:4], "elsewhere"], 15: tiny[1:], 16: tiny[::-1], 9: [w.upper() + "!!" for w in item], 10: item[5:28], 11: item * 40,
    }
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in made.items()] + [(12, None), (13, "")], "doc_id long, text string").withColumn("seed", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.leaked_documents(frame, benchmark).collect()}
    assert sorted(got) == [1, 2, 3, 6, 7, 8, 9, 10, 11] and got[1].n_items == 2 and got[6].first_item == 2 and got[8].n_equal == 5
    odd = spark.createDataFrame([(None, " ".join(item)), (1, "nothing"), (1, " ".join(item)), (2, " ".join(item)), (2, " ".join(item))], "doc_id long, text string")
    assert {(r.doc_id, r.n_items) for r in decontaminate.leaked_documents(odd, benchmark).collect()} == {(None, 2), (1, 2), (2, 2)}
    assert decontaminate.leaked_documents(docs, benchmark.limit(0)).count() == 0 == decontaminate.leaked_documents(docs.limit(0), benchmark).count()


def aligned(words, item):
    """The most equal words of a stretch of 13, over all alignments."""
    import numpy as np

    codes = {w: k for k, w in enumerate(dict.fromkeys([*words, *item]))}
    a, b = np.array([codes[w] for w in words]), np.array([codes[w] for w in item])
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        low, high = max(0, -shift), min(len(b), len(a) - shift)
        run = np.cumsum(np.append(np.zeros(13, int), a[low + shift : high + shift] == b[low:high]))
        best = max(best, int((run[13:] - run[:-13]).max(initial=0)))
    return best


def test_decontamination_of_long_and_repetitive_texts(spark, monkeypatch):
    """Long items, texts and items that repeat a sentence or a word, by all alignments; dealt out and broadcast."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(700)]
    item, sentence = rng.choices(words, k=3000), rng.choices(words, k=9)
    copies = [list(item) for _ in range(3)]
    for c, share in zip(copies, (0.1, 0.3, 0.9), strict=True):
        for k in range(len(c)):
            if rng.random() < share:
                c[k] = f"x{rng.randrange(9999)}"
    changed = [w if k % 5 else "changed" for k, w in enumerate(sentence * 200)]
    made = [*copies, (sentence * 300)[:2500], changed, ["same"] * 4000, ["same"] * 9, rng.choices(words, k=4000), sentence[:5] + item[100:112] + ["end"]]
    items = [item, (sentence * 40)[:320], ["same"] * 2000]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(made)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = {(k, j): n for k, w in enumerate(made) for j, i in enumerate(items) if (n := aligned(w, i)) * 100 >= 13 * 75}
    for most in (500_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_IDS", most)
        assert {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.leaks(docs, benchmark).collect()} == want


def test_words_far_from_an_entity(spark):
    """Candidate terms are words within WINDOW words, whatever stands between."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    made = [f"{word()} zorbamix {word()} {'12 ' * 150} a.person@mail.com {'34 ' * 150} {word()} quillfen {word()}" for _ in range(6)]
    made += [" ".join(word() for _ in range(20)) for _ in range(600)]
    terms = {r.term for r in pii.revealing_terms(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert {"zorbamix", "quillfen"} <= terms


def test_decontamination_of_short_items(spark):
    """Items of 8 to 13 words with all placements of as many substitutions as the rule allows."""
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(8, 14)}
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    made, lengths = [], []
    for n, w in items.items():
        for out in combinations(range(n), n * (100 - decontaminate.EQUAL_PERCENT) // 100):
            made.append((len(made), " ".join(["before", *("changed" if k in out else x for k, x in enumerate(w)), "after"])))
            lengths.append(n)
    made += [(-n, " ".join("changed" if k % 3 == 1 else x for k, x in enumerate(w))) for n, w in items.items()]  # more than allowed
    found = {r.doc_id for r in decontaminate.leaked_documents(spark.createDataFrame(made, "doc_id long, text string"), benchmark).collect()}
    assert Counter(n for k, n in enumerate(lengths) if k not in found) == Counter() and min(found) >= 0


def test_shouting_late_in_a_long_text():
    lexicons = toxicity.Lexicons({"grumblix": 0})
    assert lexicons.votes("grumblix " + "quiet words " * 2000 + "LOUD WORDS " * 4000)[-1] == 1
    assert lexicons.votes("grumblix " + "LOUD WORDS " * 2000 + "quiet words " * 4000)[-1] == 0


def test_counting_voters():
    lexicons = toxicity.Lexicons({"grumblix": 0, "snarvolt": 1, "^grum": 4, "^grumb": 5, "^snar": 6})
    counting = lambda text: lexicons.votes(text)[2 * toxicity.LEXICONS : 2 * toxicity.LEXICONS + 2]
    assert [counting(t) for t in ("", "calm words", "grumblix", "grumblix grumblix", "a grumblix, a snarvolt", "grumpy")] == [[-1, -1], [-1, -1], [0, 0], [0, 0], [1, 1], [-1, 0]]


def test_toxicity_learns_from_rows_without_labels_but_never_from_held_out_ones(spark):
    """Unlabelled rows change the weights; held-out rows, and labels of theirs, don't."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    made = [(k, " ".join([word() for _ in range(15)] + (rng.sample(["grumblix", "snarvolt", "blethorn"], 2) if k % 5 == 0 else []))) for k in range(900)]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k, _ in made if k < 400], "doc_id long, toxic int")
    model = lambda rows, labels: toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), labels)
    whole = model(made, labels)
    other = model([(k, "snarvolt quiet" if held(k) else t) for k, t in made], labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")))
    assert whole.weight.keys() == other.weight.keys() and all(abs(w - other.weight[t]) < 1e-9 for t, w in whole.weight.items()) and abs(whole.bias - other.bias) < 1e-9
    fewer = model([(k, t) for k, t in made if k < 400], labels)
    assert fewer.weight.keys() == whole.weight.keys() and fewer.weight != whole.weight


def test_toxicity(spark, docs):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 8)))
    bad = ["grumblix", "snarvolt", "blethorn", "quozzled"]
    made = []
    for k in range(1500):
        w = [word() for _ in range(40)]
        if k % 8 == 0:
            for b in rng.sample(bad, 3):
                w[rng.randrange(40)] = b
        made.append((k, " ".join(w)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(1500)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) > 0.97 * len(held)
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect()) and toxicity.toxicity(frame.limit(0), labels).count() == 0
    model = toxicity.fit(frame, labels)
    assert toxicity.score(docs, model).count() == docs.count()


def test_toxicity_is_that_of_plain_sums(spark, docs, rows):
    """Scores from terms one by one; learning from odd rows too."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 8)))
    made = [(k, " ".join([word() for _ in range(30)] + (["Snarvolt", "grumblixes!!"] if k % 6 == 0 else []))) for k in range(600)]
    odd = [(700, None), (700, ""), (701, " "), (None, "snarvolt"), (5, "snarvolt " * 20_000), (5, "repeated row"), (5, "repeated row")]
    frame = spark.createDataFrame(made + odd, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(600)] + [(700, 1), (700, 0), (701, 0), (None, 0), (999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fit(frame, labels)

    def plain(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        z = model.bias
        for term, weight in model.weight.items():
            if term in words or term[0] == "^" and any(w.startswith(term[1:]) and len(w) > len(term) - 1 for w in words):
                z += weight
        return 1 / (1 + math.exp(-z))

    assert "snarvolt" in model.weight and all(term[0] != "^" or len(term) - 1 in toxicity.BEGINNINGS for term in model.weight)
    for table, texts in ((frame, made + odd), (docs, rows)):
        expected = defaultdict(list)
        for i, t in texts:
            expected[i].append(plain(t))
        for r in toxicity.score(table, model).collect():
            assert any(abs(r.score - x) < 1e-9 for x in expected[r.doc_id]) and r.predicted == int(r.score >= 0.5)


def test_language(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden with the tree", "en"), ("das haus und der garten mit dem baum", "de"), (None, "de"), ("x", None)] * 30)], "doc_id long, text string, lang string")
    page = lambda lang, text: f'<html lang="{lang}"><script>das und der</script><body>{text}</body></html>'
    german = [(k, f"http://a.example.de/{k}", page("de", "der garten und das haus " * 9)) for k in range(20)]
    english = [(100 + k, f"http://b.example.com/{k}", page("en", "the garden and the house " * 9)) for k in range(20)]
    odd = [(200, "http://a.example.de/x", page("de", "")), (201, None, None), (202, "bad url", "<p>the tree and the house and the garden"), (203, "http://b.example.com/y", page("de", "the house and the garden " * 20)), (None, "http://b.example.com/z", ""), (200, "http://a.example.de/x", page("de", ""))]
    pages = spark.createDataFrame(german + english + odd, "page_id long, url string, html string").withColumn("p", F.lit(1))
    got = language.identify(pages, docs).collect()
    found = {r.page_id: r for r in got}
    assert len(got) == 46 and all(found[k].lang == "de" for k in range(20)) and all(found[100 + k].lang == "en" for k in range(20))
    assert found[200].lang == "de" and found[202].lang == "en" and found[203].lang == "en" and found[None].lang == "en" and found[201].lang in ("de", "en")
    assert all(0.5 <= r.posterior <= 1.0001 for r in got)
    assert language.identify(pages.limit(0), docs).count() == 0 and language.identify(pages, docs.limit(0)).filter("lang IS NOT NULL").count() == 0


def test_language_is_that_of_plain_sums(spark):
    """Posteriors against sums made page by page, each without the page itself."""
    rng = random.Random(23)
    words = {x: ["".join(rng.choices("abcdefghi", k=5)) for _ in range(30)] for x in ("de", "en", "fr")}
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words[x], k=40)), x) for k, x in enumerate(["de", "en", "fr"] * 20)], "doc_id long, text string, lang string")
    made = []
    for k in range(80):
        x = rng.choice(sorted(words))
        text = " ".join(rng.choices(words[x], k=2) + rng.choices(words["en"], k=2)) if k % 9 else ""
        url = None if k % 11 == 0 else f"http://h{k % 7}.d{k % 3}.{'de' if k % 2 else 'com'}/{k}"
        made.append((k, url, f"<html lang={x if k % 4 else 'en'}>{text}" if k % 5 else f"<p>{text}"))
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    model = language.fit(docs)
    langs = sorted(model)
    evidence = {r.page_id: r for r in language._evidence(pages, model).collect()}

    def sums(chosen):
        return np.sum([np.array(r.p) for r in chosen], axis=0) if chosen else np.zeros(3)

    def smoothed(s, above):
        return (s + language.SMOOTHING * above) / (s.sum() + language.SMOOTHING)

    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    assert set(got) == set(evidence)
    for k, r in evidence.items():
        rest = [x for j, x in evidence.items() if j != k]
        whole = sums(rest)
        prior = (whole + 1) / (whole.sum() + 3)
        for level in ("suffix", "domain", "host") if r.host else ():
            prior = smoothed(sums([x for x in rest if x[level] == r[level]]), prior)
        odds = prior * np.maximum(np.array(r.p), 1e-12)
        if r.declared:
            odds *= (sums([x for x in rest if x.declared == r.declared]) + 0.1) / (whole + 1)
        assert abs(got[k].posterior - odds.max() / odds.sum()) < 1e-9 and got[k].lang == langs[int(odds.argmax())]


def test_language_keeps_all_labelled(spark):
    rng = random.Random(21)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    docs = spark.createDataFrame([(k, " ".join(w * (2 if k else 1)), lang) for k, (lang, w) in enumerate(words.items())], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert sorted(model) == sorted(words)
    pages = spark.createDataFrame([(k, None, f"<p>{' '.join(words[f'l{k:02}'])}") for k in (0, 35, 69)], "page_id long, url string, html string")
    assert {r.page_id: r.text_lang for r in language.identify(pages, docs).collect()} == {0: "l00", 35: "l35", 69: "l69"}


def plain_scan(docs, model):
    """(doc_id, paragraph, family, template) by weights and templates, gram by gram."""
    def grams(line):
        w = re.findall(r"[^\W_]+", line.lower())
        return [" ".join(w[k : k + n]) for n in (2, 3) for k in range(len(w) - n + 1)]

    out = []
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            own = grams(line)
            known = {g for g in own if g in model.weights}
            if not known:
                continue
            s = np.array(model.bias) + sum(np.array(model.weights[g]) for g in known)
            family = model.families[int(s.argmax())]
            shares = [100 * sum(t in model.templates[g] for g in known) / min(len(own), n) if licences.TEMPLATES[t][0] == family else -1 for t, n in enumerate(model.sizes)]
            if family != licences.UNKNOWN and max(shares) >= licences.CONFIRM_PERCENT:
                out.append((i, k, family, shares.index(max(shares))))
    return sorted(out)


def test_licence_scan_is_the_plain_one(spark):
    """All templates, alone and in a text, shortened and mixed, against a scan gram by gram; trained on a table without rows."""
    model = licences.train(spark.createDataFrame([], "doc_id long, text string"))
    rng = random.Random(33)
    made = [(k, t) for k, (_, t) in enumerate(licences.TEMPLATES)] + [(100 + k, f"Notes\n{t.upper()}\nend") for k, (_, t) in enumerate(licences.TEMPLATES)] + [(200 + k, t) for k, t in enumerate(licences.UNKNOWN_TEMPLATES)]
    words = " ".join(t for _, t in licences.TEMPLATES).split()
    made += [(300 + k, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(100)]
    made += [(400 + k, " ".join(t.split()[rng.randint(0, 4) :][: rng.randint(3, 30)])) for k, (_, t) in enumerate(licences.TEMPLATES * 3)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family, r.template) for r in licences.scan(frame, model).collect())
    assert got == plain_scan(made, model)
    found = {(i, k): f for i, k, f, _ in got}
    for k, (family, _) in enumerate(licences.TEMPLATES):
        assert found[k, 0] == family == found[100 + k, 1]
    assert not any(200 <= i < 300 for i, _ in found)


def test_licences(spark, docs):
    texts = ["Some prose.\nReleased under the MIT License.\nMore.", "LICENSED under the Apache License, Version 2.0!", "My license expired, and the car is under repair.", None, "", "This work is licensed under the GNU General Public License, version 3.\n" * 2, "the of and"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("grams", F.lit(1))
    model = licences.train(docs)
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(frame, model).collect())
    assert got == [(0, 1, "mit"), (1, 0, "apache"), (5, 0, "gpl"), (5, 1, "gpl")]
    assert licences.scan(docs, model).count() == 0 == licences.scan(frame.limit(0), model).count()

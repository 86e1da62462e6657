"""The trie against a plain one over whole texts: shared beginnings, copies, hot turns, subtries taken apart, nulls."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100  # the remainder has the sign of c, as in SQL
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(paths):
    members, ended = {}, {}
    for c, path in paths.items():
        ended.setdefault(tuple(path), []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ids = ",".join(map(str, sorted(ended.get(p, []))))
        out[min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ids.encode()).hexdigest()] += 1
    return out


def made(seed):
    """Some of three hundreds, with hot first turns, copies of whole conversations and ids with gaps."""
    rng = random.Random(seed)
    texts = ["Hello there.", "", None, "é" * 30, "What now?", "a" * 2000]
    rows = []
    for c in rng.sample(range(300), 120):
        n = rng.randint(1, 9)
        for t in range(n):
            text = "Hello there." if t < 2 and rng.random() < 0.6 else rng.choice(texts) if rng.random() < 0.7 else f"{c} {t}"
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), text))
        if rng.random() < 0.3:
            rows += [(c + 1000, t, "user", "Hello there.") for t in range(6)]
    return [*rows, *[(5000, t, "user", f"turn {t}") for t in range(300)], (5000, 7, "user", "twice"), (5000, 7, "user", "twice"), (None, 1, "user", "nobody's"), (-7, 0, "x", "below"), (7, 1, "user", "x"), (6000, 1, "", "")]


@pytest.mark.parametrize("most", [50_000, 60, 3])
def test_trie(spark, most):
    rows = made(most)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "ds", "key", "g", "level", "low", "ends", "base", "head"):  # names used inside
        df = df.withColumn(name, F.lit("x"))
    got = prefix_trie.prefix_trie(df.repartition(5), most)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert Counter(map(tuple, got.collect())) == plain(rebuilt(rows))


def test_ids_in_blocks(spark, monkeypatch):
    """Ids of one node over several partitions and blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 50)
    rows = spark.range(400).select(F.when(F.col("id") < 350, F.lit(b"a")).otherwise(F.lit(b"b")).alias("key"), F.col("id").alias("conv_id")).repartition(3)
    want = {k: hashlib.sha256(",".join(map(str, ids)).encode()).digest() for k, ids in ((b"a", range(350)), (b"b", range(350, 400)))}
    assert {bytes(r.key): bytes(r.ends) for r in prefix_trie.id_hashes(rows).collect()} == want


def test_no_rows_and_no_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    (root,) = prefix_trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "only")], SCHEMA)).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())

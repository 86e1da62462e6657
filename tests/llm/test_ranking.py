"""Ranks across buckets against plain ones: hot groups, hot pairs, equal rows, nulls, buckets of every number."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscan.llm import ranking

KEYS = ["g", "h", "p", "q", "t"]


def plain(rows, most=None):
    """pos, rank, dense_rank and tied by sorting everything."""
    last = lambda x: (x is None, x or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    out = Counter()
    for own in groups.values():
        own.sort(key=lambda r: tuple(map(last, r[2:])))
        tied, pairs = Counter(r[2:4] for r in own), list(dict.fromkeys(r[2:4] for r in own))
        first = {}
        for pos, r in enumerate(own, 1):
            first.setdefault(r[2:4], pos)
            if most is None or pos <= most:
                out[*r, pos, first[r[2:4]], pairs.index(r[2:4]) + 1, tied[r[2:4]]] += 1
    return out


def made(seed, n=900):
    """A third of the rows in one group, half of these in one pair, many of these equal; nulls everywhere."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice([*x, None])
    rows = [(some(*range(12)), some(1, 2), some(1, 2, 3), some(*range(5)), some(*range(40))) for _ in range(n // 3)]
    rows += [(7, 1, some(1, 2, 3, 4), some(*range(9)), rng.randrange(200)) for _ in range(n // 6)]
    rows += [(7, 1, 2, 5, rng.choice([3, rng.randrange(50)])) for _ in range(n // 3)]
    return rows + [(7, 1, 2, 5, 3)] * (n // 6)


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
@pytest.mark.parametrize("most", [None, 1, 5])
def test_ranked(spark, buckets, most):
    rows = made(buckets)
    df = spark.createDataFrame(rows, "g long, h int, p long, q int, t long")
    for name in ("pos", "rank", "b", "piece", "place", "n", "rows", "g0", "tied"):  # names used inside
        df = df.withColumn(name, F.lit("x"))
    got = ranking.ranked(df.repartition(6), KEYS[:2], KEYS[2:4], KEYS[4:], most, buckets)
    assert got.columns == [*KEYS, "pos", "rank", "dense_rank", "tied"]
    assert Counter(map(tuple, got.collect())) == plain(rows, most)


def test_one_pair_only(spark):
    """All rows equal, over more buckets than rows: still one after another."""
    df = spark.createDataFrame([(1, 1, 1, None, 1)] * 30, "g long, h int, p long, q int, t long").repartition(4)
    got = ranking.ranked(df, KEYS[:2], KEYS[2:4], KEYS[4:], buckets=50).collect()
    assert sorted(r.pos for r in got) == list(range(1, 31)) and {(r["rank"], r.dense_rank, r.tied) for r in got} == {(1, 1, 30)}


def test_beyond_memory(spark, monkeypatch):
    """Windows over more than DuckDB may hold go on on disk, and leave nothing there."""
    monkeypatch.setattr(ranking, "MEMORY", "64MB")
    n = 1_500_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.lit(1).alias("h"), F.pmod(F.xxhash64("id"), F.lit(10)).alias("p"), F.lit(0).alias("q"), F.xxhash64(F.col("id") + 1).alias("t"))
    got = ranking.ranked(df, KEYS[:2], KEYS[2:4], KEYS[4:], buckets=1).agg(F.count("*").alias("n"), F.sum("pos").alias("s"), F.max("dense_rank").alias("d")).head()
    assert (got.n, got.s, got.d) == (n, 2 * sum(range(1, n // 2 + 1)), 10)


def test_no_rows(spark):
    lines = spark.createDataFrame([], "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz")
    assert ranking.sale_line_ranks(lines).collect() == []


def test_odd_values(spark):
    """No number in a discount or amount counts as null; nulls make groups and pairs of their own."""
    rows = [(1, 1, 2, 3, 10, float("nan"), float("nan"), "x"), (1, 1, 2, 3, 10, None, None, "x"), (None, None, None, None, None, None, None, None), (1, 2, 2, 3, -1, 1.0, 0.05, "y"), (1, 2, 2, 3, None, 1.0, 0.05, "y")]
    lines = spark.createDataFrame(rows, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string").withColumn("shipped_at", F.expr("cast(null as timestamp_ntz)"))
    got = sorted((str(r.vendor_id), r.part, r.month, r.pos, str(r.quantity), str(r.percent), r.tied) for r in ranking.sale_line_ranks(lines, most=9).collect())
    assert got == [("3", 2, -1, 1, "10", "None", 2), ("3", 2, -1, 2, "10", "None", 2), ("3", 2, -1, 3, "-1", "5", 1), ("3", 2, -1, 4, "None", "5", 1), ("None", -1, -1, 1, "None", "None", 1)]

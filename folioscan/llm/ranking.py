"""Operator 13, ranks within groups where many rows tie: DuckDB windows in buckets, joined by what stands before.

Spark deals rows into buckets, which are ranges of the order by group, pair and tie keys, so a bucket
holds many small groups, or a stretch of a large group's pairs, or of one pair. In each bucket DuckDB
numbers rows over the bucket's Arrow batches, out of core: beyond MEMORY it sorts and sums on disk, in
Spark's own scratch folders, and leaves nothing there. Only the first and the last group of a bucket
can go on in others. For these each bucket reports one row (rows, distinct pairs, the pairs at both
ends), and sums over earlier buckets are added to row numbers, ranks and dense ranks. So what meets
across buckets is two rows a bucket at most, whatever the input; buckets are as many as the session
has shuffle partitions.

Nulls: a null in any key is a value of its own, equal to itself, after all others. Ties: rows that are
equal in group, pair and all tie keys are numbered one after another, and split between buckets by
their place in the input. No rows: none. Columns that aren't named aren't read, so their names don't
matter. A task that is lost is run again from the input; the result of the windows is a table in
the shared folder, so nothing after it needs that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import partitions, written

#: What DuckDB may hold in one task; beyond it uses disk.
MEMORY = "256MB"
#: Rows of an Arrow batch on the way out.
OUT_ROWS = 20_000


def _list(names: Sequence[str], form: str = "{}", by: str = ", ") -> str:
    return by.join(form.replace("{}", n) for n in names)


def _windows(groups: list[str], pairs: list[str], ties: list[str], most: int | None, schema: T.StructType) -> Callable[[Iterator], Iterator]:
    """For a task: the bucket's lines with their numbers in the bucket (piece null), then its end pieces (piece not null)."""
    order = _list(groups + pairs, "{} NULLS LAST")
    same = lambda names: _list(names, "x.{} IS NOT DISTINCT FROM y.{}", " AND ")
    counted = (
        f"CREATE TEMP TABLE counted AS SELECT *, 1 + coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k, row_number() OVER o AS d "
        f"FROM (SELECT {_list(groups + pairs)}, count(*) AS n FROM lines GROUP BY ALL) WINDOW o AS (PARTITION BY {_list(groups)} ORDER BY {_list(pairs, '{} NULLS LAST')})"
    )
    numbered = f"SELECT *, row_number() OVER (PARTITION BY {_list(groups)} ORDER BY {_list(pairs + ties, '{} NULLS LAST')}) AS r FROM lines" + (f" QUALIFY r <= {most}" if most is not None else "")
    lines = f"SELECT x.*, y.k, y.d, y.n FROM ({numbered}) x JOIN counted y ON {same(groups + pairs)}"
    # The groups at the bucket's two ends, each with its first and its last pair.
    ends = f"(SELECT {_list(groups)} FROM counted ORDER BY {order} LIMIT 1) UNION (SELECT {_list(groups)} FROM counted ORDER BY {_list(groups + pairs, '{} DESC NULLS FIRST')} LIMIT 1)"
    pieces = (
        f"SELECT {_list(groups, 'x.{}')}, sum(n)::BIGINT AS rows, count(*) AS dense, {_list(pairs, 'arg_min_null({}, d) AS {}')}, arg_min(n, d) AS n, {_list(pairs, 'arg_max_null({}, d) AS last_{}')}, arg_max(n, d) AS last_n "
        f"FROM counted x JOIN ({ends}) y ON {same(groups)} GROUP BY {_list(groups, 'x.{}')}"
    )
    names, inside = [f.name for f in schema], ["b", *groups, *pairs, *ties]

    def run(batches: Iterator) -> Iterator:
        import os
        import shutil
        import tempfile

        import duckdb
        import pyarrow as pa

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        bucket = first.column(0)[0].as_py()
        folder = tempfile.mkdtemp(prefix="windows-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        try:

            def given() -> Iterator:
                yield first
                yield from batches

            rows = pa.RecordBatchReader.from_batches(pa.schema([(n, t) for n, t in zip(inside, first.schema.types, strict=True)]), (pa.RecordBatch.from_arrays(b.columns, names=inside) for b in given()))
            con.register("given", rows)
            con.execute(f"CREATE TEMP TABLE lines AS SELECT {_list(inside[1:])} FROM given")
            con.execute(counted)
            for query, piece in ((lines, None), (pieces, 1)):
                have = f"SELECT *, {bucket}::INTEGER AS b, {piece or 'NULL'}::INTEGER AS piece FROM ({query})"
                reader = con.sql(have).to_arrow_reader(OUT_ROWS)
                at = {n: k for k, n in enumerate(reader.schema.names)}
                for batch in reader:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(at[f.name]).cast(_arrow(f.dataType)) if f.name in at else pa.nulls(batch.num_rows, _arrow(f.dataType)) for f in schema], names=names
                    )
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _arrow(kind: T.DataType):  # noqa: ANN202
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _equal(x: DataFrame, y: DataFrame, names: Sequence[str]) -> Column:
    return reduce(Column.__and__, [x[n].eqNullSafe(y[n]) for n in names])


def ranked(rows: DataFrame, group: Sequence[str], pair: Sequence[str], ties: Sequence[str], most: int | None = None, buckets: int | None = None) -> DataFrame:
    """The columns named, with pos, rank, dense_rank and tied (rows of the group with the row's pair), all long.

    All named columns hold whole numbers and are taken in ascending order, nulls last. pos numbers a
    group's rows by pair and tie keys; rank and dense_rank go by pair alone. most: only rows with pos
    up to it are returned, tied counts all.
    """
    n = buckets or partitions(rows.sparkSession)
    groups, pairs, keys = ([f"{kind}{k}" for k in range(len(names))] for kind, names in (("g", group), ("p", pair), ("t", ties)))
    own = [F.col(c).alias(a) for c, a in zip([*group, *pair, *ties], groups + pairs + keys, strict=True)]
    # Rows that are equal in all keys may be too many for one bucket: they are told apart by their place in the input.
    dealt = rows.select(*own, F.monotonically_increasing_id().alias("place")).repartitionByRange(n, *(F.col(c).asc_nulls_last() for c in [*groups, *pairs, *keys]), "place")
    dealt = dealt.select(F.spark_partition_id().alias("b"), *groups, *pairs, *keys)
    kind = {f.name: f.dataType for f in dealt.schema}
    out = [("piece", T.IntegerType()), *((c, kind[c]) for c in ["b", *groups, *pairs, *keys]), *((c, T.LongType()) for c in ("r", "k", "d", "n", "rows", "dense")), *((f"last_{c}", kind[c]) for c in pairs), ("last_n", T.LongType())]
    schema = T.StructType([T.StructField(c, t) for c, t in out])
    made = written(dealt.mapInArrow(_windows(groups, pairs, keys, most, schema), schema), "windows")
    return _offset(made, groups, pairs).filter(F.col("pos") <= most if most is not None else F.lit(True)).select(
        *(F.col(a).alias(c) for c, a in zip([*group, *pair, *ties], groups + pairs + keys, strict=True)), "pos", "rank", "dense_rank", "tied"
    )


def _offset(made: DataFrame, groups: list[str], pairs: list[str]) -> DataFrame:
    """Lines with what the pieces of earlier buckets add."""
    earlier = Window.partitionBy(*groups).orderBy("b")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    pieces = made.filter("piece IS NOT NULL").select("b", *groups, *pairs, "n", "rows", "dense", *(f"last_{c}" for c in pairs), "last_n")
    goes_on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lag(f"last_{c}").over(earlier)) for c in pairs], F.lag("b").over(earlier).isNotNull())
    pieces = pieces.withColumn("goes_on", goes_on.cast("long")).withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    pieces = pieces.withColumn("dense_before", F.coalesce(F.sum("dense").over(before), F.lit(0)) - F.sum("goes_on").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    # A pair at a bucket's end: its rows in all buckets, and where the first of them stands.
    at_start = F.struct(*pairs, "n", (F.col("rows_before") + 1).alias("start"))
    at_end = F.struct(*(F.col(f"last_{c}").alias(c) for c in pairs), F.col("last_n").alias("n"), (F.col("rows_before") + F.col("rows") - F.col("last_n") + 1).alias("start"))
    ends = pieces.select(*groups, F.explode(F.when(F.col("dense") > 1, F.array(at_start, at_end)).otherwise(F.array(at_start))).alias("e"))
    whole = ends.groupBy(*groups, *(F.col(f"e.{c}").alias(c) for c in pairs)).agg(F.sum("e.n").alias("all_n"), F.min("e.start").alias("start"))
    lines = made.filter("piece IS NULL").drop("piece", "rows", "dense", "last_n", *(f"last_{c}" for c in pairs))
    offsets = pieces.select("b", *groups, "rows_before", "dense_before")
    out = lines.join(offsets, _equal(lines, offsets, ["b", *groups]), "left").select(lines["*"], "rows_before", "dense_before")
    out = out.join(whole, _equal(out, whole, [*groups, *pairs]), "left").select(out["*"], "all_n", "start")
    shift = F.coalesce("rows_before", F.lit(0))
    return out.select(
        *(c for c in lines.columns if c not in ("b", "r", "k", "d", "n")), (F.col("r") + shift).alias("pos"), F.coalesce("start", F.col("k") + shift).alias("rank"),
        (F.col("d") + F.coalesce("dense_before", F.lit(0))).alias("dense_rank"), F.coalesce("all_n", "n").alias("tied"),
    )


def _rounded(x: Column) -> Column:
    """Hundredths to the nearest, halves up; null for what is no number."""
    return F.when(~F.isnan(x), F.floor(100 * x + 0.5)).cast("long")


def sale_line_ranks(lines: DataFrame, most: int = 2) -> DataFrame:
    """Operator 13's query: the first lines of each vendor, part and month by pair, and how many tie.

    Null vendor: a group of its own. Discounts and amounts that are no number count as null.
    """
    alone = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    group = lambda c: F.when(alone, -1).otherwise(c).cast("long")
    rows = lines.select(
        group(F.col("vendor_id")).alias("vendor_id"), group(F.coalesce(F.col("item_id") % 5, F.lit(-1))).cast("int").alias("part"),
        group(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).cast("int").alias("month"),
        (-F.floor(F.col("quantity") / 10)).cast("long").alias("tens"), _rounded(F.col("discount")).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"), _rounded(F.col("amount")).alias("amount_cents"),
    )
    out = ranked(rows, ["vendor_id", "part", "month"], ["tens", "percent"], ["sale_id", "line_no", "quantity", "amount_cents"], most)
    return out.select("vendor_id", F.col("part").cast("long").alias("part"), F.col("month").cast("long").alias("month"), "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied", "rank", "dense_rank")

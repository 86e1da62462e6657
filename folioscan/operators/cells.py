"""Nearest neighbours by inverted lists: exact, and only of the cells that can hold one.

Vectors are listed by the nearest of some centres, and a cell knows its centre and its radius, the
largest distance of a vector from the centre. No dot product of a query with a vector of the cell is
above query . centre + |query| * radius. A search compares the cells with the highest bounds first;
cells whose bound is below the k-th score found so far can't change the result and are left out, all
others are compared too. So the result is that of comparing everything, and how much is read depends
on how well the vectors fall into clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import vectors
from folioscan.operators.search import QUERY_BLOCK, _best_pairs

#: Vectors that centres are fitted on, expected number; vectors of one matrix of a list.
FIT_ROWS, LIST_ROWS = 50_000, 4_096
LISTS = "cell int, ids array<long>, index array<long>, matrix binary, n long, radius double"


@dataclass(frozen=True)
class Lists:
    """centres: one a cell, the driver has them all; lists: matrices of vectors by cell (LISTS)."""

    centres: list[list[float]]
    lists: DataFrame
    radii: list[float | None]


def _nearest(centres: list[list[float]]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = np.array(centres)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
                cell = ((c * c).sum(1) - 2 * x @ c.T).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", "document_id", "chunk_index", "embedding"])

    return run


def _listed(centres: list[list[float]]) -> Callable[[Iterator], Iterator]:
    """Rows in order of their cells as matrices of up to LIST_ROWS vectors, each of one cell."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cells = batch.column(0).to_numpy()
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
            ids, index = (batch.column(k).cast(pa.int64()).to_numpy() for k in (1, 2))
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for low in range(a, b, LIST_ROWS):
                    part = slice(low, min(b, low + LIST_ROWS))
                    far = float(np.sqrt(((x[part] - np.array(centres[cells[low]])) ** 2).sum(1)).max())
                    yield pa.RecordBatch.from_pylist(
                        [{"cell": int(cells[low]), "ids": ids[part].tolist(), "index": index[part].tolist(), "matrix": np.ascontiguousarray(x[part]).tobytes(), "n": part.stop - low, "radius": far}],
                        schema=pa.schema([("cell", pa.int32()), ("ids", pa.list_(pa.int64())), ("index", pa.list_(pa.int64())), ("matrix", pa.binary()), ("n", pa.int64()), ("radius", pa.float64())]),
                    )

    return run


def inverted_lists(chunks: DataFrame, folder: str, cells: int = 64, seed: int = 7) -> Lists:
    """Lists of chunks (document_id, chunk_index, embedding), written to the folder. Rows without a vector are left out.

    Centres are fitted on about FIT_ROWS vectors; every vector is listed. A cell with very many is
    dealt over tasks and matrices like any other rows.
    """
    rows = chunks.filter("embedding IS NOT NULL").select("document_id", "chunk_index", "embedding")
    n = rows.count()
    spark = chunks.sparkSession
    if not n:
        return Lists([], spark.createDataFrame([], LISTS), [])
    fit = rows.filter(F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(1_000_000)) < max(1, round(1_000_000 * min(1.0, FIT_ROWS / n)))) if n > FIT_ROWS else rows
    k = min(cells, n)
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="v").fit(fit.select(array_to_vector("embedding").alias("v")))
        centres = [c.tolist() for c in model.clusterCenters()]
    else:
        centres = [list(rows.head()["embedding"])]
    placed = rows.mapInArrow(_nearest(centres), "cell int, document_id long, chunk_index int, embedding array<float>")
    dealt = placed.repartitionByRange("cell", F.xxhash64("document_id", "chunk_index")).sortWithinPartitions("cell", "document_id", "chunk_index")
    dealt.mapInArrow(_listed(centres), LISTS).write.parquet(folder)
    lists = spark.read.schema(LISTS).parquet(folder)
    far = {r["cell"]: r["far"] for r in lists.groupBy("cell").agg(F.max("radius").alias("far")).collect()}
    return Lists(centres, lists, [far.get(k) for k in range(len(centres))])


def _bounded(index: Lists, probes: int) -> Callable[[Iterator], Iterator]:
    """For batches of (query_id, vector, least): the cells to compare. Without least the probes best ones, else those from least on that weren't among them."""
    points, far = index.centres, index.radii

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        centres, radii = np.array(points), np.array([-np.inf if r is None else r for r in far])
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            norm = np.sqrt((q * q).sum(1, keepdims=True))
            bound = q @ centres.T + norm * radii
            bound += 1e-9 * (1 + np.abs(bound) + norm)  # more than rounding can take away
            order = np.argsort(-bound, axis=1, kind="stable")
            least = batch.column(2).to_numpy(zero_copy_only=False)
            names, cells = [], []
            for row, name in enumerate(batch.column(0).to_pylist()):
                first, rest = order[row, :probes], order[row, probes:]
                chosen = first if np.isnan(least[row]) else rest[bound[row, rest] >= least[row]]
                chosen = chosen[np.isfinite(bound[row, chosen])]
                names += [name] * len(chosen)
                cells += chosen.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cells, pa.int32())], names=["query_id", "cell"])

    return run


def _compared(index: Lists, queries: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The k best of each matrix for each query that has chosen its cell: query_id, document_id, chunk_index, score."""
    asked = chosen.join(queries, "query_id").groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(-(-queries.count() // QUERY_BLOCK) or 1)).alias("block"))
    asked = asked.agg(F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("v"))).alias("qs"))
    pairs = index.lists.select("cell", "ids", "index", "matrix").join(asked, "cell").select("ids", "index", "matrix", "qs.id", "qs.v")
    return pairs.mapInArrow(_best_pairs(k), "query_id long, document_id long, chunk_index int, score double")


def top_k_each(index: Lists, queries: DataFrame, k: int, probes: int = 8) -> tuple[DataFrame, DataFrame]:
    """As search.top_k_each, for rows (query_id, query): query_id, rank, document_id, chunk_index, score. Beside it the cells that each query was compared with (query_id, cell)."""
    q = queries.filter("query IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), vectors.doubles(F.col("query")).alias("v"))
    cells = "query_id long, cell int"
    if not index.centres:
        none = queries.sparkSession.createDataFrame([], "query_id long, rank int, document_id long, chunk_index int, score double")
        return none, queries.sparkSession.createDataFrame([], cells)
    first = q.select("query_id", "v", F.lit(float("nan")).alias("least")).mapInArrow(_bounded(index, probes), cells)
    found = _compared(index, q, first, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
    # The k-th score so far; with fewer than k, everything is compared.
    least = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = q.join(least, "query_id", "left").select("query_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least")).mapInArrow(_bounded(index, probes), cells)
    best = found.unionByName(_compared(index, q, rest, k)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "document_id", "chunk_index", "score"), first.unionByName(rest)

"""Exact nearest neighbours with folder filters, reranking in two stages, relevance threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import vectors
from folioscan.functions.scalars import normalize_path, sigmoid


#: Queries in a block of top_k_each: with a batch of 10,000 chunks, 40 MB of scores.
QUERY_BLOCK = 512


def in_folders(path: Column, folders: Sequence[str], compat: bool = False) -> Column:
    """A path is in a folder if it is the folder, or lies below it, case of ASCII letters aside.

    compat: % and _ in a folder's name are wildcards, and the root folder has nothing below it.
    """
    names = sorted({f.replace("\\", "/").rstrip("/") or "/" for f in folders if f.strip()})
    if not names:
        return F.lit(False)
    plain = normalize_path(path)

    def below(folder: str) -> Column:
        if compat:
            return plain.ilike(f"{folder}/%")
        safe = folder.rstrip("/").replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return plain.ilike(f"{safe}/%")

    return reduce(Column.__or__, [(plain == f) | below(f) for f in names])


def scored(chunks: DataFrame, query: Sequence[float]) -> DataFrame:
    return chunks.withColumn("score", vectors.dot(F.col("embedding"), vectors.literal(query)))


def top_k(chunks: DataFrame, query: Sequence[float], k: int | None = 10, folders: Sequence[str] | None = None) -> DataFrame:
    """The k best chunks by dot product, ties by document and chunk. chunks has document_id, chunk_index, path, embedding.

    k = None: all. folders = []: nothing; folders = None: no filter. The filter runs before scores do,
    and sort and limit are one bounded heap for each task (TakeOrderedAndProject).
    """
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    rows = chunks if folders is None else chunks.filter(in_folders(F.col("path"), folders))
    ordered = scored(rows, query).orderBy(F.desc("score"), "document_id", "chunk_index")
    return ordered if k is None else ordered.limit(k)


def shown(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """The few rows of top_k with their documents' columns, in the same order. Hits without a document are left out."""
    return documents.join(F.broadcast(hits), "document_id").orderBy(F.desc("score"), "document_id", "chunk_index")


def located(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (path) with document_id, by path whatever its slashes; hits of paths that aren't there are left out."""
    known = documents.select(normalize_path(F.col("path")).alias("_path"), "document_id")
    return known.join(F.broadcast(hits.withColumn("_path", normalize_path(F.col("path")))), "_path").drop("_path")


def _packed(batches: Iterator) -> Iterator:
    """Each Arrow batch of (document_id, chunk_index, embedding) as one row, its vectors as one matrix of doubles."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            matrix = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            rows = [pa.array([batch.column(k).cast(pa.int64()).to_pylist()], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())], names=["ids", "index", "matrix"])


def _best_pairs(k: int) -> Callable[[Iterator], Iterator]:
    """For rows of a batch's matrix and a block of queries: the k best of the batch for each query."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                ids, index, matrix, names, vectors_ = (c[row].as_py() for c in batch.columns)
                ids, index = np.array(ids, np.int64), np.array(index, np.int64)
                chunks = np.frombuffer(matrix, "<f8").reshape(len(ids), -1)
                queries = np.array(vectors_, np.float64).reshape(len(names), -1)
                scores = np.zeros((len(names), len(ids)))
                for j in range(chunks.shape[1]):  # from the first place on, as vectors.dot
                    scores += queries[:, j : j + 1] * chunks[:, j]
                least = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                for name, own, low in zip(names, scores, least, strict=True):
                    at = np.flatnonzero(own >= low)
                    at = at[np.lexsort((index[at], ids[at], -own[at]))][:k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.int64()), pa.array(ids[at]), pa.array(index[at].astype(np.int32)), pa.array(own[at])], names=["query_id", "document_id", "chunk_index", "score"])

    return run


def top_k_each(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, document_id, chunk_index, score for each row (query_id, query), against all chunks.

    Queries are dealt into blocks of about QUERY_BLOCK, chunks into Arrow batches. Each block meets
    each batch in one product, of which k rows a query go on, so no pair of rows is ever a row, what
    a task holds has a bound, and k rows a query and batch are shuffled. Ties: by document and chunk.
    Rows without a vector are left out.
    """
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = queries.filter("query IS NOT NULL").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block"))
    blocks = blocks.agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("id"), vectors.doubles(F.col("query")).alias("v"))).alias("qs"))
    batches = chunks.filter("embedding IS NOT NULL").select("document_id", "chunk_index", "embedding").mapInArrow(_packed, "ids array<long>, index array<long>, matrix binary")
    pairs = batches.crossJoin(blocks).select("ids", "index", "matrix", "qs.id", "qs.v")
    best = pairs.mapInArrow(_best_pairs(k), "query_id long, document_id long, chunk_index int, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def candidates(k: int) -> int:
    """How many rows the reranker gets."""
    return max(3 * k, 30)


def lexical_logit(question: str) -> Callable[[Column], Column]:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that the text has."""
    words = sorted(set(question.lower().split()))

    def logit(text: Column) -> Column:
        found = F.array_distinct(F.split(F.lower(text), r"\s+"))
        return F.size(F.array_intersect(found, F.array(*map(F.lit, words)))).cast("double") / max(1, len(words)) * 4 - 2

    return logit


def reranked(hits: DataFrame, logit: Callable[[Column], Column], k: int) -> DataFrame:
    """hits with embedding_score, rerank_score and score = sigmoid(rerank_score); equal ones keep their order."""
    out = hits.withColumn("embedding_score", F.col("score")).withColumn("rerank_score", logit(F.col("text"))).withColumn("score", sigmoid(F.col("rerank_score")))
    return out.orderBy(F.desc("score"), F.desc("embedding_score"), "document_id", "chunk_index").limit(k)


def search(chunks: DataFrame, query: Sequence[float], k: int = 10, folders: Sequence[str] | None = None, logit: Callable[[Column], Column] | None = None) -> DataFrame:
    """top_k, or more of them reranked to k."""
    if logit is None:
        return top_k(chunks, query, k, folders)
    return reranked(top_k(chunks, query, candidates(k), folders), logit, k)


def relevant(hits: DataFrame, least: float = 0.2, by: str | None = None) -> DataFrame:
    """Hits of at least this score; all where none has it. by: a column that tells queries apart."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))
    return hits.withColumn("_any", F.max((F.col("score") >= least).cast("int")).over(w)).filter((F.col("score") >= least) | (F.col("_any") == 0)).drop("_any")

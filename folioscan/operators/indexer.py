"""Indexing files: list, drop the unchanged before parsing, parse and chunk, embed, commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.batches import small_batches
from folioscan.functions.scalars import normalize_path
from folioscan.operators.store import Store, index_stats
from folioscan.schema import IndexConfig
from folioscan.sources.files import parsed, plain_path, sha256_of

Encoder = Callable[[list[str]], list[list[float]]]
#: Texts of one call of an encoder; their vectors are lists of Python numbers until Arrow has them.
ENCODED = 512


def hashing_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stand-in for a text encoder: signed word hashes, to unit length."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for text in texts:
            v = np.zeros(dimension)
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                v[h % dimension] += 1 if h & 0x80000000 else -1
            norm = float(np.sqrt((v * v).sum()))
            out.append((v / norm if norm else v).astype("float32").tolist())
        return out

    return encode


def embedded(rows: DataFrame, encoder: Callable[[], Encoder], column: str = "text") -> DataFrame:
    """rows with embedding. encoder() is called once a task, and gets at most ENCODED texts at a time."""
    small_batches(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            for k in range(0, len(texts), ENCODED):
                some = texts.iloc[k : k + ENCODED]
                yield pd.Series(encode(some.fillna("").tolist()), index=some.index)

    # So called, no filter on the vector is pushed below it, where the encoder would run once more.
    return rows.withColumn("embedding", embed.asNondeterministic()(F.col(column)))


def index(store: Store, files: DataFrame, config: IndexConfig, encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """Indexes files (binaryFile rows) into the store; path and status (inserted, updated, skipped, failed) of each.

    Unchanged files are dropped by hash before they are parsed. Files without text are skipped and
    what the store has of them stays; files that can't be read are failed.
    """
    known = store.documents().select(normalize_path(F.col("path")).alias("_p"), "sha256")
    files = files.withColumn("path", plain_path(F.col("path")))
    hashed = files.dropDuplicates(["path"]).withColumn("_p", normalize_path(F.col("path"))).withColumn("sha256", sha256_of(F.col("content")))
    changed = hashed.join(known, ["_p", "sha256"], "left_anti")
    rows = parsed(changed.select("path", "modificationTime", "content"), config.chunk_chars, config.overlap).persist()
    try:
        new = rows.filter("status = 'ok'")
        chunks = new.select("path", "title", F.explode("chunks").alias("c")).select(
            "path", F.col("c.index").alias("chunk_index"), F.col("c.text").alias("text"), F.to_json(F.struct("title", F.col("c.page").alias("page"))).alias("metadata"), F.col("c.page").alias("page")
        )
        dimension = config.dimension
        statuses = store.upsert(new.select("path", "title", "sha256", "mtime", "size"), embedded(chunks, encoder or (lambda: hashing_encoder(dimension))), dimension)
        other = rows.filter("status != 'ok'").select("path", F.when(F.col("status") == "empty", "skipped").otherwise("failed").alias("status"))
        same = hashed.join(known, ["_p", "sha256"], "left_semi").select("path", F.lit("skipped").alias("status"))
        done = statuses.unionByName(other).unionByName(same)
        # Settled here, as what a path's status was compared with is replaced by later commits.
        log = f"{store.root}/_statuses/{store.version()}-{uuid.uuid4().hex[:8]}"
        done.write.mode("overwrite").parquet(log)
        return store.spark.read.schema("path string, status string").parquet(log)
    finally:
        rows.unpersist()


def stats(statuses: DataFrame) -> DataFrame:
    return index_stats(statuses)

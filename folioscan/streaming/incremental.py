"""Incremental indexing: a stream of files, each micro-batch an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.indexer import index
from folioscan.operators.store import Store
from folioscan.schema import IndexConfig

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)


def index_stream(store: Store, folder: str, checkpoint: str, config: IndexConfig, available_now: bool = True) -> StreamingQuery:
    """Indexes what is new in the folder; a restart with the same checkpoint takes up where it ended.

    A batch that is repeated after a failure is harmless: its files are unchanged by then.
    """
    writer = file_stream(store.spark, folder).writeStream.foreachBatch(lambda rows, _: index(store, rows, config).count()).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def upsert_stream(store: Store, rows: DataFrame, chunks_of, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """A stream of documents (path, title, sha256, mtime, size, text) into the store; chunks_of(batch) makes their chunks."""

    def upsert(batch: DataFrame, _: int) -> None:
        store.upsert(batch.select("path", "title", "sha256", "mtime", "size"), chunks_of(batch))

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

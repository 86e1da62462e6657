"""Operator 8, token ids in wavelet files: whole texts to ids, ids to one wavelet matrix a shard, and back.

Documents are range-sorted by id, so each task writes a run of neighbouring documents as files of
about SHARD_TOKENS tokens. A file is a row of a Parquet table in the shared folder: Spark's writer
commits each once, whatever tasks are lost or repeated. shard_bytes() gives a file as it is.

Null text: no tokens but the end id. Null doc_id: ordered first. Ties, rows that share an id: ordered
by text. No rows: no files. Only doc_id and text are read, so further columns don't matter. A task
holds one shard at a time and sorts with spilling, so range partitions may be of any size; texts
longer than a shard make a shard of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, text_of, written

#: Tokens after which a file is closed, at the next document's end.
SHARD_TOKENS = 1 << 20
END_ID = 0

SHARDS = "part int, seq int, start long, n_tokens long, n_docs long, file binary"
DIGESTS = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A table of files: part and seq give their order, start counts the part's tokens before."""
    spark = docs.sparkSession
    small_batches(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def shards(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import encoder, portions
        from .wavelet import build

        encode = encoder(tokenizer).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        docs, lengths, ids, n, seq, start = [], [], [], 0, 0, 0

        def shard(part: int) -> pa.RecordBatch:
            data = build(np.frombuffer(b"".join(ids), dtype="<u4"), docs, np.array(lengths, dtype=np.uint32))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": [start], "n_tokens": [n], "n_docs": [len(docs)], "file": [data]})

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            names, at = batch.column(1).to_pylist(), 0
            for texts in portions(batch.column(2).to_pylist()):
                for encoded in encode(texts):
                    ids.append(encoded + end)
                    docs.append(names[at])
                    lengths.append(len(ids[-1]) // 4)
                    n += lengths[-1]
                    at += 1
                    if n >= shard_tokens:
                        yield shard(part)
                        start, seq = start + n, seq + 1
                        docs, lengths, ids, n = [], [], [], 0
        if docs:
            yield shard(part)

    return written(ordered.mapInArrow(shards, SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """From the files alone: each document's global start, length and the crc32 of its ids with the end id."""
    spark = shards.sparkSession

    def digests(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .wavelet import WaveletMatrix

        for batch in batches:
            for part, start, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                matrix = WaveletMatrix(data)
                ids, lengths = matrix.decode().astype("<u4"), matrix.lengths().astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * s : 4 * (s + k)]) for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(matrix.doc_ids(), pa.int64()), "part": pa.array([part] * len(sums), pa.int32()), "local_start": starts + start, "n_tokens": lengths, "ids_crc32": pa.array(sums, pa.int64())})

    # One row a range partition reaches the driver: as many as there are tasks.
    before, total = {}, 0
    for row in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        before[row["part"]], total = total, total + row["n"]
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    files = shards.select("part", "start", "file")
    return (
        files.mapInArrow(digests, DIGESTS)
        .join(F.broadcast(offsets), "part")
        .select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def shard_bytes(shards: DataFrame, part: int, seq: int) -> bytes | None:
    """One file, for WaveletMatrix."""
    row = shards.filter((F.col("part") == part) & (F.col("seq") == seq)).select("file").head()
    return bytes(row["file"]) if row else None

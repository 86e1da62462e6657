"""Operator 6, best-fit packing of whole texts into sequences of at most CAPACITY tokens.

Each text becomes ids and an end id. A longer document is cut into pieces of CAPACITY tokens, the
rest of the division standing first; a piece of CAPACITY tokens is a sequence of its own.

Bulk-synchronous best fit, on runs. Executors range-sort the pieces by falling length, which gives
each a global position, and count them by length. Pieces of one length, and gaps of one size, are
interchangeable, so supersteps needn't touch rows: one superstep places all pieces of one length. It
sweeps the gaps from the successor of that length, the smallest gap that holds it; where pieces want
one gap, rank decides, the first by position taking the first by number; gaps are updated and the
sweep repeats until all are placed, new sequences being opened where no gap holds them. These sweeps
are a table of at most CAPACITY counts against a list of runs, whatever the number of documents, so
best_fit() runs them on the driver: as Spark jobs they would be thousands of barriers over a few
kilobytes. Executors then place all rows by position, in one pass.

Null text: the end id alone. Null or repeated doc_id: packed like any row. Long texts are encoded
whole and cut. Ties: pieces of one length go by doc_id, piece and checksum. No rows: no sequences.
Only doc_id and text are read, so further columns don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, lean, partitions, small_batches, text_of, written

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row a piece."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokens import encoder, portions

        lean()
        encode = encoder(tokenizer).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for texts in portions(batch.column(1).to_pylist(), 500_000):
                rows = []
                for ids in encode(texts):
                    ids += end
                    n = len(ids) // 4
                    stops = list(range(n % capacity or min(n, capacity), n + 1, capacity))
                    rows += [(names[at], k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip([0, *stops], stops, strict=False))]
                    at += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(pieces, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (first position, past the last, first sequence, offset) for counts of pieces by length.

    Positions number the pieces by falling length. A run's pieces go to consecutive sequences, all
    at one offset.
    """
    out: list[tuple[int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # runs of open sequences by rising gap: gap, from, to
    position = sequences = 0
    for length in sorted(counts, reverse=True):
        first, last = position, position + counts[length]
        position = last
        while first < last:
            at = _successor(gaps, length)
            if at == len(gaps):  # no gap holds these pieces: open sequences, as many as they need alone
                k = -(-(last - first) // (capacity // length))
                insort(gaps, (capacity, sequences, sequences + k))
                sequences += k
                continue
            gap, low, high = gaps.pop(at)
            k = min(last - first, high - low)
            out.append((first, first + k, low, capacity - gap))
            first += k
            if gap > length:
                insort(gaps, (gap - length, low, low + k))
            if low + k < high:
                insort(gaps, (gap, low + k, high))
    return out


def _successor(gaps: list[tuple[int, int, int]], length: int) -> int:
    return bisect_left(gaps, (length,))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    spark = docs.sparkSession
    raw = written(pieces_of(docs, tokenizer, capacity), "pieces")
    ranked = written(
        raw.repartitionByRange(partitions(spark), F.desc("length"), "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id()),
        "ranked",
    )
    dropped(raw)
    # To the driver: a row for each task, and at most CAPACITY lengths.
    parts, before = {}, 0
    for r in ranked.groupBy("part").agg(F.min("row").alias("low"), F.count("*").alias("n")).orderBy("part").collect():
        parts[r["part"]], before = before - r["low"], before + r["n"]
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(best_fit(counts, capacity)), dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(runs)
    shift = spark.createDataFrame(list(parts.items()), "part int, shift long")

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            position = batch.column(5).to_numpy()
            run = table[np.searchsorted(table[:, 0], position, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 2] + position - run[:, 0]), pa.array(run[:, 3])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    rows = ranked.join(F.broadcast(shift), "part").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") + F.col("shift")).alias("position"))
    return rows.mapInArrow(placed, f"{PIECES}, sequence_id long, offset long")

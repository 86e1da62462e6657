"""Operator 12, token counts of whole texts by a transducer that is compiled from the tokenizer's model.

Each task compiles the states that its texts need and reads Arrow batches of texts as chunks, many at
once (see transducer.py); no ids are made. Nothing is shuffled, and a task that is lost is run again.

Null and empty texts: no bytes, no tokens. Null doc_id and repeated rows: one row each, as they come.
Long texts: whole, by portions. No rows: none. Only doc_id and text are read, so further columns,
whatever their names, don't matter. A tokenizer of another kind is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Tokens above which a document is over the limit.
LIMIT = 4096


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of each document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from .transducer import transducer

        counts = transducer(tokenizer).counts
        for batch in batches:
            n_bytes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts(batch.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

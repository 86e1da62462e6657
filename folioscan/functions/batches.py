"""Arrow batches in Python tasks: read row by row and made in bounded pieces, so a worker's memory doesn't grow with the input."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

#: Rows and characters of text that a batch made in Python holds, but for its last row.
ROWS, CHARS = 1024, 1 << 20
#: Rows of a batch that comes from Spark, which also ends it at spark.sql.execution.arrow.maxBytesPerBatch.
INPUT_ROWS = "512"


def small_batches(spark: SparkSession) -> None:
    """Batches of INPUT_ROWS rows unless the session asks for another number than Spark's own 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, INPUT_ROWS)


def values(batches: Iterable) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples; only one row at a time is made into Python values."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(v.as_py() for v in row)


def in_batches(rows: Iterable[tuple], schema, chars: Callable[[tuple], int]) -> Iterator:  # noqa: ANN001
    """Arrow batches of the schema from rows; chars says how much text a row has. A batch is given away before the next row is asked for."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += chars(row)
        if len(held) >= ROWS or size >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

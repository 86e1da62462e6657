"""Tables and settings of an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T



def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_TEXT, _LONG, _INT, _TIME = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
DOCUMENTS = _table(("id", _LONG), ("path", _TEXT), ("title", _TEXT), ("sha256", _TEXT), ("mtime", T.DoubleType()), ("size", _LONG), ("created_at", _TIME), ("updated_at", _TIME))
CHUNKS = _table(("document_id", _LONG), ("chunk_index", _INT), ("text", _TEXT), ("metadata", _TEXT), ("page", _INT), ("embedding", T.ArrayType(T.FloatType())))
#: Counts changes of these tables and of what a commit says; 1 is what had no number.
SCHEMA_NUMBER = 2
DEFAULT_CHUNK_CHARS, DEFAULT_OVERLAP = 500, 50
CONTEXT_CHARS, SMALL_DOCUMENT, WINDOW, MIN_REMAINDER = 16_000, 20, 10, 100


@dataclass(frozen=True)
class IndexConfig:
    root: str
    chunk_chars: int = DEFAULT_CHUNK_CHARS
    overlap: int = DEFAULT_OVERLAP
    dimension: int = 64

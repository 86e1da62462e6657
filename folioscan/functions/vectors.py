"""Vectors as ARRAY<FLOAT>; arithmetic in double."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    """Summed from the first place on, so that results are the same everywhere."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """The zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(doubles(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def from_blob(blob: Column) -> Column:
    """Little-endian float32 bytes to ARRAY<FLOAT>, by an Arrow-batched function."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode(blob)


def to_blob(vector: Column) -> Column:
    import numpy as np

    @F.pandas_udf("binary")
    def encode(data: pd.Series) -> pd.Series:
        return data.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)

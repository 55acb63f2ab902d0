"""Vector arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or either has no direction."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def usable(v: Column) -> Column:
    """All finite, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def checked(v: Column, dimensions: int) -> Column:
    """v, or an error where its length isn't `dimensions`."""
    return F.when(F.size(v) == dimensions, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, got "), F.size(v).cast("string"))).cast("array<double>"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """float32, little endian."""
    import numpy as np

    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(buffers: pd.Series) -> pd.Series:
    import numpy as np

    return buffers.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def upserted(existing, new, dimensions: int, key: str = "id", vector: str = "vector"):
    """existing with all of the new vectors, or an error before anything is written: of another length, null, or of an id that comes twice."""
    from quarry.operators.collections import upserted as put

    wrong = new.filter(F.col(vector).isNull() | (F.size(vector) != dimensions)).select(key, F.size(vector)).limit(1).collect()
    if wrong:
        raise ValueError(f"vector {wrong[0][0]!r}: expected {dimensions} dimensions, got {wrong[0][1]}")
    return put(existing, new, key)

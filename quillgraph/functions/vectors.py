"""Column expressions on dense vectors (``array<float|double>``); sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column, floor: float = 1e-9) -> Column:
    """The vector scaled to length one; ``floor`` bounds the divisor."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)

"""Vector expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if either vector is zero. Norms that are columns already need not be computed again."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def shortened(a: Column, dims: int) -> Column:
    """The first dimensions, at length one (zero stays zero)."""
    head = F.slice(a, 1, dims)
    size = norm(head)
    return F.transform(head, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x.cast("double") / size))

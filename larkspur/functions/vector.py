"""Vectors, ranks and boxes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side has no length or holds null."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def shortened(vector: Column, width: int) -> Column:
    """The first `width` numbers, of unit length; as it is if it has that width; an error if it is shorter."""
    head = F.slice(vector, 1, width)
    size = F.greatest(norm(head), F.lit(1e-12))
    return F.when(F.size(vector) == width, vector).when(F.size(vector) > width, F.transform(head, lambda x: (x / size).cast("float"))).otherwise(F.raise_error(F.lit("the vector is shorter than asked")))


def reciprocal(rank: Column, k: int = 60) -> Column:
    return F.coalesce(F.lit(1.0) / (rank + k), F.lit(0.0))


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of boxes (x0, y0, x1, y1)."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def area(a: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array: the value at round-half-even(p / 100 * (n - 1))."""
    return F.element_at(values, (F.bround(F.lit(p / 100.0) * (F.size(values) - 1), 0)).cast("int") + 1)


def floor_rank(values: Column, p: float) -> Column:
    """Of a sorted array: the value at min(n - 1, floor(p / 100 * n))."""
    return F.element_at(values, F.least(F.size(values) - 1, F.floor(F.lit(p / 100.0) * F.size(values)).cast("int")) + 1)

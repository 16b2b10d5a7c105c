"""Vector functions on array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """To unit length; vectors shorter than EPSILON stay."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n < EPSILON, x.cast("double")).otherwise(x.cast("double") / n))


def mean_pool(rows: Column, mask: Column) -> Column:
    """Mean of an array of vectors over the places where mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: p["r"])
    zeros = F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0))
    sums = F.aggregate(kept, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(sums, lambda x: x / F.greatest(F.size(kept), F.lit(1)))

"""Set and vector expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision, added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set that both have; 0 where one is empty or null."""
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def windows(ids: Column, width: Column, step: Column) -> Column:
    """Sliding windows over an array; the last is the first one that reaches the end."""
    n = F.size(ids)
    last = F.greatest(F.lit(0), F.ceil((n - width) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(ids, (1 + k * step).cast("int"), width.cast("int")))).otherwise(F.array().cast("array<array<bigint>>"))


def min_gap(a: Column, b: Column) -> Column:
    """The least distance between a value of one array and one of the other; null where one is empty."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))

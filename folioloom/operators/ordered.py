"""Numbers, neighbours and running sums inside large groups.

A group may hold a large part of all rows, so it is never sorted as a whole.  Rows fall into
buckets of a numeric leading order value; windows run inside a bucket, and one small row per
bucket carries over what the buckets before or after contribute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"


def _bucketed(frame: DataFrame, lead: Column, width: int) -> DataFrame:
    """A null leading value sorts before all numbers, as in an ascending order."""
    return frame.withColumn(_B, F.coalesce(F.floor(lead / width).cast("bigint"), F.lit(-(1 << 62))))


def numbered(frame: DataFrame, keys: Sequence[str], lead: Column, order: Sequence[Column], name: str, width: int = 4096) -> DataFrame:
    """Rows numbered from 1 within ``keys`` in ``order``, whose first column is ``lead``."""
    rows = _bucketed(frame, lead, width)
    sizes = rows.groupBy(*keys, _B).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(_B).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*order)))
    same = [local[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)] + [local[_B] == starts["_b"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return local.join(starts, condition).withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint")).select(*frame.columns, name)


def with_next(frame: DataFrame, keys: Sequence[str], lead: Column, order: Sequence[Column], columns: Sequence[str], width: int = 4096) -> DataFrame:
    """Rows with ``next``, a struct of ``columns`` of the following row of the group; null for the last."""
    rows = _bucketed(frame, lead, width)
    wanted = F.struct(*columns)
    ordered = rows.select("*", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), wanted.alias("_w"))
    firsts = ordered.groupBy(*keys, _B).agg(F.min_by("_w", "_o").alias("_f"))
    after = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(_B).alias("_b"), F.lead("_f").over(Window.partitionBy(*keys).orderBy(_B)).alias("_next_bucket"))
    local = ordered.withColumn("_next_row", F.lead("_w").over(Window.partitionBy(*keys, _B).orderBy("_o")))
    condition = local[_B] == after["_b"]
    for i, k in enumerate(keys):
        condition = condition & local[k].eqNullSafe(after[f"_k{i}"])
    return local.join(after, condition).withColumn("next", F.coalesce("_next_row", "_next_bucket")).select(*frame.columns, "next")

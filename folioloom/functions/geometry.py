"""Boxes as structs of four doubles, and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(values: Column) -> Column:
    """The first four numbers of an array as a box with ordered corners; null where there are fewer."""
    x1, y1, x2, y2 = (F.get(values, i).cast("double") for i in range(4))
    whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(whole, F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2")))


def union(a: Column, b: Column) -> Column:
    """The smallest box around both; a null box adds nothing."""
    both = F.struct(*[f(a[n], b[n]).alias(n) for f, n in ((F.least, "x1"), (F.least, "y1"), (F.greatest, "x2"), (F.greatest, "y2"))])
    return F.when(a.isNotNull() | b.isNotNull(), both)


def expand(b: Column, by: float) -> Column:
    return F.when(b.isNotNull(), F.struct((b["x1"] - by).alias("x1"), (b["y1"] - by).alias("y1"), (b["x2"] + by).alias("x2"), (b["y2"] + by).alias("y2")))


def clip(b: Column, width: Column, height: Column) -> Column:
    """The box inside a page; an unknown page side doesn't limit it."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return F.when(b.isNotNull(), F.struct(*[inside(b[n], (width if n[0] == "x" else height).cast("double")).alias(n) for n in ("x1", "y1", "x2", "y2")]))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The shared horizontal extent in relation to the narrower box."""
    shared = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    return shared / F.greatest(F.lit(1.0), F.least(a["x2"] - a["x1"], b["x2"] - b["x1"]))


def as_array(b: Column) -> Column:
    return F.when(b.isNotNull(), F.array(b["x1"], b["y1"], b["x2"], b["y2"]))


def height_at_width(width: Column, height: Column, target: Column) -> Column:
    """The height of an image brought to a width, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(height * (target / width)).cast("int"))


def fitted(width: Column, height: Column, most: int, least: int) -> Column:
    """The size of an image brought into a pixel budget.

    A change under one percent is not made.  The scaled size is floored, so it keeps within the
    budget except where a side is below 1; then the other side gives way.
    """
    pixels = (width * height).cast("double")
    scale = F.when(pixels > most, F.sqrt(F.lit(float(most)) / pixels)).when(pixels < least, F.sqrt(F.lit(float(least)) / pixels)).otherwise(F.lit(1.0))
    w, h = (F.greatest(F.lit(1), F.floor(side * scale).cast("int")) for side in (width, height))
    over = w * h > most
    narrower = F.greatest(F.lit(1), w - 1)
    w2, h2 = F.when(over, narrower).otherwise(w), F.when(over, F.greatest(F.lit(1), F.floor(F.lit(most) / narrower).cast("int"))).otherwise(h)
    same = F.abs(scale - 1) < 0.01
    return F.struct(F.when(same, width).otherwise(w2).cast("int").alias("width"), F.when(same, height).otherwise(h2).cast("int").alias("height"))

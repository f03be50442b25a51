"""Table and image assets: their titles, crops, numbers and file names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import geometry, text
from folioloom.operators.blocks import reading_key
from folioloom.operators.ordered import numbered

# fixed values: labels of each kind of asset
KINDS = {"table": ("table",), "image": ("image", "chart")}
# fixed value: stands for a missing title in file names
DEFAULT_TITLE = "defaulttitle"


def is_title(label: Column, extra: Iterable[str] = ()) -> Column:
    return label.endswith("_title") | (label.isin(*extra) if tuple(extra) else F.lit(False))


def assets_of(blocks: DataFrame, kind: str = "table") -> DataFrame:
    """Blocks of one kind with a box, numbered from 1 within their document."""
    chosen = blocks.where(F.col("label").isin(*KINDS[kind]) & F.col("box").isNotNull())
    kinds = chosen.withColumn("asset_kind", F.lit(kind))
    return numbered(kinds, ["document_id"], F.col("page_index"), [F.col("page_index"), *reading_key()], "asset_index", width=256).withColumn("asset_index", F.col("asset_index").cast("int"))


def nearest_title(assets: DataFrame, blocks: DataFrame, most_distance: float | None = 160.0, least_overlap: float = 0.15, title_labels: Iterable[str] = ()) -> DataFrame:
    """Every asset with the title of its page that stands nearest: above before below.

    A title has a title's label, one of ``title_labels``, or a key that says so (``has_title``).
    Candidates share the page and overlap horizontally.  The nearest wins; among equals the one
    whose edge is closer to the asset, then the earlier block.  An untitled asset stays with nulls.
    """
    told = F.col("has_title") if "has_title" in blocks.columns else F.lit(False)
    titles = blocks.where((is_title(F.col("label"), title_labels) | told) & F.col("box").isNotNull()).select("document_id", "page_index", F.col("block_key").alias("title_key"), F.col("content").alias("title"), F.col("label").alias("title_label"), F.col("box").alias("title_box"))
    pairs = assets.select("block_key", "document_id", "page_index", "box").join(titles, ["document_id", "page_index"]).where(F.col("block_key") != F.col("title_key"))
    middle = lambda b: (F.col(f"{b}.y1") + F.col(f"{b}.y2")) / 2
    above, below = middle("title_box") < middle("box"), middle("title_box") > middle("box")
    gap = F.greatest(F.lit(0.0), F.when(above, F.col("box.y1") - F.col("title_box.y2")).otherwise(F.col("title_box.y1") - F.col("box.y2")))
    near = pairs.where(above | below).where(geometry.overlap_ratio(F.col("box"), F.col("title_box")) >= least_overlap).withColumn("side", F.when(above, 0).otherwise(1)).withColumn("distance", gap)
    if most_distance is not None:
        near = near.where(F.col("distance") <= most_distance)
    edge = F.when(F.col("side") == 0, -F.col("title_box.y2")).otherwise(F.col("title_box.y1"))
    best = near.groupBy("document_id", "block_key").agg(F.min_by(F.struct("title_key", "title", "title_label", "title_box", "distance"), F.struct("side", "distance", edge.alias("edge"), "title_key")).alias("t"))
    return assets.join(best.select("document_id", "block_key", "t.*"), ["document_id", "block_key"], "left")


def crops(titled: DataFrame, pages: DataFrame, padding: float = 8.0) -> DataFrame:
    """The rectangle to cut for every asset: asset and title, padded, inside the page."""
    sizes = pages.groupBy("document_id", "page_index").agg(F.max_by("width", F.struct("landed_at", "width")).alias("width"), F.max_by("height", F.struct("landed_at", "height")).alias("height"))
    joined = titled.join(sizes, ["document_id", "page_index"])
    return joined.withColumn("crop", geometry.clip(geometry.expand(geometry.union(F.col("box"), F.col("title_box")), padding), F.col("width"), F.col("height")))


def manifest(cropped: DataFrame) -> DataFrame:
    """The asset manifest: one row per asset in the order of its number."""
    title = F.coalesce(text.collapse(F.col("title")), F.lit(DEFAULT_TITLE))
    name = F.format_string("%s_%04d_page_%04d_%s.png", F.col("asset_kind"), F.col("asset_index"), (F.col("page_index") + 1).cast("int"), text.slug(title))
    return cropped.select(
        "document_id", "asset_kind", "asset_index", F.col("label").alias("asset_label"), name.alias("filename"),
        (F.col("page_index") + 1).alias("page"), geometry.as_array(F.col("box")).alias("bbox"), title.alias("title"), "title_label",
        geometry.as_array(F.col("title_box")).alias("title_bbox"), geometry.as_array(F.col("crop")).alias("crop_bbox"),
    )

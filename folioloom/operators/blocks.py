"""From OCR blocks to text: fields, filters, reading order and Markdown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import geometry, text

# fixed values: labels whose blocks are no running text
DROP_LABELS = ("table", "chart", "image", "seal", "formula")
#: Stands for a missing order key; such blocks come last.
LAST = 1_000_000


def fields(blocks: DataFrame) -> DataFrame:
    """Every block with its normalised label, content and box; a filing-wide block id and ``has_title`` are optional."""
    titled = [F.coalesce("has_title", F.lit(False)).alias("has_title")] if "has_title" in blocks.columns else []
    wide = F.col("global_block_id") if "global_block_id" in blocks.columns else F.lit(None)
    return blocks.select(
        "block_key", "document_id", "page_index", "block_id", "block_order", wide.cast("bigint").alias("global_block_id"),
        text.label(F.col("block_label")).alias("label"),
        F.coalesce(text.trimmed_lines(text.unescape(F.col("block_content"))), F.lit("")).alias("content"),
        geometry.box(F.col("block_bbox")).alias("box"), *titled,
    )


def keeps(label: Column, content: Column, keep: Iterable[str] | None = None, drop: Iterable[str] = ()) -> Column:
    """Whether a block belongs to the text: a keep set decides alone, else the drop set and ``image`` labels."""
    filled = content != ""
    if keep is not None:
        return filled & label.isin(*[k.strip().lower() for k in keep])
    return filled & ~label.isin(*DROP_LABELS, *[d.strip().lower() for d in drop]) & ~F.contains(label, F.lit("image"))


def with_labels(blocks: DataFrame, labels: Iterable[str]) -> DataFrame:
    return blocks.where(F.col("label").isin(*[x.strip().lower() for x in labels]))


def label_counts(blocks: DataFrame) -> DataFrame:
    """(label, kept, dropped) over all blocks."""
    kept = keeps(F.col("label"), F.col("content"))
    name = F.when(F.col("label") == "", F.lit("<missing>")).otherwise(F.col("label"))
    return blocks.groupBy(name.alias("label")).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))


def reading_key() -> list[Column]:
    """Columns that put the blocks of a page into reading order: order, filing-wide id, top, left, id.

    A missing number comes last, a missing box counts as the page's corner; ties keep the input's order.
    """
    far, corner = F.lit(LAST).cast("double"), F.lit(0.0)
    numbers = [F.coalesce(F.col(c).cast("double"), far) for c in ("block_order", "global_block_id", "block_id")]
    return [numbers[0], numbers[1], F.coalesce(F.col("box.y1"), corner), F.coalesce(F.col("box.x1"), corner), numbers[2], F.col("block_key").cast("bigint")]


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks numbered from 1 within their page."""
    order = Window.partitionBy("document_id", "page_index").orderBy(*reading_key())
    return blocks.withColumn("position", F.row_number().over(order))


def markdown(blocks: DataFrame) -> DataFrame:
    """(document_id, page_index, markdown, blocks): the kept blocks of every page in reading order."""
    kept = blocks.where(keeps(F.col("label"), F.col("content")))
    part = F.struct(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(reading_key())]).alias("key"), text.heading_line(F.col("label"), F.col("content")).alias("part"))
    grouped = kept.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("document_id", "page_index", F.concat(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"), F.lit("\n")).alias("markdown"), F.size("parts").alias("blocks"))

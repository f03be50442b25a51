"""OCR results in JSON: pages, blocks and the layout fallback.

Files are read whole and parsed to VARIANT, which keeps a key that is present with null apart from a
key that is absent: the primary key decides where it is present, an alias only where it is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of a block's box, the first that holds something counts
BOX_KEYS = ("block_bbox", "bbox", "coordinate", "box")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, v): every JSON file below ``path``; a file that is no JSON has a null ``v``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))


def _text(v: str, key: str, alias: str) -> Column:
    """A text value: of ``key`` where present (null gives the empty text), else of ``alias``."""
    first, second = F.try_variant_get(v, f"$.{key}", "variant"), F.try_variant_get(v, f"$.{alias}", "string")
    own = F.when(F.is_variant_null(first), F.lit("")).otherwise(F.try_variant_get(v, f"$.{key}", "string"))
    return F.coalesce(F.when(first.isNotNull(), F.coalesce(own, F.lit(""))).otherwise(second), F.lit(""))


def _box(v: str) -> Column:
    arrays = [F.try_variant_get(v, f"$.{key}", "array<double>") for key in BOX_KEYS]
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def page_number(file: Column) -> Column:
    """The index in a file name ``page_<n>``: the number less one, at least 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.expr("try_cast(regexp_extract(file, 'page_(\\\\d+)[^/]*$', 1) AS bigint)") - 1)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_index, page_count, width, height) of every page file."""
    d = _documents(spark, path).where(F.col("v").isNotNull())
    get = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    return d.select("file", F.coalesce(get("page_index", "bigint"), page_number(F.col("file")), F.lit(0)).alias("page_index"), get("page_count", "bigint").alias("page_count"), get("width", "double").alias("width"), get("height", "double").alias("height"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_index, position, block_label, block_content, block_bbox, block_order, global_block_id, block_id, has_title).

    Blocks come from ``parsing_res_list``, or from the top level where that is a list; items that are
    no objects are left out.  ``has_title`` tells whether some key of the block ends in ``_title`` and
    holds something.
    """
    d = _documents(spark, path).where(F.col("v").isNotNull())
    listed = d.select("file", F.coalesce(F.try_variant_get("v", "$.page_index", "bigint"), page_number(F.col("file")), F.lit(0)).alias("page_index"), F.coalesce(F.try_variant_get("v", "$.parsing_res_list", "array<variant>"), F.try_variant_get("v", "$", "array<variant>")).alias("items"))
    each = listed.select("file", "page_index", F.posexplode("items").alias("position", "b")).where(F.schema_of_variant("b").startswith("OBJECT"))
    get = lambda key, kind: F.try_variant_get("b", f"$.{key}", kind)
    keys = F.map_filter(F.try_variant_get("b", "$", "map<string,string>"), lambda k, v: F.lower(k).endswith("_title") & v.isNotNull() & ~v.isin("", "false", "0", "[]", "{}"))
    return each.select(
        "file", "page_index", "position", _text("b", "block_label", "label").alias("block_label"), _text("b", "block_content", "content").alias("block_content"),
        _box("b").alias("block_bbox"), F.when(F.try_variant_get("b", "$.block_order", "variant").isNotNull(), get("block_order", "bigint")).otherwise(get("order", "bigint")).alias("block_order"),
        get("global_block_id", "bigint").alias("global_block_id"), get("block_id", "bigint").alias("block_id"), (F.coalesce(F.size(keys), F.lit(0)) > 0).alias("has_title"),
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The same blocks from ``layout_det_res`` lists: boxes without content, one page per list item.

    A page file holds an object there, which gives no rows.
    """
    d = _documents(spark, path).where(F.col("v").isNotNull())
    pages = d.select("file", F.posexplode(F.try_variant_get("v", "$.layout_det_res", "array<variant>")).alias("page_index", "p"))
    each = pages.select("file", F.col("page_index").cast("bigint").alias("page_index"), F.posexplode(F.try_variant_get("p", "$.boxes", "array<variant>")).alias("position", "b"))
    return each.select("file", "page_index", "position", F.coalesce(F.try_variant_get("b", "$.label", "string"), F.lit("")).alias("block_label"), F.lit("").alias("block_content"), F.try_variant_get("b", "$.coordinate", "array<double>").alias("block_bbox"), F.try_variant_get("b", "$.order", "bigint").alias("block_order"), F.lit(None).cast("bigint").alias("global_block_id"), F.col("position").cast("bigint").alias("block_id"), F.lit(False).alias("has_title"))


def with_document(frame: DataFrame) -> DataFrame:
    """The document id from the folder of a page file, or from the stem of a document file."""
    folder = F.regexp_extract("file", r"([^/]+)/page_\d+[^/]*$", 1)
    stem = F.regexp_extract("file", r"([^/]+?)(?:_res)?\.[^./]+$", 1)
    return frame.withColumn("document_id", F.when(folder != "", folder).otherwise(stem))

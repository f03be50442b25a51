"""Evidence packages: contexts, ids, rendering, prompts and montage layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import geometry, text

# fixed values: letters of evidence ids by modality
PREFIX = {"text": "E", "table": "T", "image": "I"}
# fixed values: montage profiles
TABLE_LAYOUT = {"layout": "vertical", "width": 1400, "columns": 1}
IMAGE_LAYOUT = {"layout": "grid", "width": 900, "columns": 2}
# fixed values: kinds of image files
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}
PIXELS = (200_704, 1_003_520)
TEMPLATE = "Question: {query}\n\nText evidence:\n{text_evidence}\n\nTable evidence:\n{table_evidence}\n\nImage evidence:\n{image_evidence}"


def normalise(contexts: DataFrame) -> DataFrame:
    """Contexts with modality in lower case, the first crop path present, and summary from content."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    out = contexts.withColumn("modality", F.lower(F.trim("modality"))).withColumn("summary", F.coalesce(filled("summary"), F.col("content")))
    paths = [c for c in ("crop_path", "asset_path", "image_path") if c in contexts.columns]
    return out.withColumn("crop_path", F.coalesce(*[filled(c) for c in paths])) if paths else out


def with_ids(contexts: DataFrame, *order: str) -> DataFrame:
    """Contexts with ``evidence_id``: a letter and the place within query and modality."""
    place = F.row_number().over(Window.partitionBy("query_id", "modality").orderBy(*order))
    prefix = F.create_map(*[F.lit(x) for p in PREFIX.items() for x in p])[F.col("modality")]
    return contexts.withColumn("place", place).withColumn("evidence_id", F.concat(prefix, place.cast("string")))


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))


def location(page: Column, bbox: Column, page_span: Column | None = None) -> Column:
    """Where a context stands: its page, page span and box, or the empty text."""
    span = F.when(F.size(page_span) > 0, F.concat(F.lit("page_span "), _list(page_span))) if page_span is not None else F.lit(None).cast("string")
    return F.concat_ws(", ", F.when(page != 0, F.concat(F.lit("page "), page.cast("string"))), span, F.when(F.size(bbox) > 0, F.concat(F.lit("bbox "), _list(bbox))))


def rendered(most: int = 1200, spans: bool = False) -> Column:
    """One context as lines: id, location, score, title, summary where it differs, content."""
    where = location(F.col("page"), F.col("bbox"), F.col("page_span") if spans else None)
    title, summary, content = text.compact(F.col("title"), 240), text.compact(F.col("summary"), most), text.compact(F.col("content"), most)
    body = F.concat_ws(
        "\n",
        F.when(where != "", F.concat(F.lit("Location: "), where)),
        F.when(F.col("score").isNotNull(), F.concat(F.lit("Score: "), F.col("score").cast("string"))),
        F.when(title != "", F.concat(F.lit("Title: "), title)),
        F.when((summary != "") & (summary != content), F.concat(F.lit("Summary: "), summary)),
        F.when(content != "", F.concat(F.lit("Content: "), content)),
    )
    return F.concat(F.lit("["), F.col("evidence_id"), F.lit("]\n"), F.when(body == "", F.lit("Content: None.")).otherwise(body))


def prompts(queries: DataFrame, contexts: DataFrame, template: str = TEMPLATE, most: int = 1200) -> DataFrame:
    """(query_id, prompt): the template with the query and its evidence; ``None.`` where there is none."""
    lines = contexts.select("query_id", "modality", "place", rendered(most, "page_span" in contexts.columns).alias("line"))
    parts = lines.groupBy("query_id").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("modality") == m, F.struct("place", "line")))), lambda x: x["line"]), "\n\n").alias(m) for m in PREFIX])
    joined = queries.join(parts, "query_id", "left")
    slots = {"query": F.coalesce(F.col("query"), F.lit(""))} | {f"{m}_evidence": F.coalesce(F.nullif(F.col(m), F.lit("")), F.lit("None.")) for m in PREFIX}
    # one pass over the template, so that braces inside evidence stay as they are
    pieces, rest = [], template
    while rest:
        at = min((rest.find("{" + s + "}") for s in slots if "{" + s + "}" in rest), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        pieces += [F.lit(rest[:at]), slots[name]]
        rest = rest[at + len(name) + 2 :]
    return joined.select("query_id", F.concat(*pieces).alias("prompt"))


def packages(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, query, texts, tables, images, package): one nested package per query as JSON."""
    item = F.struct("place", F.struct("evidence_id", "id", "page", "score", "title", "summary", "content").alias("c"))
    groups = contexts.groupBy("query_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("modality") == m, item))), lambda x: x["c"]).alias(m) for m in PREFIX])
    joined = queries.join(groups, "query_id", "left")
    sizes = [F.coalesce(F.size(m), F.lit(0)) for m in PREFIX]
    sizes = [F.when(s < 0, 0).otherwise(s).alias(n) for s, n in zip(sizes, ("texts", "tables", "images"))]
    return joined.select("query_id", "query", *sizes, F.to_json(F.struct("query_id", "query", F.struct(*PREFIX).alias("contexts_by_modality"))).alias("package"))


def montage_sources(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """Table and image contexts whose crop is among the files that are there (``path``)."""
    return contexts.where(F.col("modality").isin("table", "image") & F.col("crop_path").isNotNull()).join(files.select(F.col("path").alias("crop_path")).distinct(), "crop_path", "left_semi")


def montage_paths(sources: DataFrame, folder: str, document: Column, query: Column) -> DataFrame:
    """(query_id, paths): the montage files of every query, tables before images; only kinds with a source have one."""
    kinds = sources.select("query_id", "modality", F.concat(F.lit(folder.rstrip("/") + "/"), montage_name(document, F.col("modality"), query)).alias("path")).distinct()
    return kinds.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("modality", "path")), asc=False), lambda x: x["path"]).alias("paths"))


def data_url(path: Column, content: Column) -> Column:
    """Image bytes as a data address; the kind follows the file name, PNG where it tells nothing."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in MIME.items() for x in p])[ending], F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def endpoint(base: str) -> str:
    """The address of chat completions below a service's base address."""
    bare = base.rstrip("/")
    return bare if bare.endswith("/chat/completions") else f"{bare}/chat/completions"


def label(evidence_id: Column, page: Column, title: Column, key: Column) -> Column:
    """The line above an image in a montage."""
    name = F.substring(F.trim(F.coalesce(F.nullif(title, F.lit("")), key, F.lit(""))), 1, 90)
    return F.concat_ws(" | ", F.nullif(evidence_id, F.lit("")), F.when(page != 0, F.concat(F.lit("page "), page.cast("string"))), F.nullif(name, F.lit("")))


def montages(images: DataFrame, layout: dict, padding: int = 24, label_height: int = 48, pixels: tuple[int, int] = PIXELS) -> DataFrame:
    """(query_id, cells, raw_width, raw_height, width, height) of the montage of each query's images.

    ``images`` is (query_id, place, width, height).  A vertical layout stacks all cells, a grid puts
    ``columns`` in a row, each row as high as its highest cell.
    """
    cell = geometry.height_at_width(F.col("width"), F.col("height"), F.lit(layout["width"])) + label_height
    columns = 1 if layout["layout"] == "vertical" else max(1, layout["columns"])
    rows = images.select("query_id", F.floor((F.col("place") - 1) / columns).alias("row"), cell.alias("cell")).groupBy("query_id", "row").agg(F.max("cell").alias("row_height"), F.count("*").alias("n"))
    sums = rows.groupBy("query_id").agg(F.sum("n").alias("cells"), (F.lit(padding) + F.sum("row_height") + padding * F.count("*")).cast("int").alias("raw_height"))
    sized = sums.withColumn("raw_width", F.lit(padding + columns * (layout["width"] + padding)))
    fit = geometry.fitted(F.col("raw_width"), F.col("raw_height"), pixels[1], pixels[0])
    return sized.withColumn("fit", fit).select("query_id", "cells", "raw_width", "raw_height", "fit.width", "fit.height")


def montage_name(document: Column, kind: Column, query: Column, extension: str = "jpg") -> Column:
    return F.concat(text.safe_name(document), F.lit("_"), kind, F.lit("_montage_"), text.query_key(query), F.lit(f".{extension}"))

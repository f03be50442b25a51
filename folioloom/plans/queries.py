"""Every core operator as a query over the tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import arrays, geometry, text
from folioloom.operators import assets, blocks, catalog, chunks, enrichment, evidence, merging, records, sentences, vectors
from folioloom.operators.ordered import numbered
from folioloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Thresholds of the test vectors, whose scores are lower than those of a language model.
THRESHOLDS = {"text": 0.2, "table": 0.2, "image": 0.2}
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.fields(table(spark, d, "ocr_blocks"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_pages")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.current(table(spark, d, "chunks"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.current(table(spark, d, "sentences"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and sliding windows of the same filings, which overlap and contain each other."""
    held = _chunks(spark, d).select("document_id", F.concat("document_id", F.lit("/"), "chunk_id").alias("chunk_key"), "chunk_id", "ids")
    slid = sentences.windows(_sentences(spark, d)).select("document_id", F.concat("document_id", F.lit("/w"), "block_id").alias("chunk_key"), F.concat(F.lit("w"), "block_id").alias("chunk_id"), F.col("sentence_ids").alias("ids"))
    return held.unionByName(slid)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("label") % 3 + 1).cast("int"))
    return rows.select("vec_id", kind.alias("modality"), "embedding"), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


# blocks and pages


@query
def block_fields(spark, d):
    b = _blocks(spark, d)
    return b.select("block_key", "label", "content", F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"), F.col("box.x2").alias("x2"), F.col("box.y2").alias("y2"))


@query
def block_filter(spark, d):
    b = _blocks(spark, d)
    return b.where(blocks.keeps(F.col("label"), F.col("content"))).select("block_key", "label")


@query
def block_filter_keep_set(spark, d):
    b = _blocks(spark, d)
    return b.where(blocks.keeps(F.col("label"), F.col("content"), keep=("doc_title", "paragraph_title", "Table "))).select("block_key", "label")


@query
def label_filter(spark, d):
    return blocks.with_labels(_blocks(spark, d), ("TABLE", "figure_title")).select("block_key", "label")


@query
def block_label_counts(spark, d):
    return blocks.label_counts(_blocks(spark, d))


@query
def reading_order(spark, d):
    return blocks.reading_order(_blocks(spark, d)).select("block_key", "position")


@query
def text_markdown(spark, d):
    return blocks.markdown(_blocks(spark, d))


@query
def page_index(spark, d):
    """The page index, else the number in a file name minus one, else 0."""
    p = _pages(spark, d)
    stem = F.concat(F.lit("page_"), F.lpad((F.col("page_index") + 1).cast("string"), 4, "0"))
    named = F.greatest(F.lit(0), F.expr("try_cast(regexp_extract(stem, 'page_(\\\\d+)', 1) AS bigint)") - 1)
    even = F.when(F.col("page_index") % 2 == 0, F.col("page_index"))
    return p.withColumn("stem", stem).select("document_id", "landed_at", F.col("page_index").alias("given"), F.coalesce(even, named, F.lit(0)).alias("page_index"))


@query
def latest_pages(spark, d):
    """The last parse of every page."""
    p = _pages(spark, d).select("document_id", "page_index", "source", "page_count", "width", "height", "landed_at")
    return catalog.latest(p, ["document_id", "page_index"], ["landed_at"])


# boxes and assets


@query
def box_ops(spark, d):
    b = _blocks(spark, d).where(F.col("box").isNotNull())
    grown = geometry.clip(geometry.expand(F.col("box"), 8.0), F.lit(1224.0), F.lit(1584.0))
    return b.select("block_key", geometry.as_array(grown).alias("grown"))


@query
def page_boxes(spark, d):
    """The box around all blocks of a page."""
    b = _blocks(spark, d)
    return b.where(F.col("box").isNotNull()).groupBy("document_id", "page_index").agg(F.min("box.x1").alias("x1"), F.min("box.y1").alias("y1"), F.max("box.x2").alias("x2"), F.max("box.y2").alias("y2"))


@query
def box_overlap(spark, d):
    """How far each block overlaps the next one of its page horizontally."""
    b = _blocks(spark, d).where(F.col("box").isNotNull())
    order = Window.partitionBy("document_id", "page_index").orderBy("block_id", "block_key")  # a page is small
    nxt = b.withColumn("next", F.lead("box").over(order)).where("next IS NOT NULL")
    return nxt.select("block_key", F.round(geometry.overlap_ratio(F.col("box"), F.col("next")), 9).alias("ratio"))


@query
def title_blocks(spark, d):
    return _blocks(spark, d).where(assets.is_title(F.col("label"), ("header",))).select("block_key", "label")


def _titled(spark, d):
    b = _blocks(spark, d)
    return assets.nearest_title(assets.assets_of(b), b)


@query
def nearest_title(spark, d):
    return _titled(spark, d).select("block_key", "title_key", "distance")


@query
def asset_numbering(spark, d):
    return assets.assets_of(_blocks(spark, d)).select("block_key", "asset_index")


@query
def crop_rect(spark, d):
    return assets.crops(_titled(spark, d), _pages(spark, d)).select("block_key", geometry.as_array(F.col("crop")).alias("crop"))


def _manifest(spark, d):
    return assets.manifest(assets.crops(_titled(spark, d), _pages(spark, d)))


@query
def asset_manifest(spark, d):
    return _manifest(spark, d)


@query
def asset_slug(spark, d):
    return _blocks(spark, d).where(assets.is_title(F.col("label"))).select("block_key", text.slug(F.col("content")).alias("slug"), text.safe_name(F.col("content")).alias("safe"))


# text


@query
def whitespace_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("text"))


@query
def html_unescape(spark, d):
    return table(spark, d, "ocr_blocks").where("block_content IS NOT NULL").select("block_key", text.unescape(F.col("block_content")).alias("content"))


@query
def trimmed_lines(spark, d):
    return table(spark, d, "ocr_blocks").where("block_content IS NOT NULL").select("block_key", text.trimmed_lines(F.col("block_content")).alias("content"))


@query
def paragraph_split(spark, d):
    return sentences.paragraphs(table(spark, d, "documents")).select("doc_id", "paragraph_no", "paragraph")


@query
def heading_strip(spark, d):
    return sentences.paragraphs(table(spark, d, "documents")).where("heading <> ''").select("doc_id", "paragraph_no", "heading")


@query
def sentence_split(spark, d):
    return sentences.split(table(spark, d, "documents"))


@query
def page_sentences(spark, d):
    """Sentences of every filing, page by page, numbered through the filing."""
    pages = blocks.markdown(_blocks(spark, d))
    each = sentences.split(pages.withColumn("page", F.struct("document_id", "page_index")), key="page", column="markdown").select("page.document_id", "page.page_index", "sentence_id", "sentence")
    order = [F.col("page_index"), F.col("sentence_id")]
    return numbered(each, ["document_id"], F.col("page_index"), order, "n", width=64).select("document_id", "page_index", (F.col("n") - 1).alias("sentence_id"), "sentence")


@query
def sentence_items(spark, d):
    return _sentences(spark, d)


@query
def short_answer_reasons(spark, d):
    r = table(spark, d, "query_summaries").where("generated_answer IS NOT NULL")
    return r.select("run_id", text.short_answer_reasons(F.col("generated_answer")).alias("reasons"))


@query
def token_count(spark, d):
    return table(spark, d, "chunks").select("chunk_key", text.word_count(F.col("text")).alias("words"))


@query
def compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compact(F.col("text"), 120).alias("text"))


@query
def record_hashes(spark, d):
    r = table(spark, d, "query_summaries")
    return r.select("run_id", F.md5(F.coalesce("query", F.lit(""))).alias("hash"), text.query_key(F.col("query")).alias("query_key"), evidence.montage_name(F.col("document_id"), F.lit("table"), F.col("query")).alias("montage_name"))


@query
def document_names(spark, d):
    p = _pages(spark, d).select("input_path").distinct()
    stem = F.regexp_extract("input_path", r"([^/]+)\.[^./]+$", 1)
    return p.select("input_path", text.document_name(F.concat(stem, F.lit("_text"))).alias("name"))


# windows and breakpoints


@query
def sliding_windows(spark, d):
    return sentences.windows(_sentences(spark, d))


@query
def config_windows(spark, d):
    """The first windows of 13 sentences under every chunking configuration."""
    c = table(spark, d, "chunking_configs")
    step = F.coalesce("step_size", F.col("window_size") - F.col("overlap"))
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(12).cast("bigint"))
    return c.select("config_id", F.posexplode(arrays.windows(ids, F.col("window_size"), step)).alias("block_id", "ids"))


@query
def config_sentence_windows(spark, d):
    """The windows of all sentences of every filing under every chunking configuration."""
    return sentences.config_windows(_sentences(spark, d), table(spark, d, "chunking_configs"))


def _distances(spark, d):
    return sentences.neighbour_distances(table(spark, d, "embeddings"), "label", "vec_id")


@query
def adjacent_distance(spark, d):
    return _distances(spark, d).select("label", "vec_id", F.round("distance", 9).alias("distance"))


@query
def percentile_breaks(spark, d):
    rounded = _distances(spark, d).withColumn("distance", F.round("distance", 9))
    return sentences.breakpoints(rounded, "label", "vec_id", 95.0).select("label", "block_id", "vec_id", F.round("threshold", 11).alias("threshold"), "segment")


# chunks


@query
def chunk_text(spark, d):
    return chunks.texts(_chunks(spark, d), _sentences(spark, d))


@query
def page_span(spark, d):
    built = chunks.texts(_chunks(spark, d), _sentences(spark, d))
    return built.select("chunk_key", F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"))


@query
def chunk_order(spark, d):
    return chunks.placed(_chunks(spark, d)).select("chunk_key", "place")


@query
def chunk_overlap_pairs(spark, d):
    return chunks.overlapping(_pieces(spark, d), 0.5)


@query
def duplicate_overlap(spark, d):
    return chunks.overlapping(_pieces(spark, d), 0.8)


@query
def chunk_containment(spark, d):
    return chunks.contained(_pieces(spark, d))


@query
def containment_cleanup(spark, d):
    return chunks.cleaned(_pieces(spark, d))


@query
def prev_continuation(spark, d):
    return chunks.previous(_pieces(spark, d))


@query
def position_reasons(spark, d):
    return chunks.neighbours(_chunks(spark, d))


@query
def validate_chunks(spark, d):
    return chunks.validation(_pieces(spark, d))


@query
def provenance_union(spark, d):
    return chunks.provenance(_chunks(spark, d))


def _merged(spark, d):
    """Chunks, sliding windows and short single sentences of the same filings, so that every phase has work."""
    held = _chunks(spark, d).select("document_id", "chunk_id", "ids", "page_span")
    s = _sentences(spark, d)
    none = F.lit(None).cast("array<int>").alias("page_span")
    slid = sentences.windows(s).select("document_id", F.concat(F.lit("w"), "block_id").alias("chunk_id"), F.col("sentence_ids").alias("ids"), none)
    short = s.where(F.size(text.short_answer_reasons(F.col("text"))) > 0).select("document_id", F.concat(F.lit("s"), "sentence_id").alias("chunk_id"), F.array("sentence_id").alias("ids"), none)
    return merging.merge(held.unionByName(slid).unionByName(short), s, merging.Settings(similarity=0.5))


@query
def merge_pipeline(spark, d):
    return _merged(spark, d).where("kind = 'chunk'").select("document_id", "segment", "key", "ids", "sources")


@query
def merge_phase_counts(spark, d):
    return _merged(spark, d).where("kind = 'event'").groupBy("phase").agg(F.count("*").alias("merges"))


# assets and their descriptions


def _outputs(spark, d):
    """A placeholder output for every batch of five tables: the last asset missing, one name twice, one unknown."""
    batch = F.floor((F.col("asset_index") - 1) / 5).alias("batch_no")
    files = _manifest(spark, d).groupBy("document_id", batch).agg(F.array_sort(F.collect_list("filename")).alias("expected"))
    given = F.concat(F.slice("expected", 1, F.greatest(F.lit(1), F.size("expected") - 1)), F.slice("expected", 1, 1), F.array(F.lit("unknown.png")))
    return files.select("document_id", "batch_no", "expected", enrichment.dry_run(given).alias("output"))


@query
def dry_run_enrichment(spark, d):
    return _outputs(spark, d)


@query
def enrichment_parse(spark, d):
    return enrichment.parse(_outputs(spark, d), "document_id", "batch_no")


@query
def enrichment_missing(spark, d):
    o = _outputs(spark, d)
    return enrichment.accounting(o, enrichment.parse(o, "document_id", "batch_no"), "document_id", "batch_no")


@query
def enrichment_join(spark, d):
    items = enrichment.parse(_outputs(spark, d), "document_id", "batch_no").where("status = 'item'")
    enriched = items.select("document_id", F.lit("table").alias("asset_kind"), (F.col("batch_no") * 5 + F.col("position") + 1).alias("position"), "filename", "title", "content")
    return records.asset_records(enriched, _manifest(spark, d)).drop("crop_bbox")


@query
def preview_join(spark, d):
    items = enrichment.parse(_outputs(spark, d), "document_id", "batch_no").where("status = 'item'")
    return enrichment.preview(_manifest(spark, d), items, {"table": 4, "image": 3})


@query
def enrichment_counts(spark, d):
    m = _manifest(spark, d)
    return enrichment.counts(enrichment.parse(_outputs(spark, d), "document_id", "batch_no").where("status = 'item'"), m)


@query
def enrichment_retry(spark, d):
    results, _ = enrichment.enrich(_manifest(spark, d))
    return results


# records and index


@query
def text_records(spark, d):
    return records.text_records(_chunks(spark, d))


@query
def records_without_span(spark, d):
    return records.without_span(records.text_records(_chunks(spark, d)))


@query
def index_embedding(spark, d):
    """Width, length and filled dimensions of the vectors of every text record."""
    r = records.embed(records.text_records(_chunks(spark, d)), F.col("content"))
    filled = F.filter(F.transform("embedding", lambda v, at: F.when(v > 0, at + 1).when(v < 0, -at - 1)), lambda v: v.isNotNull())
    return r.select("chunk_key", F.size("embedding").alias("dimension"), F.round(arrays.dot(F.col("embedding"), F.col("embedding")), 3).alias("length"), filled.alias("filled"))


@query
def manifest_stats(spark, d):
    r, _ = _vectors(spark, d)
    return records.manifest_stats(r.withColumn("document_id", F.lit("all")))


# retrieval


def _hits(spark, d):
    r, q = _vectors(spark, d)
    return vectors.topk(r, q)


@query
def vec_topk(spark, d):
    return _hits(spark, d).select("query_id", "modality", "vec_id", "rank", F.round("score", 6).alias("score"))


@query
def vec_threshold(spark, d):
    return vectors.passing(_hits(spark, d), THRESHOLDS).select("query_id", "modality", "vec_id", "rank", "score", "passed")


@query
def vec_all_modalities(spark, d):
    """The hits of every modality as one row per query."""
    h = _hits(spark, d).groupBy("query_id", "modality").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("hits"))
    return h.groupBy("query_id").agg(*[F.max(F.when(F.col("modality") == m, F.col("hits"))).alias(m) for m in ("text", "table", "image")])


def _retrieved(spark, d, thresholds=None):
    _, q = _vectors(spark, d)
    return vectors.retrieve(_hits(spark, d), q, thresholds or THRESHOLDS)


@query
def retrieve_mode(spark, d):
    return _retrieved(spark, d)


@query
def retrieve_by_document(spark, d):
    """Every query searches the records of its own document; a document is made of every fifth label."""
    rows = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("doc_"), F.col("label") % 5).alias("document_id"))
    r, q = _vectors(spark, d)
    r, q = r.join(rows, "vec_id"), q.join(rows.withColumnRenamed("vec_id", "query_id"), "query_id")
    return vectors.retrieve(vectors.topk(r, q, within=True), q, THRESHOLDS)


@query
def retrieve_trace(spark, d):
    return vectors.trace(_retrieved(spark, d))


@query
def retrieve_multimodal(spark, d):
    """Text thresholds that some queries miss, so that tables and images come in."""
    return _retrieved(spark, d, THRESHOLDS | {"text": 0.3})


@query
def raw_fallback(spark, d):
    return _retrieved(spark, d, {"text": 1.5, "table": 1.5, "image": 1.5})


# evidence


def _contexts(spark, d):
    """Retrieved records with the run of the same number as their content."""
    runs = table(spark, d, "query_summaries").select(F.col("run_id").alias("vec_id"), F.col("query").alias("title"), F.col("expected_answer").alias("summary"), F.col("generated_answer").alias("content"))
    got = _retrieved(spark, d).where("vec_id IS NOT NULL").join(runs, "vec_id", "left")
    page = F.when(F.col("modality") != "text", F.col("vec_id") % 7)
    base = got.withColumn("page", page).withColumn("modality", F.upper("modality")).withColumn("id", F.format_string("rec_%06d", "vec_id"))
    span = F.when(F.col("page").isNull() & (F.col("vec_id") % 2 == 0), F.array(F.col("vec_id") % 5, F.col("vec_id") % 5 + 1))
    boxed = base.withColumn("page_span", span).withColumn("bbox", F.when(F.col("page") > 3, F.array(F.col("page").cast("double"), F.lit(2.5)))).withColumn("score", F.round("score", 3))
    return evidence.with_ids(evidence.normalise(boxed), "rank")


@query
def context_normalize(spark, d):
    return _contexts(spark, d).select("query_id", "modality", "vec_id", "summary")


@query
def evidence_ids(spark, d):
    return _contexts(spark, d).select("query_id", "modality", "vec_id", "evidence_id")


@query
def evidence_format(spark, d):
    return _contexts(spark, d).select("query_id", "evidence_id", evidence.rendered(80, spans=True).alias("lines"))


def _asked(spark, d):
    _, q = _vectors(spark, d)
    return q.select("query_id").join(table(spark, d, "query_summaries").select(F.col("run_id").alias("query_id"), "query"), "query_id", "left")


@query
def answer_dry_run(spark, d):
    """The rendered prompt and the placeholder answer of every query."""
    p = evidence.prompts(_asked(spark, d), _contexts(spark, d))
    return p.select("query_id", F.length("prompt").alias("prompt_chars"), F.concat(F.lit("Dry run answer "), F.substring(F.md5("prompt"), 1, 8)).alias("answer"))


@query
def evidence_package(spark, d):
    """What the packages hold, read back from their JSON: the contexts of every kind in their order."""
    made = evidence.packages(_asked(spark, d), _contexts(spark, d))
    item = "array<struct<evidence_id string, id string, page bigint, score double, title string, summary string, content string>>"
    back = F.from_json("package", f"query_id bigint, query string, contexts_by_modality struct<text {item}, `table` {item}, image {item}>")
    parts = made.withColumn("p", back).withColumn("c", F.concat(*[F.coalesce(F.col(f"p.contexts_by_modality.{m}"), F.array().cast(item)) for m in ("text", "table", "image")]))
    return parts.select("query_id", F.col("p.query").alias("query"), "texts", "tables", "images", *[F.col(f"c.{n}").alias(n) for n in ("evidence_id", "id", "page", "score", "title", "summary", "content")])


@query
def evidence_trace(spark, d):
    return evidence.packages(_asked(spark, d), _contexts(spark, d)).select("query_id", "texts", "tables", "images", (F.col("tables") > 0).alias("table_montage"), (F.col("images") > 0).alias("image_montage"))


@query
def montage_label(spark, d):
    c = _contexts(spark, d)
    return c.select("query_id", "evidence_id", evidence.label(F.col("evidence_id"), F.col("page"), F.col("title"), F.col("id")).alias("label"))


def _images(spark, d):
    """Up to five images for every fifth run."""
    r = table(spark, d, "query_summaries")
    return r.select(F.floor(F.col("run_id") / 5).alias("query_id"), (F.col("run_id") % 5 + 1).alias("place"), (F.lit(300) + F.col("run_id") % 900).alias("width"), (F.lit(200) + F.col("run_id") % 700).alias("height"))


@query
def montage_vertical(spark, d):
    return evidence.montages(_images(spark, d), evidence.TABLE_LAYOUT)


@query
def montage_grid(spark, d):
    return evidence.montages(_images(spark, d), evidence.IMAGE_LAYOUT)


@query
def pixel_fit(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 61).alias("w"), (F.col("p_partkey") % 1700 + 20).alias("h"))
    fit = geometry.fitted(F.col("w").cast("int"), F.col("h").cast("int"), *reversed(evidence.PIXELS))
    return p.select("p_partkey", fit["width"].alias("width"), fit["height"].alias("height"))


# catalog


def _entries(spark, d):
    p = latest_pages(spark, d)
    return p.groupBy("document_id").agg(F.max("page_count").alias("pages"), F.max("landed_at").alias("landed_at"))


@query
def catalog_upsert(spark, d):
    """Filings with an even page count are replaced by a new entry."""
    old = _entries(spark, d).withColumn("state", F.lit("old"))
    return catalog.upsert(old, old.where("pages % 2 = 0").withColumn("state", F.lit("new")))


@query
def catalog_latest(spark, d):
    """The last event of every user."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return catalog.latest(e, ["user_id"], ["ts", "event_id"])


@query
def catalog_missing_paths(spark, d):
    listed = _pages(spark, d).groupBy("document_id").agg(F.collect_set("input_path").alias("paths"))
    present = _pages(spark, d).where("page_index > 0").select(F.col("input_path").alias("path")).distinct()
    return catalog.missing_paths(listed, present)


@query
def metadata_merge(spark, d):
    """Source and form of every page over defaults; empty values don't count."""
    p = _pages(spark, d)
    base = F.create_map(F.lit("source"), F.lit("unknown"), F.lit("form"), F.lit("none"), F.lit("engine"), F.lit("ocr"))
    own = catalog.without_empty(F.create_map(F.lit("source"), F.col("source"), F.lit("form"), F.col("form_type"), F.lit("note"), F.lit("")))
    m = catalog.merged(base, own)
    return p.select("document_id", "page_index", "landed_at", m["source"].alias("source"), m["form"].alias("form"), m["engine"].alias("engine"), F.size(m).alias("entries"))


@query
def first_present(spark, d):
    r = table(spark, d, "query_summaries")
    return r.select("run_id", catalog.first_present(F.col("retrieval_mode"), F.col("document_id"), F.lit("none")).alias("value"), catalog.lenient_int(F.col("query")).alias("number"), catalog.flag(F.col("fallback_triggered").cast("string")).alias("fallback"))


@query
def retrieval_summary(spark, d):
    """Runs, fallbacks and hits by retrieval mode."""
    r = table(spark, d, "query_summaries")
    return r.groupBy(F.coalesce("retrieval_mode", F.lit("<none>")).alias("mode")).agg(F.count("*").alias("runs"), F.count_if("fallback_triggered").alias("fallbacks"), F.sum("text_hits").alias("text_hits"), F.sum("table_hits").alias("table_hits"), F.sum("image_hits").alias("image_hits"))

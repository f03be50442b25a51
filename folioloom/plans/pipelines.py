"""End-to-end plans: from OCR results to an index, and from queries to answers.

The result of each stage is written once to the shared folder, so that no stage is computed again
for every use and a lost executor costs only its running tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.config import Retrieval
from folioloom.functions import arrays, text
from folioloom.operators import assets, blocks, chunks, enrichment, evidence, merging, records, sentences, vectors
from folioloom.operators.ordered import numbered, with_next
from folioloom.providers import Answerer, DryAnswerer, Embedder, HashedWords, Splitter, Vision
from folioloom.sources import ocr_json
from folioloom.sources.durable import written

#: Contexts that a query's summary shows.
SUMMARY_CONTEXTS = 8


def load_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of OCR files under ``path``, in the form of the block operators.

    A document's blocks come from its page files, else from a single result file, else from the
    layout boxes of that file.
    """
    pages = ocr_json.with_document(ocr_json.read_pages(spark, path)).withColumn("landed_at", F.current_timestamp())
    parsed = ocr_json.with_document(ocr_json.read_blocks(spark, path)).withColumn("source", F.when(F.col("file").rlike(r"/page_\d+[^/]*$"), 0).otherwise(1))
    layout = ocr_json.with_document(ocr_json.read_layout(spark, path)).withColumn("source", F.lit(2))
    found = parsed.unionByName(layout)
    best = found.groupBy("document_id").agg(F.min("source").alias("source"))
    keyed = found.join(best, ["document_id", "source"], "left_semi").withColumn("block_key", F.xxhash64("file", "page_index", "position"))
    return pages, blocks.fields(keyed)


def text_of(block_rows: DataFrame, splitter: Splitter | None = None) -> DataFrame:
    """Sentences of every filing, numbered through its pages; by the default splitter or a model's."""
    pages = blocks.markdown(block_rows).withColumn("page_key", F.struct("document_id", "page_index"))
    if splitter is None:
        each = sentences.split(pages, key="page_key", column="markdown").select("page_key.*", "sentence_id", "sentence")
    else:
        held = pages.select("document_id", "page_index", F.posexplode(text.paragraphs(F.col("markdown"))).alias("paragraph_no", "paragraph"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = [[p.lstrip("#").strip()] if p.startswith("#") else [s for s in splitter.split(p) if s.strip()] for p in b.column(3).to_pylist()]
                rows = b.take(pa.array([i for i, part in enumerate(parts) for _ in part], pa.int64()))
                at = [n for part in parts for n in range(len(part))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(at, pa.int32()), pa.array([s for part in parts for s in part], pa.string())], names=["document_id", "page_index", "paragraph_no", "at", "sentence"])

        kind = held.schema["page_index"].dataType.simpleString()
        cut = held.mapInArrow(run, f"document_id string, page_index {kind}, paragraph_no int, at int, sentence string")
        each = cut.select("document_id", "page_index", (F.col("paragraph_no").cast("bigint") * (1 << 24) + F.col("at")).alias("sentence_id"), "sentence")
    rows = numbered(each, ["document_id"], F.col("page_index"), [F.col("page_index"), F.col("sentence_id")], "n", width=64)
    return written(rows.select("document_id", (F.col("n") - 1).alias("sentence_id"), F.col("sentence").alias("text"), (F.col("page_index") + 1).cast("int").alias("page")), "sentences")


def initial_chunks(sentence_rows: DataFrame, width: int = 6, step: int = 4, percentile: float = 95.0, embedder: Embedder | None = None) -> DataFrame:
    """Chunks between the breakpoints of sliding windows, in the form of the chunk operators."""
    model = embedder or HashedWords()
    vectors_ = records.embed(sentence_rows, F.col("text"), model)
    windows = sentences.windows(sentence_rows, width, step)
    pair = with_next(vectors_.select("document_id", "sentence_id", "embedding"), ["document_id"], F.col("sentence_id"), [F.col("sentence_id")], ["embedding"]).where("next IS NOT NULL")
    distances = pair.select("document_id", "sentence_id", (1 - arrays.dot(F.col("embedding"), F.col("next.embedding"))).alias("distance"))
    inside = windows.select("document_id", "block_id", F.posexplode("sentence_ids").alias("at", "sentence_id"), (F.size("sentence_ids") - 1).alias("last"))
    held = inside.join(distances, ["document_id", "sentence_id"], "left").withColumn("distance", F.when(F.col("at") < F.col("last"), F.col("distance")))
    limits = held.groupBy("document_id", "block_id").agg(F.percentile("distance", F.lit(percentile / 100)).alias("threshold"))
    joined = held.join(limits, ["document_id", "block_id"])
    row = F.array_sort(F.collect_list(F.struct("at", "sentence_id", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).alias("cut"))))
    grouped = joined.groupBy("document_id", "block_id").agg(row.alias("rows"))
    part = lambda x: F.size(F.filter(F.col("rows"), lambda y: (y["at"] < x["at"]) & y["cut"]))
    each = grouped.select("document_id", "block_id", F.explode(F.transform("rows", lambda x: F.struct(x["sentence_id"].alias("sentence_id"), part(x).alias("segment")))).alias("r")).select("document_id", "block_id", "r.*")
    made = each.join(sentence_rows.select("document_id", "sentence_id", "text", "page"), ["document_id", "sentence_id"]).groupBy("document_id", "block_id", "segment").agg(F.array_sort(F.collect_list("sentence_id")).alias("ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]), " ").alias("text"), F.array_sort(F.collect_set("page")).alias("pages"))
    span = F.when(F.size("pages") > 0, F.array(F.array_min("pages"), F.array_max("pages")))
    return written(made.select("document_id", F.xxhash64("document_id", "block_id", "segment").alias("chunk_key"), F.format_string("chunk_%06d_%02d", "block_id", "segment").alias("chunk_id"), "ids", "text", F.array("block_id").alias("source_block_ids"), span.alias("page_span")), "initial")


def final_chunks(initial: DataFrame, sentence_rows: DataFrame, settings: merging.Settings = merging.Settings(), embedder: Embedder | None = None) -> DataFrame:
    """Merged chunks with rebuilt texts."""
    merged = written(merging.merge(initial, sentence_rows, settings, embedder).where("kind = 'chunk'").select("document_id", F.xxhash64("document_id", "segment", "key").alias("chunk_key"), F.col("key").alias("chunk_id"), "ids"), "merged")
    built = chunks.texts(merged, sentence_rows)
    span = F.when(F.size("pages") > 0, F.array(F.array_min("pages"), F.array_max("pages")))
    return merged.join(built.select("chunk_key", "text", span.alias("page_span")), "chunk_key")


def index(chunk_rows: DataFrame, asset_rows: DataFrame | None = None, embedder: Embedder | None = None) -> DataFrame:
    """One table of text, table and image records with vectors."""
    model = embedder or HashedWords()
    rows = records.text_records(chunk_rows).select("document_id", F.lit("text").alias("modality"), "id", F.lit(None).cast("string").alias("title"), "content", "hash", F.element_at("page_span", 1).cast("bigint").alias("page"), F.col("page_span").cast("array<bigint>").alias("page_span"), F.lit(None).cast("array<double>").alias("bbox"))
    if asset_rows is not None:
        rows = rows.unionByName(asset_rows.select("document_id", F.col("asset_kind").alias("modality"), "id", "title", "content", "hash", F.col("page").cast("bigint"), F.lit(None).cast("array<bigint>").alias("page_span"), F.col("bbox").cast("array<double>")))
    return records.embed(rows, records.embedding_text(F.col("modality"), F.col("title"), F.col("content")), model)


def assets_manifest(block_rows: DataFrame, pages: DataFrame, kinds: tuple[str, ...] = ("table", "image"), padding: float = 8.0, most_distance: float | None = 160.0, title_labels: tuple[str, ...] = ()) -> DataFrame:
    """The manifest of all assets of the given kinds."""
    made = [assets.manifest(assets.crops(assets.nearest_title(assets.assets_of(block_rows, k), block_rows, most_distance, title_labels=title_labels), pages, padding)) for k in kinds]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def describe(block_rows: DataFrame, pages: DataFrame, vision: Vision | None = None, kinds: tuple[str, ...] = ("table", "image")) -> DataFrame:
    """Asset records of all kinds: found, titled, cropped, described and joined."""
    manifest = written(assets_manifest(block_rows, pages, kinds), "manifest")
    results, _ = enrichment.enrich(manifest, vision)
    named = results.join(manifest.select("document_id", "filename", "asset_kind", F.col("asset_index").alias("position")), ["document_id", "filename"])
    return records.asset_records(named, manifest)


def search(queries: DataFrame, index_rows: DataFrame, modality: str, settings: Retrieval, include_below: bool = False, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, document_id, modality, rank, score, threshold, passed, id, title, content, page): one modality of one document per query.

    An unknown modality, an empty query and a document without such records are errors.
    """
    vectors.validate(index_rows, queries, modality)
    asked = records.embed(queries, F.col("query"), embedder or HashedWords())
    keyed = index_rows.where(F.col("modality") == modality).withColumn("vec_id", F.xxhash64("document_id", "modality", "id"))
    hits = vectors.topk(keyed, asked, {modality: settings.candidates[modality]}, within=True)
    passed = vectors.passing(hits, dict(settings.thresholds), include_below)
    return passed.join(keyed.select("vec_id", "document_id", "id", "title", "content", "page"), "vec_id").select("query_id", "document_id", "modality", "rank", "score", "threshold", "passed", "id", "title", "content", "page")


def manifest(index_rows: DataFrame, index_dir: str, embedding_model: str) -> DataFrame:
    """(document_id, embedding_model, index_dir, modalities): what the index holds of every document."""
    stats = records.manifest_stats(index_rows)
    entry = F.struct("modality", F.struct("count", "dimension").alias("m"))
    return stats.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("modalities")).select("document_id", F.lit(embedding_model).alias("embedding_model"), F.lit(index_dir).alias("index_dir"), "modalities")


def answer(queries: DataFrame, index_rows: DataFrame, settings: Retrieval, embedder: Embedder | None = None, answerer: Answerer | None = None, strict: bool = False) -> DataFrame:
    """(query_id, query, document_id, mode, fallback_triggered, threshold_fallback, counts, contexts, prompt, answer) of every query.

    A query searches its ``document_id``; without that column all documents.  ``contexts`` are the
    first ``SUMMARY_CONTEXTS``.  An empty answer is null, or an error where ``strict``.  Retrieval, evidence and prompt are one plan; only the embedder and
    the answerer leave the JVM.
    """
    model, writer = embedder or HashedWords(), answerer or DryAnswerer()
    within = "document_id" in queries.columns
    named = queries if within else queries.withColumn("document_id", F.lit(None).cast("string"))
    asked = records.embed(named.where(F.coalesce(F.trim("query"), F.lit("")) != ""), F.col("query"), model)
    keyed = index_rows.withColumn("vec_id", F.xxhash64("document_id", "modality", "id"))
    hits = written(vectors.topk(keyed, asked, dict(settings.candidates), within), "hits")
    got = written(vectors.retrieve(hits, asked, dict(settings.thresholds), settings.least_text, dict(settings.caps)), "retrieved")
    contexts = got.where("vec_id IS NOT NULL").join(keyed.select("vec_id", "id", "title", "content", "page", "page_span", "bbox"), "vec_id").withColumn("summary", F.lit(None).cast("string"))
    ready = evidence.with_ids(evidence.normalise(contexts), "rank")
    prompts = evidence.prompts(asked.select("query_id", "query"), ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [(writer.answer(p, []) or "").strip() or None for p in b.column(1).to_pylist()]
            if strict and None in said:
                raise ValueError("the model gave an empty answer")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=["query_id", "prompt", "answer"])

    answers = prompts.select("query_id", "prompt").mapInArrow(run, "query_id bigint, prompt string, answer string")
    order = F.create_map(*[F.lit(x) for pair in (("text", 0), ("table", 1), ("image", 2)) for x in pair])[F.col("modality")]
    shown = ready.groupBy("query_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("kind"), "place", F.struct("evidence_id", "modality", "id", "page", "score", "title").alias("c")))), 1, SUMMARY_CONTEXTS), lambda x: x["c"]).alias("contexts"))
    return asked.select("query_id", "query", "document_id").join(vectors.trace(got), "query_id").join(shown, "query_id", "left").join(answers, "query_id")

"""``python -m folioloom <command>``: thin commands over the plans."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from folioloom.config import Config, Retrieval
from folioloom.operators import blocks, catalog, merging, records
from folioloom.plans import pipelines
from folioloom.providers import HashedWords
from folioloom.sources import json_io
from folioloom.sources.durable import written

# fixed values: short names of commands
ALIASES = {
    "text-md": "generate-text-md", "chunk": "chunk-text", "assets": "extract-assets", "enrich": "enrich-assets", "index": "build-indexes",
    "search": "search-indexes", "evidence": "build-evidence-package", "answer": "generate-answer", "query": "run-query-pipeline",
}


def _spark() -> SparkSession:
    return SparkSession.builder.appName("folioloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def generate_text(a: argparse.Namespace) -> None:
    _, rows = pipelines.load_blocks(_spark(), a.input)
    json_io.write_texts(blocks.markdown(rows), a.output, "document_id", "markdown", a.overwrite)


def _step(a: argparse.Namespace) -> int:
    step = a.step or a.window - a.overlap
    if a.window < 1 or step < 1:
        raise SystemExit("window and step must be positive")
    return step


def _chunks(a: argparse.Namespace):
    """Pages, blocks and chunks; sentences are read back where saved ones are named."""
    pages, rows = pipelines.load_blocks(_spark(), a.input)
    lines = json_io.read_sentences(_spark(), a.sentences) if a.sentences else pipelines.text_of(rows)
    first = pipelines.initial_chunks(lines, a.window, _step(a), a.percentile)
    limits = merging.Settings(small_words=a.short_words, most_words=a.max_embedding_tokens or a.max_tokens, overlap=a.overlap_threshold, similarity=a.similarity, most_gap=a.max_gap, budget=a.merge_ratio)
    return pages, rows, lines, first, first if a.no_merge else pipelines.final_chunks(first, lines, limits)


def chunk_text(a: argparse.Namespace) -> None:
    _, _, lines, first, final = _chunks(a)
    for frame, path in ((lines, a.sentences_output), (first, a.initial_output), (final, a.output)):
        if path:
            json_io.write_lines(frame, path, a.overwrite)


def extract_assets(a: argparse.Namespace) -> None:
    pages, rows = pipelines.load_blocks(_spark(), a.input)
    kinds = ("table", "image") if a.kind == "all" else (a.kind,)
    json_io.write_lines(pipelines.assets_manifest(rows, pages, kinds, a.padding, a.title_distance, tuple(a.title_label or ())), a.output, a.overwrite)


def enrich_assets(a: argparse.Namespace) -> None:
    pages, rows = pipelines.load_blocks(_spark(), a.input)
    json_io.write_lines(pipelines.describe(rows, pages, kinds=("table", "image") if a.kind == "all" else (a.kind,)), a.output, a.overwrite)


def build_index(a: argparse.Namespace) -> None:
    """The index, its manifest beside the data, and the catalog's entries of its documents."""
    spark = _spark()
    pages, rows, _, _, made = _chunks(a)
    records.write_index(pipelines.index(made, pipelines.describe(rows, pages)), a.output, "overwrite" if a.overwrite else "errorifexists")
    held = written(pipelines.manifest(spark.read.parquet(a.output), a.output, HashedWords().name), "manifest")
    json_io.write_lines(held, f"{a.output}/_manifest", True)
    if a.catalog:
        known = spark.read.schema(held.schema).json(a.catalog) if json_io.exists(spark, a.catalog) else spark.createDataFrame([], held.schema)
        json_io.write_lines(written(catalog.upsert(known, held), "catalog"), a.catalog, True)


def _asked(a: argparse.Namespace):
    spark = _spark()
    asked = spark.createDataFrame([(0, a.query or "", a.document)], "query_id bigint, query string, document_id string")
    return (asked if a.document else asked.drop("document_id")), spark.read.parquet(a.input), Retrieval.of(Config.load(a.config))


def search_index(a: argparse.Namespace) -> None:
    """The hits of one modality within one document."""
    if not a.document:
        raise SystemExit("search-indexes needs --document")
    asked, rows, settings = _asked(a)
    hits = pipelines.search(asked, rows, a.modality, settings, a.include_below).orderBy("rank")
    json_io.write_lines(hits, a.output, a.overwrite) if a.output else hits.show(1000, truncate=80)


def _shown(frame, a: argparse.Namespace) -> None:
    json_io.write_lines(frame, a.output, a.overwrite) if a.output else frame.show(truncate=False)


def build_evidence(a: argparse.Namespace) -> None:
    _shown(pipelines.answer(*_asked(a)).select("query_id", "query", "document_id", "mode", "contexts", "prompt"), a)


def run_query(a: argparse.Namespace) -> None:
    _shown(pipelines.answer(*_asked(a), strict=True), a)


# fixed values: names of commands
COMMANDS: dict[str, Callable[[argparse.Namespace], None]] = {
    "generate-text-md": generate_text, "chunk-text": chunk_text, "extract-assets": extract_assets, "enrich-assets": enrich_assets, "build-indexes": build_index,
    "search-indexes": search_index, "build-evidence-package": build_evidence, "generate-answer": run_query, "run-query-pipeline": run_query,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioloom")
    p.add_argument("command", choices=[*COMMANDS, *ALIASES])
    p.add_argument("--input", required=True, help="page files, or an index for the query commands")
    p.add_argument("--output")
    p.add_argument("--kind", choices=("table", "image", "all"), default="table")
    p.add_argument("--modality", choices=("text", "table", "image"), default="text")
    p.add_argument("--include-below", action="store_true", help="hits below the threshold as well")
    p.add_argument("--catalog", help="catalog of documents to bring up to date")
    chunking = p.add_argument_group("chunking")
    chunking.add_argument("--window", type=int, default=6, help="sentences in a window")
    chunking.add_argument("--overlap", type=int, default=2, help="sentences that windows share where no step is given")
    chunking.add_argument("--step", type=int)
    chunking.add_argument("--percentile", type=float, default=95.0, help="of the distances, above which a window is cut")
    chunking.add_argument("--max-tokens", type=int, default=512)
    chunking.add_argument("--max-embedding-tokens", type=int, help="limit of merged chunks; --max-tokens where absent")
    chunking.add_argument("--similarity", type=float, default=0.85)
    chunking.add_argument("--overlap-threshold", type=float, default=0.8)
    chunking.add_argument("--max-gap", type=int, default=3, help="sentences between chunks that may merge")
    chunking.add_argument("--merge-ratio", type=float, default=0.4, help="share of the chunks that may merge by similarity")
    chunking.add_argument("--short-words", type=int, default=20)
    chunking.add_argument("--no-merge", action="store_true")
    chunking.add_argument("--sentences", help="saved sentences to use instead of a new split")
    chunking.add_argument("--sentences-output")
    chunking.add_argument("--initial-output")
    cutting = p.add_argument_group("assets")
    cutting.add_argument("--padding", type=float, default=8.0)
    cutting.add_argument("--title-distance", type=float, default=160.0)
    cutting.add_argument("--title-label", action="append", help="a label that counts as a title as well")
    p.add_argument("--query")
    p.add_argument("--document")
    p.add_argument("--config")
    p.add_argument("--overwrite", action="store_true")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    COMMANDS[ALIASES.get(a.command, a.command)](a)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Descriptions of assets: parsing model output, accounting, joining and the retry loop."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.operators.ordered import numbered
from folioloom.providers import DryVision, Vision
from folioloom.sources.durable import written

# fixed values: the marks at line starts before a record's file name, title, metadata and content
MARKS = ("F", "T", "M", "C")


def field(value: Column) -> Column:
    """A field without outer white space and without blanks at line ends; inner indents stay."""
    return F.regexp_replace(F.regexp_replace(value, r"[ \t\r]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def batch_prompt(template: str, filenames: list[str]) -> str:
    """The template with the batch's files, one a line, in place of ``{filenames}``; doubled braces stand for single ones."""
    listed = "\n".join(f"- {name}" for name in filenames)
    return listed.join(part.replace("{{", "{").replace("}}", "}") for part in template.split("{filenames}"))


def dry_run(filenames: Column) -> Column:
    """The placeholder output for an array of file names; its words are fixed values."""
    return F.array_join(F.transform(filenames, lambda f: F.concat(F.lit("[F] "), f, F.lit("\n[T] DRY RUN\n[M] Dry run metadata.\n[C] Dry run content."))), "\n\n")


def parse(outputs: DataFrame, *keys: str) -> DataFrame:
    """(keys, position, filename, title, metadata, content, status) of every record in ``output``.

    A record that lacks a mark, or has them in another order, is left out.

    With a column ``expected`` the status is ``unexpected`` for other names; a name seen before is a
    ``duplicate``; the rest are ``item``.  Records without a name are left out.
    """
    marked = [rf"(?m)^\s*\[{m}\]" for m in MARKS]
    # records begin at the first mark; the others cut them one after the other
    records = F.filter(F.slice(F.split("output", marked[0]), 2, 1 << 30), lambda r: F.forall(F.array(*[F.lit(m) for m in marked[1:]]), lambda m: F.regexp_like(r, m)))
    rows = outputs.select(*keys, "expected", F.posexplode(records).alias("position", "rest"))
    for name, mark in zip(("filename", "title", "metadata"), marked[1:]):
        cut = F.split("rest", mark, 2)
        rows = rows.withColumn(name, field(cut[0])).withColumn("rest", F.get(cut, F.lit(1)))
    # a mark that stands before its turn leaves nothing behind it
    named = rows.where("rest IS NOT NULL").withColumn("content", field(F.col("rest"))).where("filename <> ''")
    wanted = F.coalesce(F.size("expected"), F.lit(0)) <= 0
    known = wanted | F.array_contains("expected", F.col("filename"))
    seen = F.row_number().over(Window.partitionBy(*keys, "filename").orderBy("position"))
    return named.withColumn("seen", seen).select(*keys, "position", "filename", "title", "metadata", "content", F.when(~known, "unexpected").when(F.col("seen") > 1, "duplicate").otherwise("item").alias("status"))


def accounting(outputs: DataFrame, parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, missing, unexpected, duplicates): file names by what became of them."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("filename"))))
    seen = parsed.groupBy(*keys).agg(of("item").alias("items"), of("unexpected").alias("unexpected"), of("duplicate").alias("duplicates"))
    empty = F.array().cast("array<string>")
    joined = outputs.join(seen, list(keys), "left")
    missing = F.filter("expected", lambda x: ~F.array_contains(F.coalesce(F.col("items"), empty), x))
    return joined.select(*keys, missing.alias("missing"), F.coalesce("unexpected", empty).alias("unexpected"), F.coalesce("duplicates", empty).alias("duplicates"))


def schedule(batch: int) -> list[int]:
    """Batch sizes of the rounds: the size, its half and its quarter, each at least 1 and once."""
    return list(dict.fromkeys(max(1, batch // d) for d in (1, 2, 4)))


def enrich(files: DataFrame, vision: Vision | None = None, prompt: str = "", batch: int = 5, single_tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Results (document_id, filename, title, metadata, content) and attempts of a retry loop.

    ``files`` is (document_id, filename).  Every round asks for the files without a result in
    batches of its size; what is still missing is tried alone.  A failing call is an attempt
    without results, never an error.  Lineage is cut by a written table after each round.
    """
    model = vision or DryVision()
    pending = written(files.select("document_id", "filename").distinct(), "pending")
    results = attempts = None

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outputs, errors = [], []
            for names in b.column(2).to_pylist():
                try:
                    outputs.append(model.describe(names, batch_prompt(prompt, names)))
                    errors.append(None)
                except Exception as error:  # a provider may fail in any way
                    outputs.append("")
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outputs, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "output", "error"])

    rounds = [(f"batch_round_{i}", size) for i, size in enumerate(schedule(batch), 1)] + [(f"single_retry_{i}", 1) for i in range(1, single_tries + 1)]
    for phase, size in rounds:
        if pending.isEmpty():
            break
        lead = F.expr(r"coalesce(try_cast(regexp_extract(filename, '(\\d+)', 1) AS bigint), 0)")
        placed = numbered(pending, ["document_id"], lead, [lead, F.col("filename")], "place")
        groups = placed.withColumn("batch_no", F.floor((F.col("place") - 1) / size)).groupBy("document_id", "batch_no").agg(F.array_sort(F.collect_list("filename")).alias("expected"))
        out = written(groups.mapInArrow(call, "document_id string, batch_no bigint, expected array<string>, output string, error string"), "round")
        parsed = parse(out, "document_id", "batch_no").where("status = 'item'").select("document_id", "filename", "title", "metadata", "content")
        log = out.select("document_id", F.lit(phase).alias("phase"), F.lit(size).alias("batch_size"), "batch_no", "expected", F.col("error").isNull().alias("success"), "error")
        results = parsed if results is None else results.unionByName(parsed)
        attempts = log if attempts is None else attempts.unionByName(log)
        pending = written(pending.join(parsed, ["document_id", "filename"], "left_anti"), "pending")
    if results is None:
        spark = files.sparkSession
        results = spark.createDataFrame([], "document_id string, filename string, title string, metadata string, content string")
        attempts = spark.createDataFrame([], "document_id string, phase string, batch_size int, batch_no bigint, expected array<string>, success boolean, error string")
    return results, attempts


def preview(manifest: DataFrame, results: DataFrame, most: dict[str, int]) -> DataFrame:
    """The first assets of each kind with their descriptions, as contexts; OCR titles fill gaps."""
    joined = manifest.where(F.col("asset_index") <= F.create_map(*[F.lit(x) for p in most.items() for x in p])[F.col("asset_kind")]).join(results.select("document_id", "filename", F.col("title").alias("new_title"), "metadata", "content"), ["document_id", "filename"], "left")
    title = F.coalesce(F.nullif(F.trim("new_title"), F.lit("")), F.col("title"))
    return joined.select("document_id", F.col("asset_kind").alias("modality"), F.format_string("%s_%06d", "asset_kind", "asset_index").alias("id"), "filename", title.alias("title"), F.col("metadata").alias("summary"), F.coalesce(F.nullif(F.trim("content"), F.lit("")), title).alias("content"), "page", "bbox")


def counts(results: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, total, success, failed)."""
    joined = files.select("document_id", "filename").distinct().join(results.select("document_id", "filename", F.lit(1).alias("ok")).distinct(), ["document_id", "filename"], "left")
    return joined.groupBy("document_id").agg(F.count("*").alias("total"), F.count("ok").alias("success"), (F.count("*") - F.count("ok")).alias("failed"))

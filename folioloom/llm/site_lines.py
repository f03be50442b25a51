"""Problem 2: lines that one site repeats in many of its filings.

Lines are parsed into templates by a token tree of fixed depth.  Tokens are taken from the letters
of a line alone, ``TOKEN`` letters each, so lines that differ in case, digits, blanks or
punctuation have the same tokens however their words are split.  The levels of the tree are the
source, the number of letters, the first ``DEPTH`` tokens and the last one; under each leaf hangs a
template with the tokens that all its lines share and a wildcard slot where they differ.

Trees are built as partial aggregates of every partition and merged by the exchange: documents
under a leaf add up, a token stays where both trees hold the same one and becomes a slot where
they don't (least and greatest token of a place).  Leaves that cover few documents of their source
are cut off before their templates are made.  A line is repeated where it agrees with the template
of its leaf and the letters in its slots do so in enough documents as well.

Defined results: a null content has no lines; an empty content has one line, which has too few
letters to count; a null label counts, a null source or document_id does not (such a line belongs
to no site or no document).  Repeated rows count under each of their keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.sources.durable import written

DEPTH = 3
TOKEN = 6
LEAST_LETTERS = 10
LEAST_DOCUMENTS = 5
#: Leaves and their templates that may travel with a scan (some 100 bytes each); more are joined by an exchange.
BROADCAST_ROWS = 200_000

# fixed values: labels whose blocks do not count
SKIPPED_LABELS = ("doc_title", "paragraph_title", "figure_title", "table", "number")


def plain_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def letters(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _lines(blocks: DataFrame) -> DataFrame:
    label = plain_label("block_label")
    kept = blocks.where(F.col("block_content").isNotNull() & F.col("source").isNotNull() & F.col("document_id").isNotNull()).where(label.isNull() | ~label.isin(*SKIPPED_LABELS))
    return kept.select("block_key", "source", "document_id", F.posexplode(F.split("block_content", "\n")).alias("at", "line")).select("block_key", "source", "document_id", (F.col("at") + 1).cast("long").alias("line_no"), "line", letters(F.col("line")).alias("letters")).where(F.length("letters") >= LEAST_LETTERS)


def tokens() -> Column:
    """The tokens of a line; a function of its letters only."""
    return F.regexp_extract_all("letters", F.lit(f"(?s).{{1,{TOKEN}}}"), F.lit(0))


def _leaf() -> Column:
    """The way of a line through the tree, as one hash: source, letters, first tokens, last token."""
    return F.xxhash64("source", F.length("letters"), *[F.substring("letters", 1 + TOKEN * d, TOKEN) for d in range(DEPTH)], F.expr(f"right(letters, {TOKEN})"))


def _travels(frame: DataFrame, share: int = 1) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS // share else frame


def _wide_leaves(lines: DataFrame) -> DataFrame:
    """(leaf): leaves that cover enough documents; documents are counted once per partition before the exchange."""
    pairs = lines.select(_leaf().alias("leaf"), F.xxhash64("document_id").alias("document")).groupBy("leaf", "document").agg(F.lit(1).alias("one"))
    return pairs.groupBy("leaf").agg(F.sum("one").alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS).select("leaf")


def _merged(near: DataFrame) -> DataFrame:
    """(leaf, template): the tokens of every leaf, null for a slot."""
    forms = near.groupBy("leaf", "letters").agg(F.lit(1).alias("one")).select("leaf", F.posexplode(tokens()).alias("at", "token"))
    places = forms.groupBy("leaf", "at").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    rows = places.select("leaf", F.struct("at", F.when(F.col("low") == F.col("high"), F.col("low")).alias("token")).alias("place"))
    return rows.groupBy("leaf").agg(F.array_sort(F.collect_list("place")).alias("places")).select("leaf", F.transform("places", lambda x: x["token"]).alias("template"))


def _matched(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that agree with the template of a wide leaf, and the templates."""
    lines = _lines(blocks)
    near = written(lines.withColumn("leaf", _leaf()).join(_travels(written(_wide_leaves(lines), "leaves")), "leaf", "left_semi"), "near")
    found = written(_merged(near), "templates")
    agrees = F.forall(F.arrays_zip(tokens().alias("own"), F.col("template").alias("wanted")), lambda x: x["wanted"].isNull() | (x["own"] == x["wanted"]))
    return near.join(_travels(found), "leaf").where(agrees), found


def repeated_lines(blocks: DataFrame) -> DataFrame:
    """(block_key, line_no, source, document_id, leaf, line, letters) of every line repeated within its source."""
    matched, _ = _matched(blocks)
    return _checked(matched)


def _checked(matched: DataFrame) -> DataFrame:
    pairs = matched.groupBy("source", "letters", "document_id").agg(F.lit(1).alias("one"))
    spread = written(pairs.groupBy("source", "letters").agg(F.sum("one").alias("documents")).where(F.col("documents") >= LEAST_DOCUMENTS).select("source", "letters"), "spread")
    return matched.join(_travels(spread), ["source", "letters"], "left_semi").select("block_key", "line_no", "source", "document_id", "leaf", "line", "letters")


def shown(line: str, template: list[str | None]) -> str:
    """``line`` in words, with ``<*>`` for numbers and for words that reach into a slot."""
    words, at = [], 0
    for word in line.split():
        size = sum(map(str.isalpha, word))
        slots = any(template[k] is None for k in range(at // TOKEN, min(len(template), (at + size - 1) // TOKEN + 1))) if size else False
        words.append("<*>" if slots else re.sub(r"\d+(?:[.,]\d+)*", "<*>", word))
        at += size
    return " ".join(words)


def templates(blocks: DataFrame) -> DataFrame:
    """(source, template, documents, lines): the merged templates, ``<*>`` for a slot that varies."""
    matched, made = _matched(blocks)
    pairs = matched.groupBy("source", "leaf", "document_id").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    counts = pairs.groupBy("source", "leaf").agg(F.count("*").alias("documents"), F.sum("n").alias("lines"), F.min("line").alias("line"))
    rows = counts.join(_travels(made), "leaf").select("source", "line", "template", "documents", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [shown(line, template) for line, template in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), batch.column(3), batch.column(4)], names=["source", "template", "documents", "lines"])

    return rows.mapInArrow(run, "source string, template string, documents bigint, lines bigint")


def without_repeated(blocks: DataFrame) -> DataFrame:
    """(block_key, block_content, removed): every block without the repeated lines; null stays null."""
    gone = repeated_lines(blocks).groupBy("block_key", "source", "document_id").agg(F.collect_set("line_no").alias("gone"))
    rows = blocks.select("block_key", "source", "document_id", "block_content", plain_label("block_label").alias("label"))
    joined = rows.join(gone, ["block_key", "source", "document_id"], "left").withColumn("gone", F.when(F.coalesce(F.col("label"), F.lit("")).isin(*SKIPPED_LABELS), None).otherwise(F.col("gone")))
    kept = F.filter(F.split("block_content", "\n"), lambda line, at: ~F.array_contains("gone", (at + 1).cast("long")))
    return joined.select("block_key", F.when(F.col("gone").isNull(), F.col("block_content")).otherwise(F.array_join(kept, "\n")).alias("block_content"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))

"""Relations between chunks: text, overlap, containment, neighbours, validation.

Pairs are found through the rarest sentences they share, so no document is compared with itself as
a whole and a sentence that many chunks share costs little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import arrays, text
from folioloom.operators.ordered import numbered, with_next
from folioloom.sources.durable import written


def current(chunks: DataFrame) -> DataFrame:
    """The last build of every chunk, with sorted distinct sentence ids; chunks without ids are left out."""
    newest = chunks.groupBy("document_id", "chunk_id").agg(F.max_by(F.struct("chunk_key", "config_id", "sentence_ids", "source_block_ids", "source_chunk_ids", "page_span", "text"), F.struct("built_at", "chunk_key")).alias("c")).select("document_id", "chunk_id", "c.*")
    return newest.withColumn("ids", F.array_sort(F.array_distinct(F.array_compact("sentence_ids")))).where(F.size("ids") > 0)


def sort_key() -> list[Column]:
    """Columns that put chunks into order: first and last sentence, size, then the id in natural order."""
    return [F.array_min("ids"), F.array_max("ids"), F.size("ids"), F.regexp_extract("chunk_id", r"^(.*?)\d*$", 1), F.expr(r"coalesce(try_cast(regexp_extract(chunk_id, '(\\d+)$', 1) AS bigint), -1)"), F.col("chunk_id")]


def texts(chunks: DataFrame, sentences: DataFrame) -> DataFrame:
    """(chunk_key, text, pages, words): chunk texts rebuilt from the sentence table."""
    ids = chunks.select("chunk_key", "document_id", F.explode("ids").alias("sentence_id"))
    held = ids.join(sentences, ["document_id", "sentence_id"]).groupBy("chunk_key").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))).alias("parts"), F.array_sort(F.collect_set("page")).alias("pages"))
    return held.select("chunk_key", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"), "pages").withColumn("words", text.word_count(F.col("text")))


def _held(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_key, ids, n, rare): chunks with their sentences, those of few holders first."""
    ids = chunks.select("document_id", "chunk_key", F.explode("ids").alias("sentence_id"))
    holders = ids.groupBy("document_id", "sentence_id").agg(F.count("*").alias("holders"))
    rare = ids.join(holders, ["document_id", "sentence_id"]).groupBy("document_id", "chunk_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("holders", "sentence_id"))), lambda x: x["sentence_id"]).alias("rare"))
    return chunks.select("document_id", "chunk_key", "ids", F.size("ids").alias("n")).join(rare, ["document_id", "chunk_key"])


def overlapping(chunks: DataFrame, least: float = 0.8) -> DataFrame:
    """(document_id, first_key, second_key, shared, overlap): pairs whose overlap reaches ``least``.

    The smaller chunk of such a pair shares so many of its sentences that one of its rarest few is
    among them; only the holders of those are looked at, so a sentence that all chunks share
    makes no pairs by itself.
    """
    held = _held(chunks)
    few = F.col("n") - F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("n") - 1e-9)).cast("int") + 1
    small = held.select("document_id", F.explode(F.slice("rare", F.lit(1), few)).alias("sentence_id"), F.col("chunk_key").alias("small"), F.col("ids").alias("small_ids"), F.col("n").alias("ns"))
    large = held.select("document_id", F.explode("ids").alias("sentence_id"), F.col("chunk_key").alias("large"), F.col("ids").alias("large_ids"), F.col("n").alias("nl"))
    pairs = small.join(large, ["document_id", "sentence_id"]).where((F.col("ns") < F.col("nl")) | ((F.col("ns") == F.col("nl")) & (F.col("small") < F.col("large"))))
    shared = F.size(F.array_intersect("small_ids", "large_ids"))
    counted = pairs.select("document_id", F.least("small", "large").alias("first_key"), F.greatest("small", "large").alias("second_key"), shared.cast("bigint").alias("shared"), (shared / F.col("ns")).alias("overlap")).where(F.col("overlap") >= least)
    return counted.distinct()


def contained(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_key, target_key): chunks whose sentences another chunk holds as well.

    Among equal sets the smaller key stays.  The target is the largest holder, then the smallest
    key; it always stays itself, so one pass gives what repeated removal would.
    """
    # whoever holds all sentences of a chunk holds its rarest, so only the holders of that are looked at
    sized = _held(chunks)
    small = sized.select("document_id", F.element_at("rare", 1).alias("sentence_id"), F.col("chunk_key").alias("small"), F.col("ids").alias("small_ids"), F.col("n").alias("ns"))
    large = sized.select("document_id", F.explode("ids").alias("sentence_id"), F.col("chunk_key").alias("large"), F.col("ids").alias("large_ids"), F.col("n").alias("nl"))
    pairs = small.join(large, ["document_id", "sentence_id"]).where((F.col("nl") > F.col("ns")) | ((F.col("nl") == F.col("ns")) & (F.col("large") < F.col("small"))))
    held = pairs.where(F.size(F.array_except("small_ids", "large_ids")) == 0)
    return held.groupBy("document_id", "small").agg(F.min_by("large", F.struct(-F.col("nl"), F.col("large"))).alias("target_key")).select("document_id", F.col("small").alias("chunk_key"), "target_key")


def cleaned(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_key, ids, absorbed): chunks that stay, with the ids of the chunks they absorbed."""
    gone = written(contained(chunks), "contained")
    names = chunks.select("chunk_key", "chunk_id")
    taken = gone.join(names, "chunk_key").groupBy(F.col("target_key").alias("chunk_key")).agg(F.array_sort(F.collect_set("chunk_id")).alias("absorbed"))
    stay = chunks.join(gone.select("chunk_key"), "chunk_key", "left_anti").join(taken, "chunk_key", "left")
    return stay.select("document_id", "chunk_key", "ids", F.coalesce("absorbed", F.array().cast("array<string>")).alias("absorbed"))


def previous(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_key, previous_key): the chunk that ends right before; most sentences first."""
    ends = chunks.select("document_id", (F.array_max("ids") + 1).alias("start"), F.col("chunk_key").alias("previous_key"), F.size("ids").alias("n"), F.array_min("ids").alias("low"))
    starts = chunks.select("document_id", F.array_min("ids").alias("start"), "chunk_key")
    joined = starts.join(ends, ["document_id", "start"]).where("chunk_key <> previous_key")
    return joined.groupBy("document_id", "chunk_key").agg(F.min_by("previous_key", F.struct(-F.col("n"), F.col("low"), F.col("previous_key"))).alias("previous_key"))


def position_reasons(a: Column, b: Column, a_pages: Column, b_pages: Column, most_gap: int = 3) -> Column:
    """Why two chunks stand close: shared sentences, a small gap, the same or the next page."""
    return F.array_compact(F.array(
        F.when(F.arrays_overlap(a, b), F.lit("sentence_overlap")),
        F.when(arrays.min_gap(a, b) <= most_gap, F.lit("sentence_gap")),
        F.when(arrays.min_gap(a_pages, b_pages) <= 1, F.lit("same_or_adjacent_page")),
    ))


def neighbours(chunks: DataFrame, most_gap: int = 3) -> DataFrame:
    """(document_id, first_key, second_key, gap, reasons): each chunk and the next in order."""
    pages = F.when(F.size("page_span") > 0, F.array_sort(F.array_distinct("page_span")))
    rows = chunks.select("document_id", "chunk_key", "chunk_id", "ids", pages.alias("pages"))
    nxt = with_next(rows, ["document_id"], F.array_min("ids"), sort_key(), ["chunk_key", "ids", "pages"]).where("next IS NOT NULL")
    a, b = F.col("ids"), F.col("next.ids")
    return nxt.select("document_id", F.col("chunk_key").alias("first_key"), F.col("next.chunk_key").alias("second_key"), arrays.min_gap(a, b).alias("gap"), position_reasons(a, b, F.col("pages"), F.col("next.pages"), most_gap).alias("reasons"))


def placed(chunks: DataFrame, name: str = "place") -> DataFrame:
    """Chunks numbered from 1 within their document."""
    return numbered(chunks, ["document_id"], F.array_min("ids"), sort_key(), name)


def validation(chunks: DataFrame, least: float = 0.8) -> DataFrame:
    """(document_id, contained, duplicates, passed) for every document."""
    docs = chunks.select("document_id").distinct()
    inside = contained(chunks).groupBy("document_id").agg(F.count("*").alias("contained"))
    twice = overlapping(chunks, least).groupBy("document_id").agg(F.count("*").alias("duplicates"))
    joined = docs.join(inside, "document_id", "left").join(twice, "document_id", "left").fillna(0, ["contained", "duplicates"])
    return joined.withColumn("passed", (F.col("contained") == 0) & (F.col("duplicates") == 0))


def provenance(chunks: DataFrame) -> DataFrame:
    """(chunk_key, chunk_ids, block_ids, pages): what each chunk that stays stands for.

    Sorted distinct unions over the chunk and the chunks it absorbed.
    """
    gone = contained(chunks)
    owner = chunks.join(gone.select("chunk_key", "target_key"), "chunk_key", "left").withColumn("owner", F.coalesce("target_key", F.col("chunk_key")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return owner.groupBy(F.col("owner").alias("chunk_key")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), union("source_block_ids").alias("block_ids"), union(F.coalesce("page_span", F.array().cast("array<int>"))).alias("pages"))

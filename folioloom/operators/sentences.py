"""Paragraphs, sentences, windows of sentences and where to cut them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import arrays, text
from folioloom.operators.ordered import numbered, with_next


def paragraphs(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, paragraph_no, paragraph, heading): collapsed paragraphs; a heading's text where it is one."""
    each = documents.where(F.col(column).isNotNull()).select(key, F.posexplode(text.paragraphs(F.col(column))).alias("paragraph_no", "paragraph"))
    return each.select(key, "paragraph_no", "paragraph", text.heading_text(F.col("paragraph")).alias("heading"))


def split(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, sentence_id, sentence): running numbers over the paragraphs of each document."""
    nested = F.flatten(F.transform(text.paragraphs(F.col(column)), text.sentences))
    return documents.where(F.col(column).isNotNull()).select(key, F.posexplode(nested).alias("sentence_id", "sentence"))


def current(sentences: DataFrame) -> DataFrame:
    """One row per sentence with its page: the page, else the index plus one; blank texts are left out.

    Rows that land twice agree; where they don't, the least text wins.
    """
    flat = sentences.select("document_id", "sentence_id", text.collapse(F.col("text")).alias("text"), F.coalesce(F.col("page").cast("int"), (F.col("page_index") + 1).cast("int")).alias("page")).where("text <> ''")
    return flat.groupBy("document_id", "sentence_id").agg(F.min("text").alias("text"), F.min("page").alias("page"))


def _into_windows(placed: DataFrame, group: str, at: str, span: int, width: int, step: int) -> DataFrame:
    """Rows numbered from 0 in ``at``, once for each window that holds them and ``span - 1`` followers."""
    last = placed.groupBy(group).agg(F.greatest(F.lit(0), F.ceil((F.max(at) + span - width) / F.lit(step))).cast("int").alias("last"))
    first = F.greatest(F.lit(0), F.ceil((F.col(at) + span - width) / F.lit(step))).cast("int")
    until = F.least(F.floor(F.col(at) / F.lit(step)).cast("int"), F.col("last"))
    return placed.join(last, group).where(first <= until).withColumn("block_id", F.explode(F.sequence(first, until))).drop("last")


def windows(sentences: DataFrame, width: int = 6, step: int = 4) -> DataFrame:
    """(document_id, block_id, sentence_ids): sliding windows over the sentences of each document.

    Numbered rows go straight to the windows that hold them, so no document is gathered whole.
    A step above the width leaves sentences out.
    """
    placed = numbered(sentences.select("document_id", "sentence_id"), ["document_id"], F.col("sentence_id"), [F.col("sentence_id")], "at").withColumn("at", F.col("at") - 1)
    return _into_windows(placed, "document_id", "at", 1, width, step).groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list("sentence_id")).alias("sentence_ids"))


def config_windows(sentences: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, document_id, block_id, sentence_ids): the windows of every document under each configuration.

    A null ``step_size`` is the window less its overlap.  Only the few configurations are crossed
    with the numbered sentences.
    """
    step = F.coalesce("step_size", F.col("window_size") - F.col("overlap"))
    sizes = configs.select("config_id", F.col("window_size").alias("width"), step.alias("step"))
    placed = numbered(sentences.select("document_id", "sentence_id"), ["document_id"], F.col("sentence_id"), [F.col("sentence_id")], "at").withColumn("at", F.col("at") - 1)
    end = F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("width")) / F.col("step"))).cast("int")
    last = placed.groupBy("document_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(sizes)).select("document_id", "config_id", "width", "step", end.alias("last"))
    first = F.greatest(F.lit(0), F.ceil((F.col("at") + 1 - F.col("width")) / F.col("step"))).cast("int")
    until = F.least(F.floor(F.col("at") / F.col("step")).cast("int"), F.col("last"))
    held = placed.join(last, "document_id").where(first <= until).withColumn("block_id", F.explode(F.sequence(first, until)))
    return held.groupBy("config_id", "document_id", "block_id").agg(F.array_sort(F.collect_list("sentence_id")).alias("sentence_ids"))


def neighbour_distances(vectors: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """(group, order, distance): one minus the cosine to the next vector of the group."""
    norm = lambda c: F.sqrt(arrays.dot(c, c))
    pair = with_next(vectors.select(group, order, vector), [group], F.col(order), [F.col(order)], [vector]).where("next IS NOT NULL").select(group, order, F.col(vector).alias("a"), F.col(f"next.{vector}").alias("b"))
    return pair.select(group, order, (1 - arrays.dot(F.col("a"), F.col("b")) / (norm(F.col("a")) * norm(F.col("b")))).alias("distance"))


def breakpoints(distances: DataFrame, group: str, order: str, percentile: float = 95.0, width: int = 6, step: int = 4) -> DataFrame:
    """(group, block_id, order, distance, threshold, segment): the cuts inside each sliding window.

    ``distances`` leads from each row to the next; a window of ``width`` rows has ``width - 1`` of
    them.  A new segment starts after a distance above the window's own percentile.
    """
    placed = numbered(distances, [group], F.col(order), [F.col(order)], "at").withColumn("at", F.col("at") - 1)
    held = _into_windows(placed, group, "at", 2, width, step)
    limits = held.groupBy(group, "block_id").agg(F.percentile("distance", F.lit(percentile / 100)).alias("threshold"))
    marked = held.join(limits, [group, "block_id"]).withColumn("cut", (F.col("distance") > F.col("threshold")).cast("int"))
    before = Window.partitionBy(group, "block_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.select(group, "block_id", order, "distance", "threshold", F.coalesce(F.sum("cut").over(before), F.lit(0)).cast("int").alias("segment"))

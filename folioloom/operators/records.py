"""Index records of texts and assets, their embedding and the index table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.operators.chunks import placed
from folioloom.providers import Embedder, HashedWords


def text_records(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_key, id, index_id, content, hash, page_span): one record per chunk with a text.

    The id counts all chunks of the document, the index id only those kept, so they part where a
    text is empty.  A chunk with a text but no page span is an error of the data; it is kept with
    a null span and counted by ``without_span``.
    """
    named = placed(chunks, "place").withColumn("id", F.format_string("text_%06d", "place"))
    kept = placed(named.where(F.coalesce(F.trim("text"), F.lit("")) != ""), "index_id")
    return kept.select("document_id", "chunk_key", "id", "index_id", F.col("text").alias("content"), F.md5("text").alias("hash"), "page_span")


def without_span(records: DataFrame) -> DataFrame:
    return records.groupBy("document_id").agg(F.count_if(F.col("page_span").isNull()).alias("without_span"))


def asset_records(enriched: DataFrame, manifest: DataFrame) -> DataFrame:
    """(document_id, asset_kind, id, filename, title, content, hash, page, bbox, crop_bbox).

    Enrichment results (document_id, asset_kind, position, filename, title, content) drive; empty
    names and contents are skipped.  ``page`` stays null where the manifest has no such file.
    """
    kept = enriched.where((F.coalesce(F.col("filename"), F.lit("")) != "") & (F.coalesce(F.col("content"), F.lit("")) != ""))
    places = manifest.groupBy("document_id", "filename").agg(F.max_by(F.struct("page", "bbox", "crop_bbox"), "asset_index").alias("m"))
    joined = kept.join(places, ["document_id", "filename"], "left")
    return joined.select("document_id", "asset_kind", F.format_string("%s_%06d", "asset_kind", F.col("position").cast("int")).alias("id"), "filename", "title", "content", F.md5("content").alias("hash"), "m.page", "m.bbox", "m.crop_bbox")


def embed(records: DataFrame, text: Column, embedder: Embedder | None = None) -> DataFrame:
    """Records with ``embedding``, computed in Arrow batches by the embedder."""
    model = embedder or HashedWords()
    source = records.withColumn("_text", F.coalesce(text, F.lit("")))
    schema = T.StructType([*records.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array(model.encode(batch.column(batch.num_columns - 1).to_pylist()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], "embedding"])

    return source.mapInArrow(run, schema)


def embedding_text(modality: Column, title: Column, content: Column) -> Column:
    """What is embedded of a record: a text's content, an asset's title and content."""
    return F.when(modality == "text", content).otherwise(F.concat_ws("\n", F.nullif(F.coalesce(title, F.lit("")), F.lit("")), content))


def write_index(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records with vectors as Parquet by document and modality, for partition pruning.

    Small partitions are put together and a large document is split over several files and tasks.
    """
    records.hint("rebalance", "document_id", "modality").write.mode(mode).partitionBy("document_id", "modality").parquet(path)


def manifest_stats(records: DataFrame) -> DataFrame:
    """(document_id, modality, count, dimension) of an index."""
    return records.groupBy("document_id", "modality").agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dimension"))

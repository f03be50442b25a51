"""Continuous ingestion of blocks; an addition to the batch operators.

Blocks arrive as files.  Late repeats of a block are dropped within the watermark, and the
filtered text of each micro-batch is appended by filing and page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from folioloom.operators import blocks

#: Parts by filing into which kept blocks fall, so that a micro-batch reads few of them again.
BUCKETS = 64


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))  # watermarks need a zone


def once(frame: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first landing of every (filing, page, block); state is bounded by the watermark."""
    return frame.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["document_id", "page_index", "block_id"])


def label_counts(frame: DataFrame, width: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(start, label, n): blocks per label and window of ingestion time."""
    label = F.lower(F.trim(F.coalesce("block_label", F.lit("<missing>"))))
    counted = frame.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", width), label.alias("label")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "label", "n")


def write_text(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the Markdown of every page that a micro-batch touches, from all blocks of the page so far.

    Blocks are kept under ``blocks`` and pages under ``pages``, both by batch; the last batch of a
    page counts (``read_text``).  A repeated batch overwrites its own folders only.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/batch={number}")
        mine = spark.read.parquet(f"{path}/blocks/batch={number}").select("bucket", "document_id", "page_index").distinct()
        schema = StructType([*batch.schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
        # only the buckets of filings in this batch are read again
        buckets = [r.bucket for r in mine.select("bucket").distinct().collect()]
        held = spark.read.schema(schema).parquet(f"{path}/blocks").where((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        touched = held.drop("batch", "bucket").join(mine.drop("bucket"), ["document_id", "page_index"], "left_semi")
        blocks.markdown(blocks.fields(touched)).write.mode("overwrite").parquet(f"{path}/pages/batch={number}")

    return frame.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, page_index, markdown, blocks) of every page as its last batch left it."""
    rows = spark.read.parquet(f"{path}/pages")
    return rows.groupBy("document_id", "page_index").agg(F.max_by(F.struct("markdown", "blocks"), "batch").alias("r")).select("document_id", "page_index", "r.*")

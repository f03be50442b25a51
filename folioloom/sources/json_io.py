"""JSON and JSON-lines tables with explicit schemas, and single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.text import collapse

MANIFEST = (
    "asset_index INT, asset_kind STRING, asset_label STRING, filename STRING, page INT, page_index INT, bbox ARRAY<DOUBLE>, asset_bbox ARRAY<DOUBLE>, title STRING, "
    "title_label STRING, title_bbox ARRAY<DOUBLE>, crop_bbox ARRAY<DOUBLE>, asset_path STRING"
)
INDEX_RECORD = "id STRING, source_file STRING, modality STRING, page INT, page_span ARRAY<INT>, bbox ARRAY<DOUBLE>, asset_path STRING, title STRING, content STRING, hash STRING, faiss_id BIGINT"
SENTENCE = "sentence_id BIGINT, text STRING, page INT, page_index INT"


def _names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, lines that are no JSON become rows of nulls."""
    return spark.read.schema(schema).json(path)


def _in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their place (file, line); the files of one document are small and are read whole."""
    held = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return held.where(F.trim("line") != "").select(F.struct("file", "at").alias("place"), F.from_json("line", schema).alias("r")).select("place", "r.*")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Saved sentences (document_id, sentence_id, text, page): items are normalised as a fresh split would be.

    A page is the given page, else the page index plus one; blank texts are left out; of rows that
    share an id the first in file order counts.
    """
    rows = _in_order(spark, path, "document_id STRING, " + SENTENCE)
    page = F.coalesce("page", F.col("page_index") + 1).cast("int")
    kept = rows.withColumn("text", collapse(F.col("text"))).where("text <> '' AND sentence_id IS NOT NULL")
    return kept.groupBy("document_id", "sentence_id").agg(F.min_by(F.struct("text", page.alias("page")), "place").alias("r")).select("document_id", "sentence_id", "r.*")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The asset manifest: the last row of a file name counts; a row without name, box or page is an error."""
    rows = _in_order(spark, path, MANIFEST).withColumn("bbox", F.coalesce("bbox", "asset_bbox"))
    sound = (F.coalesce(F.col("filename"), F.lit("")) != "") & F.col("bbox").isNotNull() & F.col("page").isNotNull()
    checked = rows.withColumn("filename", F.when(sound, F.col("filename")).otherwise(F.raise_error(F.lit("manifest row without filename, bbox or page"))))
    rest = [c for c in _names(MANIFEST) if c != "filename"]
    return checked.groupBy("filename").agg(F.max_by(F.struct(*rest), "place").alias("r")).select("filename", "r.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index records by id; the last row of an id counts, a row without one is an error."""
    rows = _in_order(spark, path, INDEX_RECORD)
    checked = rows.withColumn("faiss_id", F.coalesce("faiss_id", F.raise_error(F.lit("index record without id")).cast("bigint")))
    rest = [c for c in _names(INDEX_RECORD) if c != "faiss_id"]
    return checked.groupBy("faiss_id").agg(F.max_by(F.struct(*rest), "place").alias("r")).select("faiss_id", "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def write_lines(frame: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing target is an error before any work unless ``overwrite``."""
    frame.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_texts(frame: DataFrame, path: str, name: str, value: str, overwrite: bool = False) -> None:
    """One folder of text per value of ``name``; the partition column carries the name."""
    frame.select(name, F.col(value).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(name).text(path, lineSep="\n\n")

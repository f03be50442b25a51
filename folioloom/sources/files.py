"""Listing files and pairing them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: image file extensions
IMAGES = ("png", "jpg", "jpeg", "webp")


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, folder, stem, extension, length, modified) of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"))


def document_pairs(files: DataFrame, require_markdown: bool = True) -> DataFrame:
    """(json, markdown): result files with the Markdown of the same stem; derived ``_text`` files are left out."""
    left = files.where((F.col("extension") == "json") & ~F.col("stem").endswith("_text")).select(F.col("path").alias("json"), "folder", "stem")
    right = files.where("extension = 'md'").select(F.col("path").alias("markdown"), "folder", "stem")
    return left.join(right, ["folder", "stem"], "inner" if require_markdown else "left").select("json", "markdown")


def asset_jobs(files: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """(json, pdf): each result file with the PDF of its stem; derived ``_text`` files are left out.

    A missing PDF stays null, or is an error that names the file where ``strict``.
    """
    left = files.where((F.col("extension") == "json") & ~F.col("stem").endswith("_text")).select(F.col("path").alias("json"), "stem")
    right = documents.where("extension = 'pdf'").select(F.col("path").alias("pdf"), "stem")
    pdf = F.coalesce("pdf", F.raise_error(F.concat(F.lit("no PDF for "), F.col("json"))).cast("string")) if strict else F.col("pdf")
    return left.join(right, "stem", "left").select("json", pdf.alias("pdf"))


def images(files: DataFrame) -> DataFrame:
    return files.where(F.col("extension").isin(*IMAGES)).select("path", F.concat("stem", F.lit("."), "extension").alias("filename"))


def by_size(files: DataFrame) -> DataFrame:
    """Input documents, small ones first."""
    return files.where(F.col("extension").isin("pdf", *IMAGES)).orderBy("length", F.lower("stem"), "path")

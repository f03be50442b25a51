"""Access to Parquet tables that live side by side in one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Read ``<directory>/<name>.parquet``, keeping only ``columns`` when given.

    The projection sits directly on the scan, so unused columns never leave the files.
    """
    frame = spark.read.parquet(f"{directory}/{name}.parquet")
    return frame.select(*columns) if columns else frame

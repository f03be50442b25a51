"""Intermediate results that survive the loss of an executor.

Iterative plans cut their lineage through a table written under the folder named by
``spark.checkpoint.dir``.  The folder is shared by all executors, so a lost executor
costs nothing but its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a temporary folder is used, but only in local mode; on a
    cluster a machine-local folder would be invisible to other executors, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="folioloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}") if spark.conf.isModifiable("spark.checkpoint.dir") else None
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


_MADE: list[str] = []


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables of this driver; for long sessions, once no result needs them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _MADE:
        where = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(where.getFileSystem(conf).delete(where, True))
    return gone


def written(frame: DataFrame, label: str = "step") -> DataFrame:
    """Write ``frame`` once to the shared folder and return the table read back.

    Zstandard-compressed Parquet keeps the disk share small.  The table is removed by
    ``clear``, or when the driver's file system closes.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/folioloom/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    _MADE.append(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(frame.schema).parquet(path)

"""Cutting a plan's lineage for operators that go round: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir: executors don't share a temporary folder of one machine")
        found = f"file://{tempfile.gettempdir()}/docloom-checkpoints"
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read back: later rounds don't repeat what made it, and its rows outlive lost executors. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone: the folder's owner clears it
        return

"""Steps that are written once and read as often as needed, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, in the warehouse, or on one machine in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="spark-lakeops-")
        spark.sparkContext.setCheckpointDir(base)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{base}/lakeops/{name}-{uuid.uuid4().hex}"


def stage_result(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows, written and read again: a step that is used twice runs once, and lost executors cost no more than its files."""
    path, schema = shared_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store it lies; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Tables that a query writes between its jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (as in tests), a fresh local folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cubetally-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: what follows does not recompute it, and it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

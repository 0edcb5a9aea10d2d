"""Region counts kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubetally.operators import regions
from cubetally.plans.schema import Layout


def start(stream: DataFrame, layout: Layout, path: str, checkpoint: str):
    """Each micro-batch is counted once and appended as a delta; the checkpoint makes a batch count exactly once.

    A batch that is replayed overwrites its own folder.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        regions.region_table(batch, layout).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, layout: Layout, path: str) -> DataFrame:
    """The merged table of all deltas so far."""
    return spark.read.parquet(path).groupBy("lvl", "gid", *layout.columns).agg(F.sum("n").alias("n"))


def windowed_counts(stream: DataFrame, time: str, late: str, window: str, by: list[str]) -> DataFrame:
    """Counts a window and group with a watermark; rows later than ``late`` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))

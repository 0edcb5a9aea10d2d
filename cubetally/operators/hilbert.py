"""Hilbert curve indices as column arithmetic, and the index ranges of a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def encode(x: Column, y: Column, bits: int) -> Column:
    """Index of a point of the 2**bits square: one quadrant a bit, rotated and flipped on the way down.

    The state travels as a struct through a fold over the bits, so the expression stays small for any ``bits``.
    """
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        rx = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0)
        ry = F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        last = F.lit((1 << bits) - 1)
        fx = F.when((ry == 0) & (rx == 1), last - s["x"]).otherwise(s["x"])
        fy = F.when((ry == 0) & (rx == 1), last - s["y"]).otherwise(s["y"])
        return F.struct((s["d"] + side * side * (3 * rx).bitwiseXOR(ry)).cast("long").alias("d"), F.when(ry == 0, fy).otherwise(fx).cast("long").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["d"]


def box_points(spark, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    return spark.range(lo[0], hi[0] + 1).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(lo[1]).cast("long"), F.lit(hi[1]).cast("long"))).alias("y"))


def border(points: DataFrame, lo: tuple[int, int], hi: tuple[int, int]) -> DataFrame:
    """The points on the surface of a box."""
    return points.where(F.col("x").isin(lo[0], hi[0]) | F.col("y").isin(lo[1], hi[1]))


def ranges(points: DataFrame, bits: int) -> DataFrame:
    """(start, end): maximal runs of consecutive indices, by gaps and islands."""
    h = points.select(encode(F.col("x"), F.col("y"), bits).alias("h")).distinct()
    w = Window.orderBy("h")  # the points of one query box
    runs = h.select("h", (F.col("h") - F.row_number().over(w)).alias("run"))
    return runs.groupBy("run").agg(F.min("h").alias("start"), F.max("h").alias("end")).drop("run")

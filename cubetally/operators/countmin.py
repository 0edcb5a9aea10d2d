"""Count-Min sketches as long tables (sketch columns, row, col, cnt)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubetally.functions.hashing import HashFamily, key_hash


def dimensions(eps: float, delta: float) -> tuple[int, int]:
    """(width, depth) for an error of eps times the total with chance 1 - delta."""
    return math.ceil(math.e / eps), math.ceil(math.log(1 / delta))


def keyed(df: DataFrame, key: Column, weight: str | None = "n") -> DataFrame:
    return df.withColumn("h", key_hash(key)).withColumn("w", F.col(weight) if weight else F.lit(1).cast("long"))


def cells(df: DataFrame, key: Column, family: HashFamily, weight: str | None = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, cnt): keys are added up before they fan out over the rows."""
    grouped = keyed(df, key, weight).groupBy(*by, "h").agg(F.sum("w").alias("w"))
    spread = grouped.select(*by, "w", F.posexplode(family.positions(F.col("h"))).alias("row", "col"))
    return spread.groupBy(*by, "row", "col").agg(F.sum("w").cast("long").alias("cnt"))


def merged(tables: list[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables).groupBy(*by, "row", "col").agg(F.sum("cnt").cast("long").alias("cnt"))


def point_estimates(keys: DataFrame, key: Column, sketch: DataFrame, family: HashFamily, by: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` (any columns, distinct) with est: the least of the cells of the key."""
    cols = keys.columns
    probes = keys.select("*", F.posexplode(family.positions(key_hash(key))).alias("row", "col"))
    joined = probes.join(sketch, [*by, "row", "col"], "left")
    return joined.groupBy(*cols).agg(F.min(F.coalesce("cnt", F.lit(0))).cast("long").alias("est"))


def dense(spark, family: HashFamily) -> DataFrame:
    """All (row, col) cells."""
    return spark.range(family.depth * family.width).select(F.floor(F.col("id") / family.width).cast("int").alias("row"), (F.col("id") % family.width).alias("col"))

"""K-minimum-value samples, distinct samples and conjunctions over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubetally.functions.hashing import HashFamily, key_hash


def kmin(df: DataFrame, by: list[str], h: str, k: int) -> DataFrame:
    """(by, h): the k least distinct hashes of each group; n_seen: rows of the group.

    A partial aggregate keeps distinct hashes, so a hot group is thinned before it meets in one window.
    """
    once = df.groupBy(*by, h).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    ranked = once.select("*", F.row_number().over(w.orderBy(h)).alias("rank"), F.sum("n").over(w).cast("long").alias("n_seen"))
    return ranked.where(F.col("rank") <= k).select(*by, h, "n_seen")


def merged_kmin(a: DataFrame, b: DataFrame, by: list[str], h: str, k: int | None = None) -> DataFrame:
    """Union of two samples, cut to the k least hashes when k is given."""
    every = a.select(*by, h).unionByName(b.select(*by, h)).distinct()
    if k is None:
        return every
    return every.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(h))).where(F.col("rank") <= k).drop("rank")


def geometric_level(x: Column, bits: int) -> Column:
    """Level of a hash of ``bits`` bits: the number of its leading zero bits; a level halves the chance of the one before."""
    return F.lit(bits) - F.length(F.bin(x))


def distinct_sample(df: DataFrame, by: list[str], h: str, capacity: int, bits: int) -> DataFrame:
    """(by, h, level): distinct hashes at or above the least level at which the group fits ``capacity``."""
    once = df.select(*by, h).distinct().withColumn("level", geometric_level(F.col(h), bits))
    per_level = once.groupBy(*by, "level").agg(F.count("*").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("level"))
    fits = per_level.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") <= capacity).groupBy(*by).agg(F.min("level").alias("least"))
    return once.join(fits, by).where(F.col("level") >= F.col("least")).select(*by, h, "level", "least")


def omni_cells(df: DataFrame, attributes: list[str], record: Column, family: HashFamily, k: int) -> DataFrame:
    """(attribute, row, col, h, n_seen): each cell of each attribute keeps a sample of its records."""
    tall = df.select(key_hash(record).alias("h"), F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("x")).select("h", "x.*")
    spread = tall.select("attribute", "h", F.posexplode(family.positions(key_hash(F.concat_ws("=", "attribute", "value")))).alias("row", "col"))
    return kmin(spread, ["attribute", "row", "col"], "h", k)


def omni_estimate(cells: DataFrame, wanted: list[tuple[str, list[str]]], spark, family: HashFamily, k: int, eps: float, delta: float, bits: int = 60) -> DataFrame:
    """(n_max, s_cap, est) of a conjunction: each attribute's values (or range blocks) give cells, all must share a record."""
    values = spark.createDataFrame([(a, v) for a, vs in wanted for v in vs], "attribute string, value string")
    probes = values.select("attribute", F.posexplode(family.positions(key_hash(F.concat_ws("=", "attribute", "value")))).alias("row", "col")).distinct()
    got = cells.join(F.broadcast(probes), ["attribute", "row", "col"])
    n_max = got.select("attribute", "row", "col", "n_seen").distinct().groupBy("attribute", "row").agg(F.sum("n_seen").alias("n")).agg(F.max("n").alias("n_max"))
    need = len(wanted) * family.depth
    s_cap = got.select("attribute", "row", "h").distinct().groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") == need).agg(F.count("*").alias("s_cap"))
    blocks = k * len(wanted[-1][1])
    spread = math.log(4 * len(wanted) * family.depth * math.sqrt(blocks) / delta)
    enough = F.col("s_cap") >= 3 * spread / eps**2
    est = F.when(enough, F.ceil(F.col("s_cap") * F.col("n_max") / blocks)).otherwise(F.ceil(2 * F.col("n_max") * spread / (blocks * eps**2)))
    return n_max.crossJoin(s_cap).select(F.col("n_max").cast("long").alias("n_max"), F.col("s_cap").cast("long").alias("s_cap"), est.cast("long").alias("est"))  # one row each

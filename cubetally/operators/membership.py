"""Membership structures: exact node sets, Bloom filters and value bitmaps, as tables."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubetally.functions.hashing import HashFamily, key_hash
from cubetally.plans.schema import floor_div

EXACT_UNDER = 10_000


def bloom_dimensions(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n values at a false positive rate of p."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def bloom(df: DataFrame, key: Column, family: HashFamily) -> DataFrame:
    """(pos): the set bits; keys are made distinct before they fan out."""
    hashes = df.select(key_hash(key).alias("h")).distinct()
    return hashes.select(F.explode(family.positions(F.col("h"))).alias("pos")).distinct()


def probe(keys: DataFrame, key: Column, bits: DataFrame, family: HashFamily) -> DataFrame:
    """``keys`` (distinct) with present: all bits of the key are set."""
    cols = keys.columns
    asked = keys.select("*", F.explode(F.array_distinct(family.positions(key_hash(key)))).alias("pos"))
    got = asked.join(bits.withColumn("hit", F.lit(True)), "pos", "left")
    return got.groupBy(*cols).agg(F.every(F.coalesce("hit", F.lit(False))).alias("present"))


def merged(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables).distinct()


def nodes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The exact set of nodes."""
    return df.select(*columns).distinct()


def bitmap_exponents(df: DataFrame, columns: dict[str, int], side: int) -> DataFrame:
    """(col, e): the least exponent whose buckets of base**e keep every value within ``side`` buckets of 0."""
    tops = df.agg(*[F.max(F.greatest(F.col(c), -F.col(c))).alias(c) for c in columns])
    parts = []
    for c, base in columns.items():
        top = F.coalesce(c, F.lit(0))
        fits = [F.when(top < float(side) * float(base) ** e, e) for e in range(64 if base > 1 else 1)]
        parts.append(F.struct(F.lit(c).alias("col"), F.lit(base).cast("long").alias("base"), F.coalesce(*fits).alias("e")))
    return tops.select(F.inline(F.array(*parts)))


def bitmaps(df: DataFrame, columns: dict[str, int], side: int) -> DataFrame:
    """(col, e, bucket): used buckets floor(value / base**e) of each number; one pass for the exponents, one for the buckets."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*").distinct()
    limits = bitmap_exponents(df, columns, side)
    w = F.pow(F.col("base").cast("double"), F.col("e")).cast("long")
    # one row a column: broadcast whatever the data
    return tall.join(F.broadcast(limits), "col").select("col", "e", floor_div(F.col("v"), w).alias("bucket")).distinct()


def merged_bitmaps(tables: list[DataFrame], bases: dict[str, int]) -> DataFrame:
    """Bitmaps with the coarsest exponent of each column, buckets united."""
    every = functools.reduce(DataFrame.unionByName, tables)
    base = functools.reduce(lambda rest, c: F.when(F.col("col") == c, F.lit(bases[c])).otherwise(rest), bases, F.lit(None))
    top = every.groupBy("col").agg(F.max("e").alias("top"))
    w = F.pow(base.cast("double"), F.col("top") - F.col("e")).cast("long")
    return every.join(F.broadcast(top), "col").select("col", F.col("top").alias("e"), floor_div(F.col("bucket"), w).alias("bucket")).distinct()


def pruned(blocks: DataFrame, bits: DataFrame, base: int) -> DataFrame:
    """Blocks (lvl, idx) of one column that meet a used bucket: finer blocks look at theirs, coarser at any of theirs."""
    lo, hi = F.col("idx") * F.pow(F.lit(float(base)), F.col("lvl")), (F.col("idx") + 1) * F.pow(F.lit(float(base)), F.col("lvl"))
    w = F.pow(F.lit(float(base)), F.col("e"))
    meets = (F.col("bucket") * w < hi) & ((F.col("bucket") + 1) * w > lo)
    return blocks.join(F.broadcast(bits), meets, "left_semi")

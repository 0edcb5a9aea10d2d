"""Approximate region sketches: counters a level, category and block indexes that prune, workload estimates.

A sketch keeps no region table.  Each level has Count-Min counters over its regions (or, where it is sparse, the
exact counts), and two small indexes say which category prefixes and which blocks of each number occur at all.
A query's boxes become candidate regions by equi-joins with these indexes, every candidate is looked up in its
level's counters, and a query's estimate is the sum.  All parts are tables, so a stored sketch answers alike.

Cases: a query of wildcards alone gets the number of rows; one whose candidates all fall away gets 0; null values
of a column are a category or block that no predicate selects; an empty table gives 0 for every query.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.functions.hashing import HashFamily, key_hash
from cubetally.operators import regions
from cubetally.operators.countmin import dimensions
from cubetally.plans.predicates import Query
from cubetally.plans.schema import Layout, level_index
from cubetally.sources import store


@dataclass(frozen=True)
class Config:
    """A layout and the counters of each level, lowest first; None makes a level sparse (exact counts)."""

    layout: Layout
    families: tuple[HashFamily | None, ...]


def uniform(layout: Layout, eps: float, delta: float, n_sparse: int = 0, seed: int = 7) -> Config:
    """The same size on every level; the top ``n_sparse`` levels, which have few regions, are sparse."""
    width, depth = dimensions(eps, delta)
    dense = layout.levels - n_sparse
    return Config(layout, tuple(HashFamily(depth, width, seed + l) if l < dense else None for l in range(layout.levels)))


def decreasing(layout: Layout, eps: float, delta: float, factor: int = 2, seed: int = 7) -> Config:
    """Widths that fall by ``factor`` a level, as higher levels have fewer regions."""
    width, depth = dimensions(eps, delta)
    return Config(layout, tuple(HashFamily(depth, max(2, math.ceil(width / factor**l)), seed + l) for l in range(layout.levels)))


def region_key(layout: Layout) -> Column:
    return F.concat_ws("|", F.col("gid").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in layout.columns])


def _spread(df: DataFrame, config: Config) -> DataFrame:
    """One row a counter of each region (columns lvl and h) of the levels with counters."""
    dense = [(l, f) for l, f in enumerate(config.families) if f is not None]
    if not dense:
        return df.limit(0).select("*", F.lit(0).alias("row"), F.lit(0).cast("long").alias("col"))
    cells = functools.reduce(lambda rest, lf: F.when(F.col("lvl") == lf[0], lf[1].positions(F.col("h"))).otherwise(rest), dense, F.lit(None).cast("array<bigint>"))
    return df.select("*", F.posexplode(cells).alias("row", "col"))


def build(rows: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The parts of a sketch: counters, exact counts of sparse levels, category prefixes, used blocks."""
    layout = config.layout
    at = regions.region_table(rows, layout).select("lvl", key_hash(region_key(layout)).alias("h"), "n")
    sparse = [l for l, f in enumerate(config.families) if f is None]
    counters = _spread(at.where(~F.col("lvl").isin(sparse)) if sparse else at, config).groupBy("lvl", "row", "col").agg(F.sum("n").cast("long").alias("cnt"))
    exact = at.where(F.col("lvl").isin(sparse) if sparse else F.lit(False))
    found = rows.groupBy(*layout.cats).agg(F.count("*").alias("n")) if layout.cats else rows.agg(F.count("*").alias("n"))
    prefixes = functools.reduce(DataFrame.unionByName, [found.select(F.lit(p).alias("prefix"), *[(F.col(c) if i < p else F.lit(None).cast("string")).alias(c) for i, c in enumerate(layout.cats)]).distinct() for p in layout.prefixes()])
    used = [F.struct(F.lit(n).alias("num"), F.lit(l).alias("lvl"), level_index(F.col(n), b, l).alias("idx")) for n, b in zip(layout.nums, layout.bases, strict=True) for l in range(layout.levels)]
    blocks = rows.select(F.explode(F.array(*used)).alias("x")).select("x.*").where("idx is not null").distinct()
    return {"counters": counters, "exact": exact, "prefixes": prefixes, "blocks": blocks, "total": rows.agg(F.count("*").alias("n"))}


def candidates(parts: dict[str, DataFrame], config: Config, queries: list[Query]) -> DataFrame:
    """(query_id, lvl, gid, columns) of the regions in the queries' boxes whose prefix and blocks occur."""
    layout = config.layout
    plan = regions.Plan(queries, layout)
    prefix_of = {gid: p for (_, gid), (p, _) in plan.slices.items()}
    boxes = plan.table(parts["blocks"].sparkSession)
    gids = functools.reduce(lambda rest, g: F.when(F.col("gid") == g, prefix_of[g]).otherwise(rest), prefix_of, F.lit(-1))
    out = boxes.withColumn("prefix", gids).join(parts["prefixes"], "prefix")
    for c in layout.cats:
        out = out.where(F.coalesce(F.array_contains(f"p_{c}", F.col(c)), F.col(f"p_{c}").isNull()))
    for n in layout.nums:
        # a cover's run of blocks in one number is short at all levels but the top
        wanted = out.withColumn("idx", F.explode(F.when(F.col(f"lo_{n}").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(f"lo_{n}", f"hi_{n}"))))
        used = parts["blocks"].where(F.col("num") == n).select("lvl", "idx", F.lit(True).alias("is_used"))
        out = wanted.join(used, ["lvl", "idx"], "left").where("idx is null or is_used").withColumnRenamed("idx", n).drop("is_used")
    return out.select("query_id", "lvl", "gid", *layout.columns)


def estimates(parts: dict[str, DataFrame], config: Config, queries: list[Query]) -> DataFrame:
    """(query_id, estimate, n_boxes, n_candidates): a workload answered from the sketch alone."""
    spark = parts["blocks"].sparkSession
    layout = config.layout
    asked = [(i, q) for i, q in enumerate(queries) if q]
    ids = spark.createDataFrame([(i, not q) for i, q in enumerate(queries)], "query_id long, is_all boolean")
    plan = regions.Plan([q for _, q in asked], layout)
    numbered = spark.createDataFrame([(k, i, plan.n_boxes[k]) for k, (i, _) in enumerate(asked)], "k long, query_id long, n_boxes long")
    found = candidates(parts, config, [q for _, q in asked]).withColumnRenamed("query_id", "k")
    found = found.select("k", "lvl", key_hash(region_key(layout)).alias("h"))
    by_counter = _spread(found, config).join(parts["counters"], ["lvl", "row", "col"], "left").groupBy("k", "lvl", "h").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))
    sparse = [l for l, f in enumerate(config.families) if f is None]
    if sparse:
        by_counter = by_counter.unionByName(found.where(F.col("lvl").isin(sparse)).join(parts["exact"], ["lvl", "h"], "left").select("k", "lvl", "h", F.coalesce("n", F.lit(0)).alias("est")))
    each = by_counter.groupBy("k").agg(F.sum("est").cast("long").alias("estimate"), F.count("*").alias("n_candidates"))
    each = numbered.join(each, "k", "left").drop("k")
    total = F.lit(parts["total"].first()["n"])
    return ids.join(each, "query_id", "left").select("query_id", F.coalesce(F.when(F.col("is_all"), total).otherwise(F.col("estimate")), F.lit(0)).cast("long").alias("estimate"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def evaluated(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a query: true count, estimate, errors, boxes and candidates (V1)."""
    total = F.abs(F.col("estimate") - F.col("n"))
    return estimated.join(truth, "query_id").select("query_id", F.col("n").alias("true_count"), "estimate", total.alias("absolute_error"), F.round(total / F.greatest(F.col("n"), F.lit(1)), 9).alias("relative_error"), "n_boxes", "n_candidates")


def save(parts: dict[str, DataFrame], config: Config, path: str) -> None:
    """All parts and the hash families, so that the stored sketch can be probed."""
    spark = parts["blocks"].sparkSession
    families = json.dumps([None if f is None else [f.depth, f.width, f.seed] for f in config.families])
    store.save_sketch(path, config.layout, parts["total"].first()["n"], parts)
    spark.createDataFrame([(families,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/families")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], Config]:
    layout, _, found = store.load_sketch(spark, path)
    readers: dict[str, Callable[[], DataFrame]] = found
    families = json.loads(spark.read.text(f"{path}/families").first()["value"])
    return {name: read() for name, read in readers.items()}, Config(layout, tuple(None if f is None else HashFamily(*f) for f in families))

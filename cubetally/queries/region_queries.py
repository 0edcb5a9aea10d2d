"""Region tables, estimates from them, merges, bounds and the spatial variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.operators import regions
from cubetally.plans import badic, predicates
from cubetally.plans.schema import Layout, level_index
from cubetally.queries.fixtures import CUST, CUST_QUERIES, CUST_SQL, LI, LI_SMALL, LI_SQL, QUERIES, counts_sql, cust, li, regions_sql, where_sql

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("region_counts", f"WITH {LI_SQL}, {regions_sql(LI_SMALL, 'g', 'li')} SELECT lvl, gid, c0, c1, i0, i2, n FROM g")
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return regions.region_table(li(spark, sf), LI_SMALL)


@query("region_counts_level_summary", f"WITH {LI_SQL}, {regions_sql(LI, 'g', 'li')} SELECT lvl, gid, count(*) AS n_regions, CAST(sum(n) AS BIGINT) AS n_updates, max(n) AS most FROM g GROUP BY lvl, gid")
def region_counts_level_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = regions.region_table(li(spark, sf), LI)
    return g.groupBy("lvl", "gid").agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("n_updates"), F.max("n").alias("most"))


@query("region_estimate", f"WITH {LI_SQL} SELECT query_id, n AS true_count, n AS estimate FROM ({counts_sql(QUERIES, 'li')})")
def region_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """With exact stores the sum over a cover is the count itself."""
    rows = li(spark, sf)
    return regions.estimates(rows, QUERIES, LI).join(predicates.count_each(rows, QUERIES, LI), "query_id").select("query_id", F.col("n").alias("true_count"), "estimate")


@query("region_estimate_negatives", f"WITH {CUST_SQL} SELECT query_id, n AS estimate FROM ({counts_sql(CUST_QUERIES, 'cu')})")
def region_estimate_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return regions.estimates(cust(spark, sf), CUST_QUERIES, CUST).select("query_id", "estimate")


def _details_sql() -> str:
    """Boxes of the second query of the workload, their regions and their rows, level by level."""
    parts = []
    plan = regions.Plan([QUERIES[1], QUERIES[3]], LI)
    for q, level, gid, *_ in sorted({(r[0], r[1], r[2]) for r in plan.rows}):
        own = [r for r in plan.rows if r[0] == q and r[1] == level]
        names = [n for n, i in (("i0", 6), ("i1", 8), ("i2", 10)) if own[0][i] is not None]
        at = {"i0": 6, "i1": 8, "i2": 10}
        idx = {n: f"CAST(floor({n} / {b**level}.0) AS BIGINT)" for n, b in zip(LI.nums, LI.bases, strict=True)}
        within = " OR ".join("(" + " AND ".join(f"{idx[n]} BETWEEN {r[at[n]]} AND {r[at[n] + 1]}" for n in names) + ")" for r in own)
        cats = {1: ["c0", "c1"]}.get(0 if q == 1 else 1, [])
        keep = " AND c1 = 'F'" if q == 0 else ""
        keys = [*cats, *[idx[n] for n in names]]
        parts.append(f"SELECT CAST({q} AS BIGINT) AS query_id, {level} AS lvl, count(*) AS n_regions, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM li WHERE ({within}){keep} GROUP BY {', '.join(keys)})")
    return " UNION ALL ".join(parts)


@query("region_estimate_details", f"WITH {LI_SQL}, d AS ({_details_sql()}) SELECT * FROM d WHERE n_regions > 0")
def region_estimate_details(spark: SparkSession, sf: str) -> DataFrame:
    """Regions read and rows counted, by query and level."""
    plan = regions.Plan([QUERIES[1], QUERIES[3]], LI)
    hit = plan.hits(plan.slice_counts(li(spark, sf)))
    return hit.groupBy("query_id", "lvl").agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("n_rows"))


@query("region_merge", f"WITH {LI_SQL}, {regions_sql(LI_SMALL, 'g', 'li')} SELECT lvl, gid, c0, c1, i0, i2, n FROM g")
def region_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Four parts, counted apart and merged, give the table of the whole."""
    rows = li(spark, sf)
    return regions.merged([regions.region_table(rows.where(F.col("l_orderkey") % 4 == k), LI_SMALL) for k in range(4)], LI_SMALL)


@query("region_tables_equal", "SELECT CAST(0 AS BIGINT) AS n_different")
def region_tables_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Regions in which a table and its merged parts differ, both ways."""
    rows = li(spark, sf)
    whole, parts = regions.region_table(rows, LI_SMALL), regions.merged([regions.region_table(rows.where(F.col("l_orderkey") % 2 == k), LI_SMALL) for k in range(2)], LI_SMALL)
    signed = whole.select("lvl", "gid", *LI_SMALL.columns, "n").unionByName(parts.withColumn("n", -F.col("n")))
    return signed.groupBy("lvl", "gid", *LI_SMALL.columns).agg(F.sum("n").alias("d")).agg(F.count_if(F.col("d") != 0).alias("n_different"))


@query("block_bounds", f"WITH {CUST_SQL} SELECT 'i0' AS col, CAST(floor(min(i0) / 10000.0) * 10000 AS BIGINT) AS lo, CAST((floor(max(i0) / 10000.0) + 1) * 10000 - 1 AS BIGINT) AS hi FROM cu UNION ALL SELECT 'i1', CAST(floor(min(i1) / 625.0) * 625 AS BIGINT), CAST((floor(max(i1) / 625.0) + 1) * 625 - 1 AS BIGINT) FROM cu")
def block_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return regions.block_bounds(cust(spark, sf), CUST)


SPATIAL = [{"i0": (90, 1500), "i2": (1, 20)}, {"i0": (93, 1203), "i2": (10, 33)}]


@query("spatial_sketch_estimate", f"WITH {LI_SQL} {counts_sql(SPATIAL, 'li', 'estimate')}")
def spatial_sketch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Cubes only: no categories and no wildcards."""
    layout = Layout((), ("i0", "i2"), (5, 2), 5, masks=((0, 1),))
    return regions.estimates(li(spark, sf), SPATIAL, layout).select("query_id", "estimate")


_MATRIX_SQL = " UNION ALL ".join(f"SELECT {l} AS lvl, g AS cat_level, count(*) AS n_regions, CAST(sum(n) AS BIGINT) AS n_updates FROM (SELECT CAST(bit_count(CAST(GROUPING(c0, c1, c2) AS BIGINT)) AS BIGINT) AS g, count(*) AS n FROM (SELECT c0, c1, c2, floor(i0 / {5**l}.0) AS x, floor(i2 / {2**l}.0) AS y FROM li) GROUP BY ROLLUP(c0, c1, c2), x, y HAVING TRUE) GROUP BY g" for l in range(4))


@query("matrix_sketch_cells", f"WITH {LI_SQL} {_MATRIX_SQL}")
def matrix_sketch_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One counter set for each pair of number level and category level."""
    layout = Layout(("c0", "c1", "c2"), ("i0", "i2"), (5, 2), 5, masks=((0, 1),))
    g = None
    for l in range(4):
        part = regions.level_counts(li(spark, sf), layout, l)
        g = part if g is None else g.unionByName(part)
    level = F.bit_count(F.shiftright("gid", len(layout.nums))).cast("long")
    return g.groupBy("lvl", level.alias("cat_level")).agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("n_updates"))


@query("point_sketch_estimate", f"WITH {LI_SQL} SELECT count(*) AS estimate FROM li WHERE i0 BETWEEN 300 AND 330 AND i2 BETWEEN 5 AND 9")
def point_sketch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Every point of the box looked up in a table of point counts."""
    points = spark.range(300, 331).select(F.col("id").alias("i0"), F.explode(F.sequence(F.lit(5).cast("long"), F.lit(9).cast("long"))).alias("i2"))
    counted = li(spark, sf).groupBy("i0", "i2").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(points), ["i0", "i2"]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("estimate"))

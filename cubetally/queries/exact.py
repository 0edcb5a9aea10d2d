"""Exact counts, filters, covers, masks and category prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.plans import badic, predicates
from cubetally.plans.schema import Layout, full_masks, grouping_sets, level_index, near_full_masks
from cubetally.operators.regions import level_counts
from cubetally.queries.fixtures import CUST_SQL, LI, LI_SQL, QUERIES, cust, counts_sql, li, where_sql

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("exact_count", f"WITH {LI_SQL} SELECT count(*) AS n FROM li WHERE {where_sql(QUERIES[1])}")
def exact_count(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.filter_rows(li(spark, sf), QUERIES[1], LI).agg(F.count("*").alias("n"))


@query("exact_count_batch", f"WITH {LI_SQL} {counts_sql(QUERIES, 'li')}")
def exact_count_batch(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.count_each(li(spark, sf), QUERIES, LI)


@query("filter_rows", f"WITH {LI_SQL} SELECT * FROM li WHERE {where_sql(QUERIES[0])}")
def filter_rows(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.filter_rows(li(spark, sf), QUERIES[0], LI)


@query("query_selectivity", f"WITH {LI_SQL} SELECT query_id, CAST(n AS DOUBLE) / (SELECT count(*) FROM li) AS selectivity FROM ({counts_sql(QUERIES, 'li')})")
def query_selectivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf)
    every = predicates.count_each(rows, [*QUERIES, {}], LI)
    total = every.where(F.col("query_id") == len(QUERIES)).select(F.col("n").alias("total"))
    return every.where(F.col("query_id") < len(QUERIES)).join(F.broadcast(total), F.lit(True)).select("query_id", (F.col("n") / F.col("total")).alias("selectivity"))


@query("domains_and_ranges", f"""WITH {LI_SQL} SELECT 'c0' AS col, 'cat' AS kind, count(DISTINCT c0) AS n_values, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM li
  UNION ALL SELECT 'c1', 'cat', count(DISTINCT c1), NULL, NULL FROM li UNION ALL SELECT 'c2', 'cat', count(DISTINCT c2), NULL, NULL FROM li
  UNION ALL SELECT 'i0', 'num', NULL, min(i0), max(i0) FROM li UNION ALL SELECT 'i1', 'num', NULL, min(i1), max(i1) FROM li UNION ALL SELECT 'i2', 'num', NULL, min(i2), max(i2) FROM li""")
def domains_and_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.domains_and_ranges(li(spark, sf).drop("l_orderkey"))


@query("region_predicates", f"WITH {LI_SQL} SELECT count(*) AS n FROM li WHERE c0 = 'A' AND i0 BETWEEN 250 AND 374 AND i2 BETWEEN 16 AND 23")
def region_predicates(spark: SparkSession, sf: str) -> DataFrame:
    q = predicates.of_region(["A"], 3, [2, None, 2], LI)
    return predicates.filter_rows(li(spark, sf), q, LI).agg(F.count("*").alias("n"))


@query("badic_index", f"""WITH {CUST_SQL} SELECT CAST(l AS INTEGER) AS lvl, CAST(floor(i0 / pow(10, l)) AS BIGINT) AS idx, count(*) AS n FROM cu, range(4) r(l) GROUP BY ALL""")
def badic_index(spark: SparkSession, sf: str) -> DataFrame:
    c = cust(spark, sf)
    levels = F.array(*[F.struct(F.lit(l).alias("lvl"), level_index(F.col("i0"), 10, l).alias("idx")) for l in range(4)])
    return c.select(F.inline(levels)).groupBy("lvl", "idx").agg(F.count("*").alias("n"))


RANGES = [(0, 2, 1, 6), (1, 5, 0, 24), (2, 2, -2, 1), (3, 2, -37, 91), (4, 10, 5, 2345), (5, 7, -1000, -3), (6, 3, 11, 11), (7, 4, 0, 4095)]
LEVELS = 14
_RANGES_SQL = "r(query_id, base, lo, hi) AS (VALUES " + ", ".join(f"(CAST({q} AS BIGINT), {b}::BIGINT, {lo}::BIGINT, {hi}::BIGINT)" for q, b, lo, hi in RANGES) + ")"
# a block is in the minimal cover if it lies inside the range and its parent does not
_COVER_SQL = f"""{_RANGES_SQL},
v AS (SELECT query_id, base, lo, hi, unnest(range(lo, hi + 1)) AS x FROM r),
b AS (SELECT DISTINCT query_id, base, lo, hi, l AS lvl, CAST(pow(base, l) AS BIGINT) AS w, CAST(floor(x / pow(base, l)) AS BIGINT) AS idx FROM v, range({LEVELS}) t(l) WHERE pow(base, l) <= hi - lo + 1),
cover AS (SELECT query_id, base, lo, hi, lvl, idx FROM b WHERE idx * w >= lo AND (idx + 1) * w - 1 <= hi
  AND NOT (floor(idx / base::DOUBLE) * w * base >= lo AND (floor(idx / base::DOUBLE) + 1) * w * base - 1 <= hi))"""


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "query_id long, base long, lo long, hi long")


@query("badic_cover", f"WITH {_COVER_SQL} SELECT query_id, CAST(lvl AS INTEGER) AS lvl, idx, idx * CAST(pow(base, lvl) AS BIGINT) AS low, (idx + 1) * CAST(pow(base, lvl) AS BIGINT) - 1 AS high FROM cover")
def badic_cover(spark: SparkSession, sf: str) -> DataFrame:
    c = badic.cover_table(_ranges(spark), LEVELS)
    w = F.pow("base", "lvl").cast("long")
    return c.select("query_id", "lvl", "idx", (F.col("idx") * w).alias("low"), ((F.col("idx") + 1) * w - 1).alias("high"))


@query("badic_cover_is_partition", f"WITH {_RANGES_SQL} SELECT query_id, hi - lo + 1 AS n_points, TRUE AS complete, TRUE AS disjoint FROM r")
def badic_cover_is_partition(spark: SparkSession, sf: str) -> DataFrame:
    c = badic.cover_table(_ranges(spark), LEVELS)
    w = F.pow("base", "lvl").cast("long")
    points = c.select("query_id", "lo", "hi", F.explode(F.sequence(F.col("idx") * w, (F.col("idx") + 1) * w - 1)).alias("x"))
    return points.groupBy("query_id", "lo", "hi").agg(F.count("*").alias("n"), F.count_distinct("x").alias("d"), F.min("x").alias("a"), F.max("x").alias("b")).select(
        "query_id", F.col("d").alias("n_points"), ((F.col("d") == F.col("hi") - F.col("lo") + 1) & (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi"))).alias("complete"), (F.col("n") == F.col("d")).alias("disjoint")
    )


@query("badic_lowered", f"WITH {_COVER_SQL} SELECT query_id, CAST(lvl AS INTEGER) AS lvl, idx, unnest(range(idx * CAST(pow(base, lvl - 1) AS BIGINT), (idx + 1) * CAST(pow(base, lvl - 1) AS BIGINT))) AS low_idx FROM cover WHERE lvl >= 1")
def badic_lowered(spark: SparkSession, sf: str) -> DataFrame:
    return badic.lowered(badic.cover_table(_ranges(spark), LEVELS).where("lvl >= 1"), 1).select("query_id", "lvl", "idx", "low_idx")


BOXES = [[(2, 1, 6), (5, 0, 24)], [(5, 90, 1500), (2, 1, 20)], [(2, -7, 3), (3, 2, 29)]]


@query("spatial_cover_volume", " UNION ALL ".join(f"SELECT CAST({q} AS BIGINT) AS query_id, CAST({(b[0][2] - b[0][1] + 1) * (b[1][2] - b[1][1] + 1)} AS BIGINT) AS volume" for q, b in enumerate(BOXES)))
def spatial_cover_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the box cover add up to the box."""
    rows = [(q, *[x for (b, _, _), (lo, hi) in zip(box, limits, strict=True) for x in (b**level * lo, b**level * (hi + 1) - 1)]) for q, box in enumerate(BOXES) for level, limits in badic.boxes(box, 4)]
    t = spark.createDataFrame(rows, "query_id long, a0 long, b0 long, a1 long, b1 long")
    return t.groupBy("query_id").agg(F.sum((F.col("b0") - F.col("a0") + 1) * (F.col("b1") - F.col("a1") + 1)).cast("long").alias("volume"))


def _cover_cte(name: str, base: int, lo: int, hi: int, cap: int) -> str:
    return f"""{name} AS (SELECT l AS lvl, j AS idx FROM range({cap + 1}) t(l), range({-(10**3)}, {10**4}) s(j)
      WHERE j * CAST(pow({base}, l) AS BIGINT) >= {lo} AND (j + 1) * CAST(pow({base}, l) AS BIGINT) - 1 <= {hi}
      AND (l = {cap} OR NOT (floor(j / {base}.0) * pow({base}, l + 1) >= {lo} AND (floor(j / {base}.0) + 1) * pow({base}, l + 1) - 1 <= {hi})))"""


def _boxes_sql() -> str:
    parts = []
    for q, ((b0, l0, h0), (b1, l1, h1)) in enumerate(BOXES):
        parts.append(f"""SELECT * FROM (WITH {_cover_cte('x', b0, l0, h0, 4)}, {_cover_cte('y', b1, l1, h1, 4)}
          SELECT CAST({q} AS BIGINT) AS query_id, least(x.lvl, y.lvl) AS lvl, x.idx * CAST(pow({b0}, x.lvl - least(x.lvl, y.lvl)) AS BIGINT) AS lo0, (x.idx + 1) * CAST(pow({b0}, x.lvl - least(x.lvl, y.lvl)) AS BIGINT) - 1 AS hi0,
          y.idx * CAST(pow({b1}, y.lvl - least(x.lvl, y.lvl)) AS BIGINT) AS lo1, (y.idx + 1) * CAST(pow({b1}, y.lvl - least(x.lvl, y.lvl)) AS BIGINT) - 1 AS hi1 FROM x, y)""")
    return " UNION ALL ".join(parts)


def _boxes(spark: SparkSession) -> DataFrame:
    rows = [(q, level, *[x for lim in limits for x in lim]) for q, box in enumerate(BOXES) for level, limits in badic.boxes(box, 4)]
    return spark.createDataFrame(rows, "query_id long, lvl long, lo0 long, hi0 long, lo1 long, hi1 long")


@query("spatial_cover_boxes", _boxes_sql())
def spatial_cover_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark)


@query("spatial_cover_cubes", f"SELECT query_id, lvl, CAST(sum((hi0 - lo0 + 1) * (hi1 - lo1 + 1)) AS BIGINT) AS n_cubes FROM ({_boxes_sql()}) GROUP BY query_id, lvl")
def spatial_cover_cubes(spark: SparkSession, sf: str) -> DataFrame:
    cubes = _boxes(spark).select("query_id", "lvl", F.explode(F.sequence("lo0", "hi0")).alias("x"), "lo1", "hi1").select("query_id", "lvl", "x", F.explode(F.sequence("lo1", "hi1")).alias("y"))
    return cubes.groupBy("query_id", "lvl").agg(F.count_distinct("x", "y").alias("n_cubes"))


ALIGN = [(0, 2, 3, 13, 2), (1, 5, 7, 61, 1), (2, 10, 120, 399, 2)]


@query("align_predicates", "SELECT * FROM (VALUES " + ", ".join(f"({q}::BIGINT, CAST(round_even({lo} / {b}.0 ** {l}, 0) * {b**l} AS BIGINT), CAST(round_even({hi + 1} / {b}.0 ** {l}, 0) * {b**l} - 1 AS BIGINT))" for q, b, lo, hi, l in ALIGN) + ") t(query_id, lo, hi)")
def align_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(q, *badic.aligned(b, lo, hi, l)) for q, b, lo, hi, l in ALIGN], "query_id long, lo long, hi long")


@query("dyadic_ranges", "SELECT event_id, CAST(l AS INTEGER) AS lvl, CAST(floor(event_id / pow(2, l)) AS BIGINT) AS idx FROM events, range(6) t(l)")
def dyadic_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One base-2 block a level of each key."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.posexplode(F.array(*[level_index(F.col("event_id"), 2, l) for l in range(6)])).alias("lvl", "idx"))


@query("dyadic_cover", f"WITH {_RANGES_SQL.replace('r(', 'r0(').replace('AS (VALUES', 'AS (VALUES')}, r AS (SELECT query_id, 2::BIGINT AS base, lo, hi FROM r0), {_COVER_SQL.split(',' + chr(10), 1)[1]} SELECT query_id, CAST(lvl AS INTEGER) AS lvl, idx FROM cover")
def dyadic_cover(spark: SparkSession, sf: str) -> DataFrame:
    return badic.cover_table(_ranges(spark).withColumn("base", F.lit(2).cast("long")), LEVELS).select("query_id", "lvl", "idx")


def _masks(layout: Layout):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = level_counts(li(spark, sf), layout, 3)
        return c.groupBy("lvl", "gid").agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("n_updates"))

    return run


def _masks_sql(layout: Layout) -> str:
    idx = ", ".join(f"CAST(floor({n} / {b**3}.0) AS BIGINT) AS {n}" for n, b in zip(layout.nums, layout.bases, strict=True))
    cols = ", ".join(layout.columns)
    sets = ", ".join("(" + ", ".join([*layout.cats[:p], *[layout.nums[i] for i in m]]) + ")" for p, m in grouping_sets(layout, 3))
    return f"""WITH {LI_SQL}, cell AS (SELECT {', '.join(layout.cats)}, {idx} FROM li),
      g AS (SELECT CAST(GROUPING({cols}) AS BIGINT) AS gid, count(*) AS n FROM cell GROUP BY GROUPING SETS ({sets}))
      SELECT 3 AS lvl, gid, count(*) AS n_regions, CAST(sum(n) AS BIGINT) AS n_updates FROM g GROUP BY gid"""


MASKED = {
    "mask_full": Layout(LI.cats, LI.nums, LI.bases, 5, tuple(full_masks(3))),
    "mask_k012": Layout(("c0",), ("i0", "i1", "i2", "l_orderkey"), (5, 10, 2, 10), 5, tuple(near_full_masks(4))),
    "mask_materialized": Layout(LI.cats, LI.nums, LI.bases, 5, ((0, 2), (1,), (0, 1, 2))),
}
for _name, _layout in MASKED.items():
    query(_name, _masks_sql(_layout))(_masks(_layout))


def _prefix(layout: Layout):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cols = [F.col(c) for c in layout.cats]
        out = li(spark, sf).groupingSets([[F.col(c) for c in layout.cats[:p]] for p in layout.prefixes()], *cols).agg(F.count("*").alias("n"), F.grouping_id(*layout.cats).cast("long").alias("gid"))
        return out.select(*layout.cats, "gid", "n")

    return run


_collapsed = Layout(LI.cats, LI.nums, LI.bases, 5, collapsed=True)
query("adtree_rollup", f"WITH {LI_SQL} SELECT c0, c1, c2, CAST(GROUPING(c0, c1, c2) AS BIGINT) AS gid, count(*) AS n FROM li GROUP BY ROLLUP(c0, c1, c2)")(_prefix(LI))
query("adtree_rollup_collapsed", f"WITH {LI_SQL} SELECT c0, c1, c2, CAST(GROUPING(c0, c1, c2) AS BIGINT) AS gid, count(*) AS n FROM li GROUP BY GROUPING SETS ((c0, c1, c2), (c0), ())")(_prefix(_collapsed))


@query("adtree_nodes", f"WITH {LI_SQL} SELECT a.c0, b.c1, '4' AS c2 FROM (SELECT DISTINCT c0 FROM li) a, (SELECT DISTINCT c1 FROM li) b")
def adtree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that a predicate on the last category reaches: earlier wildcards expand to their domains."""
    rows = li(spark, sf)
    domains = rows.agg(F.collect_set("c0").alias("c0"), F.collect_set("c1").alias("c1"))
    return domains.select(F.explode("c0").alias("c0"), "c1").select("c0", F.explode("c1").alias("c1"), F.lit("4").alias("c2"))


@query("adtree_levels", f"WITH {LI_SQL}, g AS (SELECT GROUPING(c0, c1, c2) AS gid FROM li GROUP BY ROLLUP(c0, c1, c2)) SELECT CAST(bit_count(CAST(gid AS BIGINT)) AS BIGINT) AS lvl, count(*) AS n_nodes FROM g GROUP BY ALL")
def adtree_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _prefix(LI)(spark, sf).groupBy(F.bit_count("gid").cast("long").alias("lvl")).agg(F.count("*").alias("n_nodes"))

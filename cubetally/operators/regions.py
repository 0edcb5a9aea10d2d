"""Region counts: rows counted over category prefixes, levels and wildcard masks, and estimates from them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubetally.plans.badic import boxes
from cubetally.plans.predicates import Query, checked
from cubetally.plans.schema import Layout, best_mask, grouping_sets, level_index

MOST_BOXES = 200_000


def level_counts(rows: DataFrame, layout: Layout, level: int, wanted: list[tuple[int, tuple[int, ...]]] | None = None) -> DataFrame:
    """Region counts of one level; ``wanted`` keeps only some (prefix, mask) sets."""
    sets = grouping_sets(layout, level) if wanted is None else wanted
    at = rows.select(*layout.cats, *[level_index(F.col(n), b, level).alias(n) for n, b in zip(layout.nums, layout.bases, strict=True)])
    if level:  # higher levels have few cells: count those before they fan out over the sets
        at = at.groupBy(*layout.columns).agg(F.count("*").alias("n"))
    else:
        at = at.withColumn("n", F.lit(1).cast("long"))
    cols = [F.col(c) for c in layout.columns]
    groups = [[F.col(c) for c in layout.cats[:p]] + [F.col(layout.nums[i]) for i in mask] for p, mask in sets]
    out = at.groupingSets(groups, *cols).agg(F.sum("n").alias("n"), F.grouping_id(*layout.columns).cast("long").alias("gid"))
    return out.select(F.lit(level).alias("lvl"), "gid", *layout.columns, "n")


def region_table(rows: DataFrame, layout: Layout) -> DataFrame:
    """(lvl, gid, columns, n) of all regions; a wildcard is null with its bit set in gid."""
    return functools.reduce(DataFrame.unionByName, [level_counts(rows, layout, l) for l in range(layout.levels)])


def merged(tables: list[DataFrame], layout: Layout) -> DataFrame:
    """Counts of several region tables of one layout, added up."""
    every = functools.reduce(DataFrame.unionByName, tables)
    return every.groupBy("lvl", "gid", *layout.columns).agg(F.sum("n").alias("n"))


def block_bounds(rows: DataFrame, layout: Layout) -> DataFrame:
    """(col, lo, hi): least and greatest value of each number, widened to blocks of base**levels."""
    stats = rows.agg(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in layout.nums])
    parts = []
    for n, b in zip(layout.nums, layout.bases, strict=True):
        w = F.lit(b**layout.levels)
        low, high = F.col(n)["lo"], F.col(n)["hi"]
        parts.append(F.struct(F.lit(n).alias("col"), (low - F.pmod(low, w)).alias("lo"), (high - F.pmod(high, w) + w - 1).alias("hi")))
    return stats.select(F.inline(F.array(*parts)))


class Plan:
    """A workload as boxes over stored slices: one row a box, a few (lvl, gid) slices to read."""

    def __init__(self, queries: list[Query], layout: Layout, ranges: dict[str, tuple[int, int]] | None = None):
        self.layout = layout
        self.rows: list[tuple] = []
        self.slices: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}
        self.n_boxes = [0] * len(queries)
        for q, query in enumerate(queries):
            p = checked(query, layout)
            cats = [i for i, c in enumerate(layout.cats) if c in p]
            prefix = max(cats) + 1 if cats else 0
            while prefix not in layout.prefixes():
                prefix += 1
            wanted = {i for i, n in enumerate(layout.nums) if n in p}
            # without a number the stored all-wildcard cell of the top level answers
            mask = best_mask(layout.kept_masks(), wanted) if wanted else ()
            bounds = []
            for i in mask:
                name = layout.nums[i]
                if name not in p and not (ranges and name in ranges):
                    raise ValueError(f"the stored masks cover {name}, so its value range is needed")
                lo, hi = p.get(name) or ranges[name]
                bounds.append((layout.bases[i], lo, hi))
            found = boxes(bounds, layout.levels - 1) if mask else [(layout.levels - 1, [])]
            self.n_boxes[q] = len(found)
            gid = layout.grouping_id(prefix, mask)
            values = [list(p[c]) if c in p else None for c in layout.cats]
            for level, limits in found:
                self.slices[level, gid] = (prefix, mask)
                at = dict(zip(mask, limits, strict=True))
                self.rows.append((q, level, gid, *values, *[x for i in range(len(layout.nums)) for x in at.get(i, (None, None))]))

    def table(self, spark) -> DataFrame:
        schema = ", ".join(["query_id long", "lvl int", "gid long", *[f"p_{c} array<string>" for c in self.layout.cats], *[f"lo_{n} long, hi_{n} long" for n in self.layout.nums]])
        return spark.createDataFrame(self.rows, schema)

    def slice_counts(self, rows: DataFrame) -> DataFrame:
        """Only the slices of the region table that this workload reads."""
        by_level: dict[int, list] = {}
        for (level, _), s in sorted(self.slices.items()):
            by_level.setdefault(level, []).append(s)
        return functools.reduce(DataFrame.unionByName, [level_counts(rows, self.layout, l, s) for l, s in by_level.items()])

    def hits(self, regions: DataFrame) -> DataFrame:
        """Regions inside the boxes, with their query."""
        layout = self.layout
        plan = self.table(regions.sparkSession)
        on = (regions["lvl"] == plan["lvl"]) & (regions["gid"] == plan["gid"])
        for c in layout.cats:
            on &= F.coalesce(F.array_contains(plan[f"p_{c}"], regions[c]), F.lit(True))
        for n in layout.nums:
            on &= F.coalesce(regions[n].between(plan[f"lo_{n}"], plan[f"hi_{n}"]), F.lit(True))
        side = F.broadcast(plan) if len(self.rows) <= MOST_BOXES else plan
        return regions.join(side, on).select("query_id", regions["lvl"], regions["gid"], *[regions[c] for c in layout.columns], "n")


def estimates(rows: DataFrame, queries: list[Query], layout: Layout, regions: DataFrame | None = None) -> DataFrame:
    """(query_id, estimate, n_regions): counts of a workload from the exact region store, in one job."""
    plan = Plan(queries, layout)
    hit = plan.hits(plan.slice_counts(rows) if regions is None else regions)
    got = hit.groupBy("query_id").agg(F.sum("n").cast("long").alias("estimate"), F.count("*").alias("n_regions"))
    every = rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(plan.n_boxes)], "query_id long, n_boxes long")
    return every.join(got, "query_id", "left").select("query_id", F.coalesce("estimate", F.lit(0)).alias("estimate"), "n_boxes", F.coalesce("n_regions", F.lit(0)).alias("n_regions"))

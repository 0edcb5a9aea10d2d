"""Workloads: value statistics, predicates of a wanted selectivity, random queries, synthetic rows."""

from __future__ import annotations

import math
import random
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.plans.predicates import Query
from cubetally.plans.schema import Layout


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, n, freq) of each category; one scan of partial counts."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = tall.groupBy("col", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("col").agg(F.sum("n").alias("total"))
    return counts.join(totals, "col").select("col", "value", "n", (F.col("n") / F.col("total")).alias("freq"))


def category_for(frequencies: DataFrame, target: float) -> DataFrame:
    """(col, value, freq): the category whose frequency is nearest to the target, ties to the smaller value."""
    near = F.struct(F.abs(F.col("freq") - target), F.col("value"), F.col("freq"))
    return frequencies.groupBy("col").agg(F.min(near).alias("m")).select("col", F.col("m.value").alias("value"), F.col("m.freq").alias("freq"))


def range_for(df: DataFrame, column: str, anchor: int, target: float) -> DataFrame:
    """(lo, hi, selectivity): from the anchor up to the exact quantile that takes in ``target`` of the rows."""
    stats = df.agg(F.count_if(F.col(column) < anchor).alias("below"), F.count("*").alias("n"))
    at = stats.select(F.least(F.lit(1.0), F.col("below") / F.col("n") + target).alias("p"))
    p = at.first()["p"]
    top = df.agg(F.percentile(column, F.lit(p)).cast("long").alias("hi"))
    hi = top.first()["hi"]
    return df.agg(F.avg(F.col(column).between(anchor, hi).cast("double")).alias("selectivity")).select(F.lit(anchor).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), "selectivity")


def profile(df: DataFrame, layout: Layout) -> DataFrame:
    """(col, iqr, n_levels): spread of each number and the levels of its base that span it."""
    q = df.agg(*[F.percentile(n, F.array(F.lit(0.25), F.lit(0.75))).alias(n) for n in layout.nums])
    rows = [F.struct(F.lit(n).alias("col"), (F.get(n, F.lit(1)) - F.get(n, F.lit(0))).alias("iqr"), F.ceil(F.ln(F.greatest(F.lit(1.0), F.get(n, F.lit(1)) - F.get(n, F.lit(0)))) / F.ln(F.lit(float(b)))).cast("long").alias("n_levels")) for n, b in zip(layout.nums, layout.bases, strict=True)]
    return q.select(F.inline(F.array(*rows)))


def random_queries(df: DataFrame, layout: Layout, n: int, most: int, portion: float, seed: int) -> list[Query]:
    """``n`` queries of 1 to ``most`` predicates: columns early in the layout likelier, categories by frequency,
    ranges a portion of the interquartile range and inside it.  Only statistics reach the driver."""
    rng = random.Random(seed)
    freq: dict[str, list[tuple[str, float]]] = {}
    for r in value_frequencies(df, list(layout.cats)).orderBy("col", "value").collect():  # category domains are small by design
        freq.setdefault(r["col"], []).append((r["value"], r["freq"]))
    spread = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in layout.nums]).first()
    out: list[Query] = []
    for _ in range(n):
        names = list(layout.columns)
        chosen = []
        for _ in range(rng.randint(1, min(most, len(names)))):
            chosen.append(names.pop(rng.choices(range(len(names)), [0.7**i for i in range(len(names))])[0]))
        q: dict[str, object] = {}
        for c in chosen:
            if c in layout.cats:
                values, weights = zip(*freq[c], strict=True)
                q[c] = [rng.choices(values, weights)[0]]
            else:
                lo, hi = spread[c]
                size = max(1, int((hi - lo) * portion))
                a = rng.randint(int(lo), max(int(lo), int(hi) - size))
                q[c] = (a, a + size - 1)
        out.append(q)
    return out


def queries_of_selectivity(df: DataFrame, layout: Layout, target: float, tolerance: float, seed: int) -> Query:
    """Categories added, nearest frequency first, until the product of their frequencies is within tolerance of the target."""
    rng = random.Random(seed)
    frequencies = value_frequencies(df, list(layout.cats)).cache()
    q: dict[str, object] = {}
    left = target
    names = list(layout.cats)
    rng.shuffle(names)
    for c in names:
        if abs(left - 1) <= tolerance:
            break
        r = category_for(frequencies.where(F.col("col") == c), max(left, 0.0)).first()
        if r["freq"] >= left * (1 - tolerance):
            q[c], left = [r["value"]], left / r["freq"]
    frequencies.unpersist()
    return q


def synthetic(spark: SparkSession, rows: int, dims: int, seed: int, spread: float = 100.0) -> DataFrame:
    """d_0 ... of whole numbers, normal around 0."""
    return spark.range(rows).select(*[F.round(F.randn(seed + i) * spread).cast("long").alias(f"d_{i}") for i in range(dims)])


def with_domains(df: DataFrame, layout: Layout) -> Layout:
    """``layout`` with the sorted distinct values of each category; domains are small by design, only they reach the driver."""
    values: dict[str, list[str]] = {c: [] for c in layout.cats}
    for r in value_frequencies(df, list(layout.cats)).select("col", "value").where("value is not null").orderBy("col", "value").collect():
        values[r["col"]].append(r["value"])
    return replace(layout, domains={c: tuple(v) for c, v in values.items()})


def combinations_of(layout: Layout) -> int:
    """Product of the domains' sizes."""
    return math.prod(len(v) for v in layout.domains.values())


def category_queries(df: DataFrame, layout: Layout, target: float) -> list[tuple[str, str]]:
    """(column, value) a category column: the value whose frequency is nearest to ``target``."""
    found = category_for(value_frequencies(df, list(layout.cats)), target).orderBy("col").collect()  # one row a column
    return [(r["col"], r["value"]) for r in found]


def mask_queries(df: DataFrame, layout: Layout, masks: list[tuple[int, ...]], low: float, high: float) -> list[Query]:
    """One range query a stored mask: its numbers between two of their quantiles, taken from value counts."""
    bounds = {}
    for n in sorted({layout.nums[i] for m in masks for i in m}):
        counts = df.where(F.col(n).isNotNull()).groupBy(n).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).first()[0]
        if total:
            bounds[n] = tuple(_ranked(counts, n, max(1, math.ceil(share * total))) for share in (low, high))
    return [{layout.nums[i]: bounds[layout.nums[i]] for i in m if layout.nums[i] in bounds} for m in masks]


def _ranked(counts: DataFrame, name: str, k: int) -> int:
    """The k-th smallest value of (value, n) counts, by halving the value range: one small aggregate a step."""
    lo, hi = counts.agg(F.min(name), F.max(name)).first()
    while lo < hi:
        mid = (lo + hi) // 2
        if (counts.where(F.col(name) <= mid).agg(F.sum("n")).first()[0] or 0) >= k:
            hi = mid
        else:
            lo = mid + 1
    return lo

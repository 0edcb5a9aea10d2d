"""Answering counts under a privacy budget: central, federated and per-record noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubetally.functions import noise
from cubetally.plans.predicates import Query, condition, count_each
from cubetally.plans.schema import Layout


class BudgetExceeded(ValueError):
    pass


class Ledger:
    """Spent and remaining privacy budget."""

    def __init__(self, budget: float):
        self.budget, self.spent = budget, 0.0

    def spend(self, epsilon: float) -> None:
        if self.spent + epsilon > self.budget + 1e-12:
            raise BudgetExceeded(f"{self.spent} + {epsilon} is over {self.budget}")
        self.spent += epsilon

    def remaining(self) -> float:
        return self.budget - self.spent

    def reset(self) -> None:
        self.spent = 0.0


Uniform = Callable[[Column], Column]


class CentralServer:
    """Exact counts with Laplace noise, rounded and not below 0."""

    def __init__(self, df: DataFrame, layout: Layout, budget: float):
        self.df, self.layout, self.ledger = df, layout, Ledger(budget)

    def answer(self, queries: list[Query], epsilon: float, uniform: Uniform | None = None) -> DataFrame:
        """(query_id, noisy); each query spends ``epsilon``."""
        self.ledger.spend(epsilon * len(queries))
        u = uniform(F.col("query_id").cast("string")) if uniform else noise.fresh()
        return count_each(self.df, queries, self.layout).select("query_id", F.greatest(F.lit(0), F.round(F.col("n") + noise.laplace(u, 1 / epsilon))).cast("long").alias("noisy"))


def federated(df: DataFrame, silo: str, queries: list[Query], layout: Layout, epsilon: float, uniform: Uniform | None = None) -> DataFrame:
    """(query_id, noisy): each silo answers with its own noise; the sum is rounded and not below 0."""
    counts = df.groupBy(silo).agg(*[F.count_if(condition(q, layout)).alias(f"q{i}") for i, q in enumerate(queries)])
    tall = counts.select(silo, F.posexplode(F.array(*[F.col(f"q{i}") for i in range(len(queries))])).alias("query_id", "n"))
    u = uniform(F.concat_ws("|", F.col("query_id").cast("string"), F.col(silo).cast("string"))) if uniform else noise.fresh()
    # whole thousandths keep the sum independent of its order
    each = F.round((F.col("n") + noise.laplace(u, 1 / epsilon)) * 1000).cast("long")
    return tall.withColumn("x", each).groupBy("query_id").agg(F.sum("x").alias("x")).select(F.col("query_id").cast("long").alias("query_id"), F.greatest(F.lit(0), F.round(F.col("x") / 1000)).cast("long").alias("noisy"))


def privatized(df: DataFrame, layout: Layout, epsilon: float, ranges: dict[str, tuple[int, int]], key: Column, uniform: Uniform | None = None) -> DataFrame:
    """Each record's columns under epsilon / columns: categories by randomized response, numbers by clipped Laplace."""
    share = epsilon / len(layout.columns)
    out = []

    def draw(name: str) -> Column:
        return uniform(F.concat_ws("|", F.lit(name), key.cast("string"))) if uniform else noise.fresh()

    for c in layout.cats:
        domain = sorted(layout.domains[c])
        values = F.array(*[F.lit(v) for v in domain])
        true = (F.array_position(values, F.col(c)) - 1).cast("long")
        out.append(F.get(values, noise.response(true, draw(c), draw(f"{c}'"), share, len(domain)).cast("int")).alias(c))
    for n in layout.nums:
        lo, hi = ranges[n]
        out.append(F.greatest(F.lit(lo), F.least(F.lit(hi), F.round(F.col(n) + noise.laplace(draw(n), (hi - lo) / share)))).cast("long").alias(n))
    return df.select(*out)

"""Predicate vectors: a wildcard, a value set or an inclusive range for each column."""

from __future__ import annotations

import functools
import numbers
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubetally.plans.schema import Layout

Predicate = object
Query = Mapping[str, Predicate]


def checked(query: Query, layout: Layout) -> dict[str, Predicate]:
    """The query without wildcards, sets as sorted tuples and ranges as (lo, hi); the column's role decides."""
    out: dict[str, Predicate] = {}
    for name, p in query.items():
        if name not in layout.columns:
            raise ValueError(f"unknown column {name}")
        if isinstance(p, str) and p == "*":
            continue
        if name in layout.cats:
            if not isinstance(p, (list, set, tuple, frozenset)):
                raise TypeError(f"{name} needs a set of values")
            values = tuple(sorted(str(v) for v in p))
            known = layout.domains.get(name)
            if known is not None and not set(values) <= set(known):
                raise ValueError(f"unknown value in {name}")
            out[name] = values
        else:
            if not isinstance(p, (list, tuple)) or len(p) != 2 or not all(isinstance(x, numbers.Integral) and not isinstance(x, bool) for x in p):
                raise TypeError(f"{name} needs two whole numbers")
            lo, hi = int(p[0]), int(p[1])
            if lo > hi:
                raise ValueError(f"{name}: {lo} > {hi}")
            out[name] = (lo, hi)
    return out


def condition(query: Query, layout: Layout) -> Column:
    """The query as a filter that reaches the scan."""
    parts = [F.col(c).between(*p) if c in layout.nums else F.col(c).isin(*p) for c, p in checked(query, layout).items()]
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_rows(df: DataFrame, query: Query, layout: Layout) -> DataFrame:
    return df.where(condition(query, layout))


def count_each(df: DataFrame, queries: list[Query], layout: Layout) -> DataFrame:
    """(query_id, n): exact counts of all queries in one scan."""
    row = df.agg(*[F.count_if(condition(q, layout)).alias(f"q{i}") for i, q in enumerate(queries)])
    return row.select(F.posexplode(F.array(*[F.col(f"q{i}") for i in range(len(queries))]))).select(F.col("pos").cast("long").alias("query_id"), F.col("col").cast("long").alias("n"))


def from_vector(vector: list, layout: Layout) -> dict[str, Predicate]:
    """A query from a list with one predicate a column, in table order."""
    return {c: p for c, p in zip(layout.columns, vector, strict=True) if not (isinstance(p, str) and p == "*")}


def of_region(cats: list[str | None], level: int, index: list[int | None], layout: Layout) -> dict[str, Predicate]:
    """The query that a region stands for."""
    out: dict[str, Predicate] = {c: (v,) for c, v in zip(layout.cats, cats, strict=False) if v is not None}
    for name, base, i in zip(layout.nums, layout.bases, index, strict=True):
        if i is not None:
            out[name] = (i * base**level, (i + 1) * base**level - 1)
    return out


def domains_and_ranges(df: DataFrame) -> DataFrame:
    """(col, kind, n_values, lo, hi) of each column by its type; one scan, nulls aside."""
    stats = []
    for name, kind in df.dtypes:
        number = kind not in ("string", "boolean")
        lo, hi = (F.min(name).cast("long"), F.max(name).cast("long")) if number else (F.lit(None).cast("long"),) * 2
        stats.append(F.struct(F.lit(name).alias("col"), F.lit("num" if number else "cat").alias("kind"), (F.lit(None).cast("long") if number else F.count_distinct(name)).alias("n_values"), lo.alias("lo"), hi.alias("hi")).alias(name))
    return df.agg(*stats).select(F.inline(F.array(*[F.col(n) for n in df.columns])))

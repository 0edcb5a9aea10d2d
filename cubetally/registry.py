"""All queries of the count engine and their DuckDB equivalents, collected from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubetally.queries import answers, evaluation, exact, privacy, region_queries, synopses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (exact, region_queries, synopses, privacy, evaluation, answers):
    QUERIES |= _module.Q
    ORACLES |= _module.SQL

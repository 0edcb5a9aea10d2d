"""Error metrics and summaries of estimates against true counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(df: DataFrame, n_rows: Column | int) -> DataFrame:
    """``df`` (true_count, estimate) with absolute, normalised and relative error (0 where nothing is true)."""
    a = F.abs(F.col("true_count") - F.col("estimate"))
    total = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    return df.withColumns({"absolute_error": a, "normalized_error": a / total, "relative_error": F.when(F.col("true_count") == 0, 0.0).otherwise(a / F.col("true_count"))})


def work(df: DataFrame, stages: list[str]) -> DataFrame:
    """Total lookups of a query: the sum of its stage counters."""
    return df.withColumn("total_lookups", sum((F.col(s) for s in stages[1:]), F.col(stages[0])))


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(*by, F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"))


def without_outliers(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows within ``factor`` interquartile ranges of the quartiles."""
    q = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    limits = q.select((low - factor * (high - low)).alias("lo"), (high + factor * (high - low)).alias("hi"))
    return df.join(F.broadcast(limits), F.col(value).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")  # one row of limits


def relative_entropy(df: DataFrame) -> DataFrame:
    """Kullback-Leibler divergence of estimates from true counts, both clipped at 1 and normalised."""
    p, q = F.greatest(F.col("true_count"), F.lit(1)).cast("double"), F.greatest(F.col("estimate"), F.lit(1)).cast("double")
    # sum p/P * ln((p/P) / (q/Q)) = sum(p ln(p/q)) / P + ln(Q / P), in one pass
    return df.agg(F.sum(p * F.ln(p / q)).alias("s"), F.sum(p).alias("tp"), F.sum(q).alias("tq")).select((F.col("s") / F.col("tp") + F.ln(F.col("tq") / F.col("tp"))).alias("divergence"))


def bloom_false_positives(k: Column, n: Column, m: Column) -> Column:
    return F.pow(1 - F.exp(-k * n / m), k)


def best_hashes(n: Column, m: Column) -> Column:
    return m / n * math.log(2)

"""Standing layouts over the test tables, in Spark and as SQL views for the equivalent queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.plans.schema import Layout

LI = Layout(("c0", "c1", "c2"), ("i0", "i1", "i2"), (5, 10, 2), 5)
#: the same rows at fewer numbers and coarser bases, where a whole region table is wanted row by row
LI_SMALL = Layout(("c0", "c1"), ("i0", "i2"), (10, 4), 3)
CUST = Layout(("c0",), ("i0", "i1"), (10, 5), 4)
EV = Layout(("c0", "c1"), ("i0", "i1"), (2, 5), 5)

LI_SQL = """li AS (
  SELECT l_orderkey, l_returnflag AS c0, l_linestatus AS c1, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS c2,
         CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS i0,
         CAST(floor(l_extendedprice) AS BIGINT) AS i1, CAST(l_quantity AS BIGINT) AS i2
  FROM lineitem)"""
CUST_SQL = "cu AS (SELECT c_mktsegment AS c0, CAST(floor(c_acctbal) AS BIGINT) AS i0, CAST(c_nationkey AS BIGINT) AS i1 FROM customer)"
EV_SQL = """ev AS (
  SELECT event_type AS c0, CAST(user_id % 10 AS VARCHAR) AS c1, CAST(floor(value) AS BIGINT) AS i0,
         CAST(floor(epoch(ts) / 3600) - 473352 AS BIGINT) AS i1 FROM events)"""


def li(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.select(
        "l_orderkey", F.col("l_returnflag").alias("c0"), F.col("l_linestatus").alias("c1"), F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("c2"),
        F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("i0"), F.floor("l_extendedprice").cast("long").alias("i1"), F.col("l_quantity").cast("long").alias("i2"),
    )


def cust(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/customer.parquet")
    return t.select(F.col("c_mktsegment").alias("c0"), F.floor("c_acctbal").cast("long").alias("i0"), F.col("c_nationkey").cast("long").alias("i1"))


def event_columns(t: DataFrame) -> DataFrame:
    return t.select(
        F.col("event_type").alias("c0"), (F.col("user_id") % 10).cast("string").alias("c1"), F.floor("value").cast("long").alias("i0"),
        (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) - 473352).cast("long").alias("i1"),
    )


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return event_columns(spark.read.parquet(f"{sf}/events.parquet"))


#: predicates of the standing workload over ``li``
QUERIES = [
    {"c0": ["A"], "i0": (100, 777)},
    {"c1": ["F"], "i0": (93, 1203), "i2": (10, 33)},
    {"c2": ["4", "5"], "i2": (3, 17)},
    {"i1": (20000, 30123)},
    {"c0": ["N", "R"], "c1": ["O"], "c2": ["1"], "i0": (200, 900)},
    {"c0": ["A"]},
    {"c2": ["4", "5"]},
    {"i0": (90, 1500), "i1": (20000, 20999), "i2": (1, 20)},
    {},
]
CUST_QUERIES = [{"i0": (-500, 499)}, {"c0": ["BUILDING"], "i0": (-999, -1)}, {"i0": (0, 5000), "i1": (3, 17)}, {"i1": (24, 24)}]


def where_sql(query: dict) -> str:
    parts = []
    for c, p in query.items():
        parts.append(f"{c} BETWEEN {p[0]} AND {p[1]}" if c.startswith("i") else f"{c} IN ({', '.join(repr(str(v)) for v in p)})")
    return " AND ".join(parts) or "TRUE"


def counts_sql(queries: list[dict], table: str, name: str = "n") -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, count(*) AS {name} FROM {table} WHERE {where_sql(q)}" for i, q in enumerate(queries))


def key_sql(expr: str) -> str:
    """The 60-bit key hash of a string expression."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"


def uniform_sql(expr: str) -> str:
    return f"((CAST({key_sql(expr)} AS DOUBLE) + 0.5) / {float(1 << 60)!r})"


def rows_sql(family, h: str = "h") -> str:
    """(row, col) list of a hash family, to unnest."""
    each = [f"{{'row': {i}, 'col': ((({a} * ({h} % {family.prime}) + {b}) % {family.prime}) % {family.width})}}" for i, (a, b) in enumerate(family.coefficients)]
    return "[" + ", ".join(each) + "]"


def regions_sql(layout: Layout, table: str, source: str) -> str:
    """CTE ``table`` with all regions of ``source``, each level as ROLLUP x CUBE."""
    parts = []
    cols = layout.cats + layout.nums
    for l in range(layout.levels):
        idx = ", ".join(f"CAST(floor({n} / CAST({b**l} AS DOUBLE)) AS BIGINT) AS {n}" for n, b in zip(layout.nums, layout.bases, strict=True))
        top = "" if l == layout.levels - 1 else f" WHERE gid & {(1 << len(layout.nums)) - 1} <> {(1 << len(layout.nums)) - 1}"
        parts.append(f"SELECT {l} AS lvl, gid, {', '.join(cols)}, n FROM (SELECT CAST(GROUPING({', '.join(cols)}) AS BIGINT) AS gid, {', '.join(cols)}, count(*) AS n FROM (SELECT {', '.join(layout.cats)}, {idx} FROM {source}) GROUP BY ROLLUP({', '.join(layout.cats)}), CUBE({', '.join(layout.nums)})){top}")
    return f"{table} AS ({' UNION ALL '.join(parts)})"

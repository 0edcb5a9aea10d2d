"""Tables and sketches on disk: one Parquet folder a component, one JSON file of metadata."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubetally.plans.schema import Layout


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def sliced(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``df`` with part: contiguous slices of equal size by ``order``, the last one takes the remainder.

    Positions come from range partitions: each counts its rows, the few counts are added up, and a window
    within the partition gives the place, so no task holds more than its range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_b"), F.sum("c").over(Window.partitionBy()).alias("_n"))  # one row a partition
    placed = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(before), "_p")
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return placed.withColumn("part", F.least(F.floor((F.col("_b") + F.col("_i")) / size), F.lit(n - 1)).cast("long")).drop("_p", "_b", "_n", "_i")


def write_slices(df: DataFrame, order: list[str], n: int, path: str) -> None:
    sliced(df, order, n).write.mode("overwrite").partitionBy("part").parquet(path)


def layout_json(layout: Layout) -> str:
    return json.dumps({"cats": layout.cats, "nums": layout.nums, "bases": layout.bases, "levels": layout.levels, "masks": layout.masks, "collapsed": layout.collapsed, "domains": layout.domains})


def layout_from(text: str) -> Layout:
    d = json.loads(text)
    masks = None if d["masks"] is None else tuple(tuple(m) for m in d["masks"])
    return Layout(tuple(d["cats"]), tuple(d["nums"]), tuple(d["bases"]), d["levels"], masks, d["collapsed"], {k: tuple(v) for k, v in d["domains"].items()})


def save_sketch(path: str, layout: Layout, n_rows: int, components: dict[str, DataFrame]) -> None:
    """Everything that a sketch needs to answer again: layout, processed rows and each component."""
    for name, df in components.items():
        out = df.write.mode("overwrite")
        if {"lvl", "gid"} <= set(df.columns):
            out = out.partitionBy("lvl", "gid")  # a query reads its slices only
        out.parquet(f"{path}/{name}")
    spark = next(iter(components.values())).sparkSession
    meta = json.dumps({"layout": layout_json(layout), "n_rows": n_rows, "components": sorted(components)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_sketch(spark: SparkSession, path: str) -> tuple[Layout, int, dict[str, Callable[[], DataFrame]]]:
    d = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return layout_from(d["layout"]), d["n_rows"], {name: (lambda name=name: spark.read.parquet(f"{path}/{name}")) for name in d["components"]}


def workload_from(text: str, layout: Layout) -> list[dict]:
    """Queries of a JSON workload: {"queries": [[predicate a column] ...]}."""
    out = []
    for vector in json.loads(text)["queries"]:
        q = {}
        for c, p in zip(layout.columns, vector, strict=True):
            if p != "*":
                q[c] = tuple(p) if c in layout.nums else [str(v) for v in p]
        out.append(q)
    return out


def workload_table(spark: SparkSession, queries: list[dict], layout: Layout) -> DataFrame:
    """One row a predicate: (query_id, pos, col, kind, values, lo, hi)."""
    rows = []
    for i, q in enumerate(queries):
        for pos, c in enumerate(layout.columns):
            p = q.get(c)
            rows.append((i, pos, c, "all", None, None, None) if p is None else (i, pos, c, "range", None, int(p[0]), int(p[1])) if c in layout.nums else (i, pos, c, "in", [str(v) for v in p], None, None))
    return spark.createDataFrame(rows, "query_id long, pos int, col string, kind string, values array<string>, lo long, hi long")

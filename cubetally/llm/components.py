"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubetally.llm.shared import written

HUB_PARTS = 64  # parts of a node's neighbours


def _with_least(sides: DataFrame) -> DataFrame:
    """(u, v, m): each (u, v) with the least id among u and its neighbours.

    The neighbours of a node are dealt over HUB_PARTS parts by id: the least one is found in two steps and comes
    back once a part, so that a hub's edges meet in no single task.
    """
    dealt = sides.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS)).cast("int"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("first"))
    least = parts.groupBy("u").agg(F.min("first").alias("m"), F.collect_list("part").alias("parts"))
    least = least.select(F.col("u").alias("lu"), F.least("u", "m").alias("m"), F.explode("parts").alias("lpart"))
    return dealt.join(least, (dealt["u"] == F.col("lu")) & (dealt["part"] == F.col("lpart"))).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the least id reachable.

    Each round hangs the larger neighbours of a node on its least neighbour (large star), then its smaller ones
    (small star); a round writes its edges to the shared folder, and the loop ends when a round changes nothing.
    The number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own link to its least neighbour is among its neighbour's; a least node keeps its larger ones
        small_in = large.where("u <> v").distinct()
        small = _with_least(small_in)
        now_next = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(now_next, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    nodes = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())

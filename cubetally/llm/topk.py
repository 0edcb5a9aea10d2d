"""Exact top-k search by inner product: columnar branch and bound.

Vectors become integers, floor(1024 * x).  A task holds a chunk of candidates as columns (one row a dimension)
and adds up products BLOCK dimensions at a time.  What the other dimensions can still add is at most the
product of the norms that remain of both vectors; a candidate whose sum plus that mass lies below the k-th
best certain score so far is dropped, and the survivors are compacted before the next block.  The k best of
earlier chunks of the task carry over as a starting bound.  Where the norms of a query and a chunk show that sums
stay under EXACT (2**53), float64 arithmetic is exact and order does not matter; elsewhere bounds get the
slack of a rounded sum, and the survivors are scored again in whole numbers of any size.

The stated query set meets all rows in blocks of about QUERY_BLOCK queries, each broadcast (its size is bounded
by that parameter, not by the data); every task returns its k best a query, and a window over those picks the k
best of all.

Cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; a
candidate of another length than the query is none for it; rows that repeat a vec_id are candidates of their
own, but never for a query of that id, and such a query is asked once, with its smallest vector; ties go to
the smaller vec_id; components beyond a long become the nearest long, and so do scores, which are ranked before
that; null vec_id takes no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 1024
BLOCK = 8
CHUNK = 8192
QUERY_BLOCK = 4096
EXACT = 2.0**53


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and whole-number components (doubles) of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def merge_best(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of both, ties to the smaller id."""
    s, i = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def merge_wide(best: tuple, queries: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``merge_best`` with scores in whole numbers of any size."""
    whole = [int(x) for x in queries]
    scores = [sum(a * int(b) for a, b in zip(whole, columns[:, i], strict=True)) for i in range(columns.shape[1])]
    every = sorted(zip([*map(int, best[0]), *scores], [*best[1].tolist(), *ids.tolist()], strict=True), key=lambda x: (-x[0], x[1]))[:k]
    out = np.empty(len(every), object)
    out[:] = [s for s, _ in every]
    return out, np.array([i for _, i in every], np.int64)


def chunk_search(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: list, k: int) -> None:
    """Update ``best`` (scores and ids by query) with the candidates in ``columns`` (dimensions x rows)."""
    dims = len(columns)
    cuts = list(range(0, dims, BLOCK))
    # norms of what remains from each block on, of all candidates and all queries
    mass = np.zeros((len(cuts) + 1, columns.shape[1]))
    q_mass = np.zeros((len(cuts) + 1, len(queries)))
    for n, c in reversed(list(enumerate(cuts))):
        mass[n] = mass[n + 1] + (columns[c : c + BLOCK] ** 2).sum(0)
        q_mass[n] = q_mass[n + 1] + (queries[:, c : c + BLOCK] ** 2).sum(1)
    mass, q_mass = np.sqrt(mass) * (1 + 1e-9), np.sqrt(q_mass) * (1 + 1e-9)
    first = queries[:, :BLOCK] @ columns[:BLOCK]
    widest = mass[0].max(initial=0) * q_mass[0]
    for q in range(len(queries)):
        wide = widest[q] >= EXACT or best[q][0].dtype == object
        slack = widest[q] * dims * 2.0**-50 if wide else 0.0
        alive = np.flatnonzero(ids != query_ids[q])
        sums = first[q][alive]
        for n in range(1, len(cuts) + 1):
            rest = mass[n][alive] * q_mass[n][q]
            floor = float(best[q][0][k - 1]) - slack if len(best[q][0]) >= k else -np.inf
            if len(alive) > k:
                floor = max(floor, np.partition(sums - rest, len(alive) - k)[len(alive) - k] - slack)
            keep = sums + rest + slack >= floor
            if not keep.all():
                alive, sums = alive[keep], sums[keep]
            if n == len(cuts) or not len(alive):
                break
            c = cuts[n]
            sums = sums + queries[q, c : c + BLOCK] @ columns[c : c + BLOCK][:, alive]
        if len(alive):
            best[q] = merge_wide(best[q], queries[q], columns[:, alive], ids[alive], k) if wide else merge_best(best[q], sums, ids[alive], k)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK rows
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(r["v"]) for r in block}:
            own = sorted((r for r in block if len(r["v"]) == n), key=lambda r: r["vec_id"])
            by_length[n] = (np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(len(own), n))
        shared = spark.sparkContext.broadcast(by_length)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {n: [(np.zeros(0), np.zeros(0, np.int64)) for _ in q[0]] for n, q in shared.value.items()}
            waiting: dict[int, list] = {n: [] for n in best}

            def search(n: int) -> None:
                ids = np.concatenate([w[0] for w in waiting[n]])
                columns = np.ascontiguousarray(np.concatenate([w[1] for w in waiting[n]]).T)
                waiting[n] = []
                q_ids, q = shared.value[n]
                if n == 0:
                    for j in range(len(q)):
                        other = ids[ids != q_ids[j]]
                        best[n][j] = merge_best(best[n][j], np.zeros(len(other)), other, k)
                    return
                chunk_search(q, q_ids, columns, ids, best[n], k)

            for batch in batches:
                ids, v = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.asarray(v.value_lengths())
                flat, offs = v.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
                for n in set(sizes.tolist()) & set(best):
                    at = np.flatnonzero(sizes == n)
                    for p in range(0, len(at), CHUNK):
                        part = at[p : p + CHUNK]
                        waiting[n].append((ids[part], flat[offs[part][:, None] + np.arange(n)]))
                        if sum(len(w[0]) for w in waiting[n]) >= CHUNK:
                            search(n)
            for n in best:
                if waiting[n]:
                    search(n)
                for j, (scores, ids) in enumerate(best[n]):
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shared.value[n][0][j])), pa.array(ids), pa.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], pa.int64())], ["query_id", "vec_id", "score"])

        part = rows.mapInArrow(task, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

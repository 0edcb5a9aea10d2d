"""Noisy sketches and servers; the noise is replayed from hashes, so that SQL can follow it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.functions import noise
from cubetally.functions.hashing import HashFamily, key_hash, uniform
from cubetally.operators import countmin, membership, servers
from cubetally.plans.schema import Layout
from cubetally.queries.fixtures import LI, LI_SQL, QUERIES, counts_sql, key_sql, li, rows_sql, uniform_sql, where_sql
from cubetally.queries.synopses import _CELLS, _KEY, CM, _key

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def laplace_sql(u: str, scale: float) -> str:
    return f"(-({scale!r}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


EPS = 0.5


@query("laplace_from_u", f"SELECT k, round({laplace_sql('(k / 32.0)', 2.0)}, 9) AS x FROM range(1, 32) t(k)")
def laplace_from_u(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 32).select(F.col("id").alias("k"), F.round(noise.laplace(F.col("id") / 32.0, 2.0), 9).alias("x"))


@query("epsilon_schedule", "SELECT i, round(0.1 + 3.9 * pow(i / 9.0, 2.0), 9) AS eps FROM range(10) t(i)")
def epsilon_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(noise.power_schedule(0.1, 4.0, 10, 2.0)).alias("i", "eps")).select(F.col("i").cast("long").alias("i"), F.round("eps", 9).alias("eps"))


SMALL = HashFamily(3, 61, 3)
_DENSE = f"g AS (SELECT r AS row, c AS col FROM range({SMALL.depth}) a(r), range({SMALL.width}) b(c))"
_SMALL_CELLS = f"cells AS (SELECT r.row AS row, r.col AS col, CAST(sum(w) AS BIGINT) AS cnt FROM (SELECT w, unnest({rows_sql(SMALL)}) AS r FROM (SELECT {key_sql(_KEY)} AS h, count(*) AS w FROM li GROUP BY h)) GROUP BY ALL)"


def _dense_counts(spark, sf):
    cells = countmin.cells(li(spark, sf), _key(), SMALL, None)
    return countmin.dense(spark, SMALL).join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


_U = uniform_sql("concat_ws('|', CAST(row AS VARCHAR), CAST(col AS VARCHAR))")


@query("cms_laplace", f"WITH {LI_SQL}, {_SMALL_CELLS}, {_DENSE} SELECT CAST(row AS INTEGER) AS row, col, CAST(coalesce(cnt, 0) + round({laplace_sql(_U, 1 / EPS)}) AS BIGINT) AS noisy FROM g LEFT JOIN cells USING (row, col)")
def cms_laplace(spark: SparkSession, sf: str) -> DataFrame:
    """Noise on every cell, the empty ones too."""
    u = uniform(F.concat_ws("|", F.col("row").cast("string"), F.col("col").cast("string")))
    return _dense_counts(spark, sf).select("row", "col", (F.col("cnt") + F.round(noise.laplace(u, 1 / EPS))).cast("long").alias("noisy"))


SILOS = 5
_US = uniform_sql("concat_ws('|', CAST(row AS VARCHAR), CAST(col AS VARCHAR), CAST(s AS VARCHAR))")


@query("cms_laplace_silos", f"WITH {LI_SQL}, {_SMALL_CELLS}, {_DENSE} SELECT CAST(row AS INTEGER) AS row, col, CAST(max(coalesce(cnt, 0)) + sum(CAST(round({laplace_sql(_US, 1 / EPS)}) AS BIGINT)) AS BIGINT) AS noisy FROM g LEFT JOIN cells USING (row, col), range({SILOS}) t(s) GROUP BY row, col")
def cms_laplace_silos(spark: SparkSession, sf: str) -> DataFrame:
    """One noise a silo and cell."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(SILOS - 1)), F.lit(0).cast("long"), lambda acc, s: acc + F.round(noise.laplace(uniform(F.concat_ws("|", F.col("row").cast("string"), F.col("col").cast("string"), s.cast("string"))), 1 / EPS)).cast("long"))
    return _dense_counts(spark, sf).select("row", "col", (F.col("cnt") + total).alias("noisy"))


M = 509
BITS = HashFamily(2, M, 17)
_SET = f"bits AS (SELECT DISTINCT r.col AS pos FROM (SELECT unnest({rows_sql(BITS)}) AS r FROM (SELECT DISTINCT {key_sql(_KEY)} AS h FROM li)))"
_UP = uniform_sql("CAST(pos AS VARCHAR)")


@query("bloom_flip", f"WITH {LI_SQL}, {_SET}, g AS (SELECT pos FROM range({M}) t(pos)) SELECT g.pos AS pos, (bits.pos IS NOT NULL) <> ({_UP.replace('CAST(pos', 'CAST(g.pos')} < {noise.flip_chance(EPS)!r}) AS is_set FROM g LEFT JOIN bits ON bits.pos = g.pos")
def bloom_flip(spark: SparkSession, sf: str) -> DataFrame:
    bits = membership.bloom(li(spark, sf), _key(), BITS).withColumn("on", F.lit(True))
    grid = spark.range(M).select(F.col("id").alias("pos")).join(bits, "pos", "left")
    return grid.select("pos", (F.coalesce("on", F.lit(False)) != (uniform(F.col("pos").cast("string")) < noise.flip_chance(EPS))).alias("is_set"))


OUE = HashFamily(1, 31, 19)
_OUE_Q = noise.flip_chance(EPS)


@query("bloom_oue", f"""WITH {LI_SQL}, r AS (SELECT l_orderkey, {key_sql(_KEY)} AS h, row_number() OVER () AS rid FROM (SELECT DISTINCT l_orderkey, c0, c1, c2 FROM li)),
  b AS (SELECT pos, count(*) AS n, count(*) FILTER ({uniform_sql("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(h AS VARCHAR), CAST(pos AS VARCHAR))")} < CASE WHEN ({rows_sql(OUE)})[1].col = pos THEN 0.5 ELSE {_OUE_Q!r} END) AS ones FROM r, range({OUE.width}) t(pos) GROUP BY pos)
  SELECT pos, ones, round((ones - n * {_OUE_Q!r}) / (0.5 - {_OUE_Q!r}), 6) AS est FROM b""")
def bloom_oue(spark: SparkSession, sf: str) -> DataFrame:
    """Each record reports all bits: its own with chance 1/2, others with 1/(e^eps + 1); counts are debiased."""
    r = li(spark, sf).select("l_orderkey", "c0", "c1", "c2").distinct().select("l_orderkey", key_hash(_key()).alias("h"))
    told = r.select("l_orderkey", "h", F.get(OUE.positions(F.col("h")), F.lit(0)).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OUE.width - 1).cast("long"))).alias("pos"))
    u = uniform(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("h").cast("string"), F.col("pos").cast("string")))
    one = u < F.when(F.col("own") == F.col("pos"), 0.5).otherwise(_OUE_Q)
    return told.groupBy("pos").agg(F.count_if(one).alias("ones"), F.count("*").alias("n")).select("pos", "ones", F.round(noise.debiased(F.col("ones"), F.col("n"), 0.5, _OUE_Q), 6).alias("est"))


_RP, _W = noise.keep_chance(EPS, SMALL.width), SMALL.width
_UK = uniform_sql("concat_ws('|', CAST(id AS VARCHAR), CAST(row AS VARCHAR))")
_VK = uniform_sql("concat_ws('|', CAST(id AS VARCHAR), CAST(row AS VARCHAR), 'v')")


@query("cms_grr", f"""WITH {LI_SQL}, t AS (SELECT id, r.row AS row, r.col AS col FROM (SELECT concat_ws('|', l_orderkey, i0, i1, i2) AS id, unnest({rows_sql(SMALL, key_sql(_KEY))}) AS r FROM li)),
  o AS (SELECT row, col, {_UK} AS u, least(CAST(floor({_VK} * {_W - 1}) AS BIGINT), {_W - 2}) AS x FROM t)
  SELECT row, CASE WHEN u < {_RP!r} THEN col ELSE x + (CASE WHEN x >= col THEN 1 ELSE 0 END) END AS col, count(*) AS cnt FROM o GROUP BY ALL""")
def cms_grr(spark: SparkSession, sf: str) -> DataFrame:
    """Each record reports its cell of each row by randomized response."""
    t = li(spark, sf).select(F.concat_ws("|", "l_orderkey", "i0", "i1", "i2").alias("id"), F.posexplode(SMALL.positions(key_hash(_key()))).alias("row", "col"))
    u, v = uniform(F.concat_ws("|", "id", F.col("row").cast("string"))), uniform(F.concat_ws("|", "id", F.col("row").cast("string"), F.lit("v")))
    return t.select("row", noise.response(F.col("col"), u, v, EPS, _W).alias("col")).groupBy("row", "col").agg(F.count("*").alias("cnt"))


HW = 64
HAD = HashFamily(2, HW, 23)


@query("cms_hadamard", f"""WITH {LI_SQL}, t AS (SELECT id, r.row AS row, r.col AS col FROM (SELECT concat_ws('|', l_orderkey, i0, i1, i2) AS id, unnest({rows_sql(HAD, key_sql(_KEY))}) AS r FROM li)),
  o AS (SELECT row, col, least(CAST(floor({_VK} * {HW}) AS BIGINT), {HW - 1}) AS j, {_UK} AS u FROM t)
  SELECT row, j, CAST(sum((CASE WHEN bit_count(col & j) % 2 = 0 THEN 1 ELSE -1 END) * (CASE WHEN u < {noise.flip_chance(EPS)!r} THEN -1 ELSE 1 END)) AS BIGINT) AS total FROM o GROUP BY row, j""")
def cms_hadamard(spark: SparkSession, sf: str) -> DataFrame:
    """Each record reports the sign of one random Hadamard entry of its cell, sometimes flipped."""
    t = li(spark, sf).select(F.concat_ws("|", "l_orderkey", "i0", "i1", "i2").alias("id"), F.posexplode(HAD.positions(key_hash(_key()))).alias("row", "col"))
    u, v = uniform(F.concat_ws("|", "id", F.col("row").cast("string"))), uniform(F.concat_ws("|", "id", F.col("row").cast("string"), F.lit("v")))
    j = F.least(F.floor(v * HW).cast("long"), F.lit(HW - 1).cast("long"))
    sign = noise.hadamard_sign(F.col("col"), F.col("j")) * F.when(F.col("u") < noise.flip_chance(EPS), -1).otherwise(1)
    return t.select("row", "col", j.alias("j"), u.alias("u")).groupBy("row", "j").agg(F.sum(sign).cast("long").alias("total"))


@query("central_dp", f"WITH {LI_SQL} SELECT query_id, CAST(greatest(0, round(n + {laplace_sql(uniform_sql('CAST(query_id AS VARCHAR)'), 1 / EPS)})) AS BIGINT) AS noisy FROM ({counts_sql(QUERIES, 'li')})")
def central_dp(spark: SparkSession, sf: str) -> DataFrame:
    return servers.CentralServer(li(spark, sf), LI, EPS * len(QUERIES)).answer(QUERIES, EPS, uniform)


_SILO = "l_orderkey % 5"
_FED = " UNION ALL ".join(f"SELECT query_id, silo, n FROM (SELECT CAST({i} AS BIGINT) AS query_id, {_SILO} AS silo, count(*) FILTER ({c}) AS n FROM li GROUP BY ALL)" for i, c in enumerate(where_sql(q) for q in QUERIES))


@query("federated_dp", f"WITH {LI_SQL}, s AS ({_FED}) SELECT query_id, CAST(greatest(0, round(sum(CAST(round((n + {laplace_sql(uniform_sql("concat_ws('|', CAST(query_id AS VARCHAR), CAST(silo AS VARCHAR))"), 1 / EPS)}) * 1000) AS BIGINT)) / 1000.0)) AS BIGINT) AS noisy FROM s GROUP BY query_id")
def federated_dp(spark: SparkSession, sf: str) -> DataFrame:
    return servers.federated(li(spark, sf).withColumn("silo", F.col("l_orderkey") % 5), "silo", QUERIES, LI, EPS, uniform)


DOMAINS = {"c0": ("A", "N", "R"), "c1": ("F", "O")}
GRR = Layout(("c0", "c1"), ("i0", "i2"), (5, 2), 5, domains=DOMAINS)
RANGES = {"i0": (0, 2600), "i2": (1, 50)}


def _grr_sql() -> str:
    share = 2.0 / 4
    cols = []
    rid = "concat_ws('|', l_orderkey, i0, i1, i2)"
    for c, d in DOMAINS.items():
        u, v = uniform_sql(f"concat_ws('|', '{c}', {rid})"), uniform_sql(f"concat_ws('|', '{c}''', {rid})")
        k = len(d)
        pos = "CASE " + " ".join(f"WHEN {c} = '{x}' THEN {i}" for i, x in enumerate(d)) + " END"
        x = f"least(CAST(floor({v} * {k - 1}) AS BIGINT), {k - 2})"
        cols.append(f"[{', '.join(repr(x) for x in d)}][1 + CASE WHEN {u} < {noise.keep_chance(share, k)!r} THEN {pos} ELSE {x} + (CASE WHEN {x} >= {pos} THEN 1 ELSE 0 END) END] AS {c}")
    for n, (lo, hi) in RANGES.items():
        u = uniform_sql(f"concat_ws('|', '{n}', {rid})")
        cols.append(f"CAST(greatest({lo}, least({hi}, round({n} + {laplace_sql(u, (hi - lo) / share)}))) AS BIGINT) AS {n}")
    return f"WITH {LI_SQL}, p AS (SELECT {', '.join(cols)} FROM li) SELECT c0, c1, count(*) AS n, CAST(sum(i0) AS BIGINT) AS s0, CAST(sum(i2) AS BIGINT) AS s2 FROM p GROUP BY c0, c1"


@query("grr_table", _grr_sql())
def grr_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf)
    p = servers.privatized(rows, GRR, 2.0, RANGES, F.concat_ws("|", "l_orderkey", "i0", "i1", "i2"), uniform)
    return p.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.sum("i0").cast("long").alias("s0"), F.sum("i2").cast("long").alias("s2"))

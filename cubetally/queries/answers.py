"""Workloads answered from approximate sketches, built, stored and loaded; domains of a table; private estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.functions import noise
from cubetally.functions.hashing import key_hash
from cubetally.operators import countmin, sketch, workload
from cubetally.plans import predicates
from cubetally.queries import privacy
from cubetally.queries.evaluation import _scratch
from cubetally.queries.fixtures import LI, LI_SMALL, LI_SQL, counts_sql, key_sql, li, regions_sql, rows_sql, where_sql

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


WORKLOAD = [{"c0": ["A"], "i0": (100, 777)}, {"c1": ["F"], "i0": (93, 1203), "i2": (10, 33)}, {"c0": ["N", "R"], "c1": ["O"], "i2": (3, 17)}, {"i0": (-400, 333)}, {"c0": ["A"]}, {"c0": ["Q"], "i2": (1, 9)}, {}]
SPARSE, FALLING = sketch.uniform(LI_SMALL, 0.002, 0.05, n_sparse=1), sketch.decreasing(LI_SMALL, 0.001, 0.05)
_KEY = "concat_ws('|', CAST(gid AS VARCHAR), coalesce(c0, '*'), coalesce(c1, '*'), coalesce(CAST(i0 AS VARCHAR), '*'), coalesce(CAST(i2 AS VARCHAR), '*'))"


def _candidates_sql(q: dict, number: int) -> list[str]:
    """Regions of a query, level by level: blocks inside all ranges, of which some block one level up is not."""
    top, bases = LI_SMALL.levels - 1, dict(zip(LI_SMALL.nums, LI_SMALL.bases, strict=True))
    cats = [i for i, c in enumerate(LI_SMALL.cats) if c in q]
    prefix = cats[-1] + 1 if cats else 0
    nums = [n for n in LI_SMALL.nums if n in q]
    gid = LI_SMALL.grouping_id(prefix, tuple(LI_SMALL.nums.index(n) for n in nums))
    out = []
    for level in range(top + 1) if nums else [top]:
        froms, where, outside = [], [], []
        kept = LI_SMALL.cats[:prefix]
        if kept:
            froms.append(f"(SELECT DISTINCT {', '.join(kept)} FROM li WHERE {where_sql({c: q[c] for c in kept if c in q})})")
        for n in nums:
            (lo, hi), w = q[n], bases[n] ** level
            froms.append(f"(SELECT DISTINCT CAST(floor({n} / {w}.0) AS BIGINT) AS {n} FROM li)")
            where.append(f"{n} * {w} >= {lo} AND {n} * {w} + {w - 1} <= {hi}")
            up = f"floor({n} / {bases[n]}.0) * {w * bases[n]}"
            outside.append(f"NOT ({up} >= {lo} AND {up} + {w * bases[n] - 1} <= {hi})")
        if level < top:
            where.append("(" + " OR ".join(outside) + ")")
        columns = ", ".join(f"{c} AS {c}" if c in kept or c in nums else f"NULL AS {c}" for c in LI_SMALL.columns)
        out.append(f"SELECT CAST({number} AS BIGINT) AS query_id, {level} AS lvl, CAST({gid} AS BIGINT) AS gid, {columns} FROM {', '.join(froms)} WHERE {' AND '.join(where) or 'TRUE'}")
    return out


def _estimate_sql(config: sketch.Config) -> str:
    found = " UNION ALL ".join(s for i, q in enumerate(WORKLOAD) if q for s in _candidates_sql(q, i))
    cells, probes = [], []
    for l, f in enumerate(config.families):
        if f is None:
            probes.append(f"SELECT k.query_id, k.h, coalesce(e.n, 0) AS est FROM k LEFT JOIN (SELECT {key_sql(_KEY)} AS h, n FROM g WHERE lvl = {l}) e ON e.h = k.h WHERE k.lvl = {l}")
            continue
        cells.append(f"SELECT {l} AS lvl, r.row AS row, r.col AS col, sum(n) AS cnt FROM (SELECT n, unnest({rows_sql(f)}) AS r FROM (SELECT {key_sql(_KEY)} AS h, n FROM g WHERE lvl = {l})) GROUP BY ALL")
        probes.append(f"SELECT query_id, h, min(coalesce(cnt, 0)) AS est FROM (SELECT query_id, h, unnest({rows_sql(f)}) AS r FROM k WHERE lvl = {l}) p LEFT JOIN cells ON cells.lvl = {l} AND cells.row = p.r.row AND cells.col = p.r.col GROUP BY query_id, h")
    return f"""{regions_sql(LI_SMALL, 'g', 'li')}, f AS ({found}), k AS (SELECT query_id, lvl, {key_sql(_KEY)} AS h FROM f),
      cells AS ({' UNION ALL '.join(cells)}), p AS ({' UNION ALL '.join(probes)}),
      s AS (SELECT query_id, CAST(sum(est) AS BIGINT) AS estimate, count(*) AS n_candidates FROM p GROUP BY query_id),
      t AS ({counts_sql(WORKLOAD, 'li')}),
      v AS (SELECT t.query_id, t.n AS true_count, CASE WHEN t.query_id = {len(WORKLOAD) - 1} THEN t.n ELSE coalesce(s.estimate, 0) END AS estimate, coalesce(s.n_candidates, 0) AS n_candidates FROM t LEFT JOIN s USING (query_id))"""


def _evaluation_sql(config: sketch.Config) -> str:
    return f"WITH {LI_SQL}, {_estimate_sql(config)} SELECT query_id, true_count, estimate, abs(estimate - true_count) AS absolute_error, round(abs(estimate - true_count) / greatest(true_count, 1), 9) AS relative_error, n_candidates FROM v"


def _evaluated(spark: SparkSession, rows: DataFrame, parts: dict[str, DataFrame], config: sketch.Config) -> DataFrame:
    return sketch.evaluated(sketch.estimates(parts, config, WORKLOAD), predicates.count_each(rows, WORKLOAD, LI_SMALL)).drop("n_boxes")


@query("sketch_workload_sparse", _evaluation_sql(SPARSE))
def sketch_workload_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of one size, the top level exact: truth, estimate, errors and candidates of each query."""
    rows = li(spark, sf)
    return _evaluated(spark, rows, sketch.build(rows, SPARSE), SPARSE)


@query("sketch_workload_stored", _evaluation_sql(FALLING))
def sketch_workload_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that shrink by level, answered by the sketch as saved and loaded again."""
    rows, path = li(spark, sf), _scratch(spark)
    sketch.save(sketch.build(rows, FALLING), FALLING, path)
    parts, config = sketch.load(spark, path)
    return _evaluated(spark, rows, parts, config)


@query("table_domains", f"WITH {LI_SQL}, d AS (SELECT DISTINCT 'c0' AS col, c0 AS value FROM li UNION ALL SELECT DISTINCT 'c1', c1 FROM li UNION ALL SELECT DISTINCT 'c2', c2 FROM li) SELECT col, string_agg(value, ',' ORDER BY value) AS domain, count(*) AS size, (SELECT CAST(round(exp(sum(ln(k)))) AS BIGINT) FROM (SELECT count(*) AS k FROM d GROUP BY col)) AS combinations FROM d GROUP BY col")
def table_domains(spark: SparkSession, sf: str) -> DataFrame:
    """A layout's domains from a table, and how many combinations they have."""
    layout = workload.with_domains(li(spark, sf), LI)
    rows = [(c, ",".join(v), len(v), workload.combinations_of(layout)) for c, v in layout.domains.items()]
    return spark.createDataFrame(rows, "col string, domain string, size long, combinations long")


_KEYS_SQL = f"k AS (SELECT DISTINCT {privacy._KEY} AS key FROM li)"
_P, _W = noise.keep_chance(privacy.EPS, privacy.SMALL.width), privacy.SMALL.width


@query("cms_grr_estimate", f"""WITH cells AS ({privacy.SQL['cms_grr']}), {LI_SQL}, {_KEYS_SQL}
  SELECT key, round(greatest(0.0, min((coalesce(cnt, 0) - (SELECT count(*) FROM li) / CAST({_W} AS DOUBLE)) / ({_P!r} - {1 / _W!r}))), 6) AS est
  FROM (SELECT key, unnest({rows_sql(privacy.SMALL, key_sql('key'))}) AS r FROM k) p LEFT JOIN cells ON cells.row = p.r.row AND cells.col = p.r.col GROUP BY key""")
def cms_grr_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of keys from randomized counters: each row debiased, the least of the rows, not below 0."""
    rows = li(spark, sf)
    n = F.lit(rows.count())
    keys = rows.select(privacy._key().alias("key")).distinct()
    probes = keys.select("key", F.posexplode(privacy.SMALL.positions(key_hash(F.col("key")))).alias("row", "col"))
    told = probes.join(privacy.cms_grr(spark, sf), ["row", "col"], "left")
    each = noise.debiased(F.coalesce("cnt", F.lit(0)), n, _P, 1 / _W)
    return told.groupBy("key").agg(F.round(F.greatest(F.lit(0.0), F.min(each)), 6).alias("est"))


_SPAN = 1 - 2 * noise.flip_chance(privacy.EPS)


@query("cms_hadamard_estimate", f"""WITH told AS ({privacy.SQL['cms_hadamard']}), {LI_SQL}, {_KEYS_SQL}
  SELECT key, round(greatest(0.0, min(e)), 6) AS est FROM (
    SELECT key, p.r.row AS row, sum(total * (CASE WHEN bit_count(p.r.col & j) % 2 = 0 THEN 1 ELSE -1 END)) / {_SPAN!r} AS e
    FROM (SELECT key, unnest({rows_sql(privacy.HAD, key_sql('key'))}) AS r FROM k) p JOIN told ON told.row = p.r.row GROUP BY key, p.r.row, p.r.col) GROUP BY key""")
def cms_hadamard_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of keys from signs: each row's totals turned back by the keys' Hadamard entries."""
    keys = li(spark, sf).select(privacy._key().alias("key")).distinct()
    probes = keys.select("key", F.posexplode(privacy.HAD.positions(key_hash(F.col("key")))).alias("row", "col"))
    told = probes.join(privacy.cms_hadamard(spark, sf), "row")  # a row of the family has HAD.width totals
    sums = told.groupBy("key", "row").agg((F.sum(F.col("total") * noise.hadamard_sign(F.col("col"), F.col("j"))) / F.lit(_SPAN)).alias("e"))
    return sums.groupBy("key").agg(F.round(F.greatest(F.lit(0.0), F.min("e")), 6).alias("est"))


@query("bloom_oue_presence", f"""WITH bits AS ({privacy.SQL['bloom_oue']}), {LI_SQL}, k AS (SELECT DISTINCT {privacy._KEY} AS key FROM li UNION ALL SELECT 'absent|x|99')
  SELECT key, coalesce(est, 0) >= 1 AS present FROM (SELECT key, ({rows_sql(privacy.OUE, key_sql('key'))})[1].col AS pos FROM k) p LEFT JOIN bits USING (pos)""")
def bloom_oue_presence(spark: SparkSession, sf: str) -> DataFrame:
    """A key counts as present where the debiased count of its bit is 1 or more."""
    keys = li(spark, sf).select(privacy._key().alias("key")).distinct().unionByName(spark.createDataFrame([("absent|x|99",)], "key string"))
    probes = keys.select("key", F.get(privacy.OUE.positions(key_hash(F.col("key"))), F.lit(0)).alias("pos"))
    return probes.join(privacy.bloom_oue(spark, sf), "pos", "left").select("key", (F.coalesce("est", F.lit(0.0)) >= 1).alias("present"))




@query("nearest_category_workload", f"WITH {LI_SQL}, t AS (SELECT 'c0' AS col, c0 AS value, count(*) AS n FROM li GROUP BY c0 UNION ALL SELECT 'c1', c1, count(*) FROM li GROUP BY c1 UNION ALL SELECT 'c2', c2, count(*) FROM li GROUP BY c2), r AS (SELECT col, value, n, row_number() OVER (PARTITION BY col ORDER BY abs(n / (SELECT count(*) FROM li)::DOUBLE - 0.2), value) AS k FROM t) SELECT col, value, n FROM r WHERE k = 1")
def nearest_category_workload(spark: SparkSession, sf: str) -> DataFrame:
    """One single-category query a column, of the wanted selectivity, and its count."""
    rows = li(spark, sf)
    qs = workload.category_queries(rows, LI, 0.2)
    counted = predicates.count_each(rows, [{c: [v]} for c, v in qs], LI)
    return spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(qs)], "query_id long, col string, value string").join(counted, "query_id").select("col", "value", "n")


@query("range_workload", f"WITH {LI_SQL}, s AS (SELECT quantile_disc(i0, 0.25) AS a, quantile_disc(i0, 0.75) AS b, quantile_disc(i2, 0.25) AS c, quantile_disc(i2, 0.75) AS d FROM li) SELECT n, inside FROM (SELECT 'i0' AS n, count(*) AS inside FROM li, s WHERE i0 BETWEEN a AND b UNION ALL SELECT 'i0,i2', count(*) FROM li, s WHERE i0 BETWEEN a AND b AND i2 BETWEEN c AND d)")
def range_workload(spark: SparkSession, sf: str) -> DataFrame:
    """Range queries on the stored masks, each number over its middle half, and their counts."""
    rows = li(spark, sf)
    qs = workload.mask_queries(rows, LI, [(0,), (0, 2)], 0.25, 0.75)
    counted = predicates.count_each(rows, qs, LI)
    names = spark.createDataFrame([(i, ",".join(q)) for i, q in enumerate(qs)], "query_id long, names string")
    return names.join(counted, "query_id").select(F.col("names").alias("n"), F.col("n").alias("inside"))

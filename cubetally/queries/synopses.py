"""Hashes, Count-Min, Bloom filters, bitmaps, samples and the Hilbert curve."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubetally.functions.hashing import HashFamily, key_hash, matrix_hash, matrix_rows
from cubetally.operators import countmin, hilbert, membership, regions, samples
from cubetally.plans import badic
from cubetally.plans.schema import level_index
from cubetally.queries.fixtures import CUST_SQL, EV_SQL, LI_SMALL, LI_SQL, cust, ev, key_sql, li, regions_sql, rows_sql

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CM = HashFamily(3, 1009, 7)
BF = HashFamily(4, 4093, 11)
_KEY = "concat_ws('|', c0, c1, c2)"


def _key():
    return F.concat_ws("|", "c0", "c1", "c2")


@query("hash_rows", f"WITH {LI_SQL}, k AS (SELECT DISTINCT {_KEY} AS key FROM li) SELECT key, {key_sql('key')} AS h, r.row AS row, r.col AS col FROM (SELECT key, unnest({rows_sql(CM, key_sql('key'))}) AS r FROM k)")
def hash_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = li(spark, sf).select(_key().alias("key")).distinct().withColumn("h", key_hash(F.col("key")))
    return k.select("key", "h", F.posexplode(CM.positions(F.col("h"))).alias("row", "col"))


@query("hash_alternatives", "SELECT event_type, CAST(md5(event_type) AS VARCHAR) AS md5, sha256(event_type) AS sha256 FROM events GROUP BY event_type")
def hash_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct()
    return e.select("event_type", F.md5(F.col("event_type").cast("binary")).alias("md5"), F.sha2("event_type", 256).alias("sha256"))


H3 = matrix_rows(20, 12, 5)


@query("h3_hash", "SELECT x, CASE WHEN x = 0 THEN 1048575 ELSE " + "xor(" * 11 + "(CASE WHEN x & 1 > 0 THEN " + str(H3[0]) + " ELSE 0 END)" + "".join(f", (CASE WHEN x & {1 << i} > 0 THEN {r} ELSE 0 END))" for i, r in enumerate(H3) if i) + " END AS h FROM (SELECT DISTINCT event_id % 4096 AS x FROM events)")
def h3_hash(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % 4096).alias("x")).distinct()
    return e.select("x", matrix_hash(F.col("x"), H3, 20).alias("h"))


_CELLS = f"SELECT r.row AS row, r.col AS col, CAST(sum(w) AS BIGINT) AS cnt FROM (SELECT w, unnest({rows_sql(CM)}) AS r FROM (SELECT {key_sql(_KEY)} AS h, count(*) AS w FROM li GROUP BY h)) GROUP BY ALL"


@query("cms_cells", f"WITH {LI_SQL} {_CELLS}")
def cms_cells(spark: SparkSession, sf: str) -> DataFrame:
    return countmin.cells(li(spark, sf), _key(), CM, None)


@query("cms_merge", f"WITH {LI_SQL} {_CELLS}")
def cms_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf)
    return countmin.merged([countmin.cells(rows.where(F.col("l_orderkey") % 3 == k), _key(), CM, None) for k in range(3)])


@query("cms_point_estimate", f"""WITH {LI_SQL}, cells AS ({_CELLS}), k AS (SELECT DISTINCT {_KEY} AS key FROM li UNION ALL SELECT 'absent|x|99')
  SELECT key, CAST(min(coalesce(cnt, 0)) AS BIGINT) AS est FROM (SELECT key, unnest({rows_sql(CM, key_sql('key'))}) AS r FROM k) p LEFT JOIN cells ON cells.row = p.r.row AND cells.col = p.r.col GROUP BY key""")
def cms_point_estimate(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf)
    keys = rows.select(_key().alias("key")).distinct().unionByName(spark.createDataFrame([("absent|x|99",)], "key string"))
    return countmin.point_estimates(keys, F.col("key"), countmin.cells(rows, _key(), CM, None), CM)


_RKEY = "concat_ws('|', CAST(gid AS VARCHAR), coalesce(c0, '*'), coalesce(c1, '*'), coalesce(CAST(i0 AS VARCHAR), '*'), coalesce(CAST(i2 AS VARCHAR), '*'))"


def _region_key():
    return F.concat_ws("|", F.col("gid").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in ("c0", "c1", "i0", "i2")])


@query("cms_region_estimate", f"""WITH {LI_SQL}, {regions_sql(LI_SMALL, 'g', 'li')},
  h AS (SELECT lvl, {key_sql(_RKEY)} AS h, n FROM g), cells AS (SELECT lvl, r.row AS row, r.col AS col, sum(n) AS cnt FROM (SELECT lvl, n, unnest({rows_sql(CM)}) AS r FROM h) GROUP BY ALL),
  q AS (SELECT lvl, h, n, min(cnt) AS est FROM (SELECT lvl, h, n, unnest({rows_sql(CM)}) AS r FROM h) p JOIN cells USING (lvl) WHERE cells.row = p.r.row AND cells.col = p.r.col GROUP BY lvl, h, n)
  SELECT lvl, count(*) AS n_regions, CAST(sum(n) AS BIGINT) AS true_sum, CAST(sum(est) AS BIGINT) AS est_sum, CAST(min(est - n) AS BIGINT) AS least_error FROM q GROUP BY lvl""")
def cms_region_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """One Count-Min a level over all regions, asked for every region."""
    g = regions.region_table(li(spark, sf), LI_SMALL).select("lvl", key_hash(_region_key()).alias("h"), "n")
    spread = g.select("lvl", "h", "n", F.posexplode(CM.positions(F.col("h"))).alias("row", "col"))
    cells = spread.groupBy("lvl", "row", "col").agg(F.sum("n").alias("cnt"))
    est = spread.join(cells, ["lvl", "row", "col"]).groupBy("lvl", "h", "n").agg(F.min("cnt").alias("est"))
    return est.groupBy("lvl").agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("true_sum"), F.sum("est").cast("long").alias("est_sum"), F.min(F.col("est") - F.col("n")).cast("long").alias("least_error"))


_BITS = f"SELECT DISTINCT r.col AS pos FROM (SELECT unnest({rows_sql(BF)}) AS r FROM (SELECT DISTINCT {key_sql(_KEY)} AS h FROM li WHERE c0 <> 'N'))"


@query("bloom_positions", f"WITH {LI_SQL} {_BITS}")
def bloom_positions(spark: SparkSession, sf: str) -> DataFrame:
    return membership.bloom(li(spark, sf).where("c0 <> 'N'"), _key(), BF)


@query("bloom_merge", f"WITH {LI_SQL} {_BITS}")
def bloom_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf).where("c0 <> 'N'")
    return membership.merged([membership.bloom(rows.where(F.col("c1") == v), _key(), BF) for v in ("F", "O")])


@query("bloom_probe", f"""WITH {LI_SQL}, bits AS ({_BITS}), k AS (SELECT DISTINCT {_KEY} AS key FROM li)
  SELECT key, bool_and(bits.pos IS NOT NULL) AS present FROM (SELECT key, unnest({rows_sql(BF, key_sql('key'))}) AS r FROM k) p LEFT JOIN bits ON bits.pos = p.r.col GROUP BY key""")
def bloom_probe(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf)
    return membership.probe(rows.select(_key().alias("key")).distinct(), F.col("key"), membership.bloom(rows.where("c0 <> 'N'"), _key(), BF), BF)


@query("bloom_sparse_level", f"""WITH {LI_SQL}, bits AS ({_BITS}), k AS (SELECT DISTINCT {_KEY} AS key FROM li),
  p AS (SELECT key, bool_and(bits.pos IS NOT NULL) AS present FROM (SELECT key, unnest({rows_sql(BF, key_sql('key'))}) AS r FROM k) p LEFT JOIN bits ON bits.pos = p.r.col GROUP BY key) SELECT CAST(count(*) FILTER (present) AS BIGINT) AS estimate FROM p""")
def bloom_sparse_level(spark: SparkSession, sf: str) -> DataFrame:
    """A level whose counter is a filter: each present region counts as one."""
    return bloom_probe(spark, sf).agg(F.count_if("present").alias("estimate"))


@query("node_tracker", f"WITH {LI_SQL} SELECT DISTINCT c0, c1, c2 FROM li")
def node_tracker(spark: SparkSession, sf: str) -> DataFrame:
    return membership.nodes(li(spark, sf), ["c0", "c1", "c2"])


SIDE = 64
_BITMAP = f"""e AS (SELECT 'i0' AS col, 10 AS base, (SELECT min(e) FROM range(10) t(e) WHERE (SELECT max(abs(i0)) FROM src) < {SIDE} * pow(10, e)) AS e UNION ALL SELECT 'i1', 5, (SELECT min(e) FROM range(10) t(e) WHERE (SELECT max(abs(i1)) FROM src) < {SIDE} * pow(5, e))),
  bm AS (SELECT DISTINCT col, e, CAST(floor(v / pow(base, e)) AS BIGINT) AS bucket FROM (SELECT 'i0' AS col, i0 AS v FROM src UNION ALL SELECT 'i1', i1 FROM src) JOIN e USING (col))"""


@query("value_bitmap", f"WITH {CUST_SQL}, src AS (SELECT * FROM cu), {_BITMAP} SELECT col, CAST(e AS INTEGER) AS e, bucket FROM bm")
def value_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    return membership.bitmaps(cust(spark, sf), {"i0": 10, "i1": 5}, SIDE)


@query("value_bitmap_merge", f"WITH {CUST_SQL}, src AS (SELECT * FROM cu), {_BITMAP} SELECT col, CAST(e AS INTEGER) AS e, bucket FROM bm")
def value_bitmap_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Small and large values apart (and so at different exponents), merged."""
    c = cust(spark, sf)
    near = F.col("i0").between(-400, 400)
    bases = {"i0": 10, "i1": 5}
    return membership.merged_bitmaps([membership.bitmaps(c.where(near), bases, SIDE), membership.bitmaps(c.where(~near), bases, SIDE)], bases)


@query("value_bitmap_prune", f"""WITH {CUST_SQL}, src AS (SELECT * FROM cu), {_BITMAP}, blocks AS (SELECT l AS lvl, j AS idx FROM range(4) t(l), range(-200, 200) s(j))
  SELECT CAST(lvl AS BIGINT) AS lvl, idx FROM blocks WHERE EXISTS (SELECT 1 FROM bm WHERE col = 'i0' AND bucket * pow(10, e) < (idx + 1) * pow(10, lvl) AND (bucket + 1) * pow(10, e) > idx * pow(10, lvl))""")
def value_bitmap_prune(spark: SparkSession, sf: str) -> DataFrame:
    blocks = spark.range(-200, 200).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("lvl"), F.col("id").alias("idx"))
    return membership.pruned(blocks, membership.bitmaps(cust(spark, sf), {"i0": 10}, SIDE).where("col = 'i0'"), 10)


_H = key_sql("CAST(event_id AS VARCHAR)")


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id", (F.col("user_id") % 10).cast("string").alias("c1"), key_hash(F.col("event_id").cast("string")).alias("h"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("die_hash", f"SELECT CAST(60 - length(bin({_H})) AS BIGINT) AS level, count(*) AS n FROM events GROUP BY ALL")
def die_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy(samples.geometric_level(F.col("h"), 60).cast("long").alias("level")).agg(F.count("*").alias("n"))


_KMIN = f"SELECT event_type, h, n_seen FROM (SELECT event_type, h, row_number() OVER (PARTITION BY event_type ORDER BY h) AS r, count(*) OVER (PARTITION BY event_type) AS n_seen FROM (SELECT event_type, {_H} AS h FROM events)) WHERE r <= 32"


@query("kmin_sample", _KMIN)
def kmin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return samples.kmin(_events(spark, sf), ["event_type"], "h", 32)


@query("kmin_merge", f"SELECT event_type, h FROM ({_KMIN})")
def kmin_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    a, b = (samples.kmin(e.where(F.col("event_id") % 2 == k), ["event_type"], "h", 32) for k in (0, 1))
    return samples.merged_kmin(a, b, ["event_type"], "h", 32)


_HU = key_sql("CAST(user_id AS VARCHAR)")


@query("kmin_intersection", f"SELECT count(*) AS n_shared FROM (SELECT h FROM (SELECT DISTINCT event_type, h, dense_rank() OVER (PARTITION BY event_type ORDER BY h) AS r FROM (SELECT event_type, {_HU} AS h FROM events)) WHERE r <= 64 GROUP BY h HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))")
def kmin_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose hashes are in the samples of all event types."""
    e = _events(spark, sf).withColumn("h", key_hash(F.col("user_id").cast("string")))
    s = samples.kmin(e, ["event_type"], "h", 64)
    kinds = e.agg(F.count_distinct("event_type").alias("kinds"))
    return s.groupBy("h").agg(F.count_distinct("event_type").alias("n")).join(F.broadcast(kinds), F.col("n") == F.col("kinds")).agg(F.count("*").alias("n_shared"))


@query("distinct_sample", f"""WITH o AS (SELECT DISTINCT event_type, {_HU} AS h, 60 - length(bin({_HU})) AS level FROM events),
  u AS (SELECT event_type, level, sum(count(*)) OVER (PARTITION BY event_type ORDER BY level DESC) AS upto FROM o GROUP BY event_type, level),
  f AS (SELECT event_type, min(level) AS least FROM u WHERE upto <= 50 GROUP BY event_type)
  SELECT event_type, h, CAST(level AS INTEGER) AS level, CAST(least AS INTEGER) AS least FROM o JOIN f USING (event_type) WHERE level >= least""")
def distinct_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("h", key_hash(F.col("user_id").cast("string")))
    return samples.distinct_sample(e, ["event_type"], "h", 50, 60)


OMNI = HashFamily(3, 64, 13)
OMNI_K = 400


def _omni_sql(source: str, wanted: list[tuple[str, list[str]]]) -> str:
    need, blocks = len(wanted) * OMNI.depth, OMNI_K * len(wanted[-1][1])
    spread = math.log(4 * len(wanted) * OMNI.depth * math.sqrt(blocks) / 0.1)
    values = ", ".join(f"('{a}', '{v}')" for a, vs in wanted for v in vs)
    hv = key_sql("concat_ws('=', attribute, value)")
    return f"""WITH {source}, s AS (SELECT attribute, h, r.row AS row, r.col AS col FROM (SELECT attribute, h, unnest({rows_sql(OMNI, hv)}) AS r FROM tall)),
      k AS (SELECT attribute, row, col, h, row_number() OVER (PARTITION BY attribute, row, col ORDER BY h) AS rank, count(*) OVER (PARTITION BY attribute, row, col) AS n_seen FROM s),
      p AS (SELECT DISTINCT attribute, r.row AS row, r.col AS col FROM (SELECT attribute, unnest({rows_sql(OMNI, hv)}) AS r FROM (VALUES {values}) t(attribute, value))),
      got AS (SELECT k.* FROM k JOIN p USING (attribute, row, col) WHERE rank <= {OMNI_K}),
      m AS (SELECT max(n) AS n_max FROM (SELECT attribute, row, sum(n_seen) AS n FROM (SELECT DISTINCT attribute, row, col, n_seen FROM got) GROUP BY attribute, row)),
      c AS (SELECT count(*) AS s_cap FROM (SELECT h FROM (SELECT DISTINCT attribute, row, h FROM got) GROUP BY h HAVING count(*) = {need}))
      SELECT CAST(n_max AS BIGINT) AS n_max, CAST(s_cap AS BIGINT) AS s_cap, CAST(CASE WHEN s_cap >= {3 * spread / 0.5**2!r} THEN ceil(s_cap * n_max / {blocks}.0) ELSE ceil(2 * n_max * {spread!r} / ({blocks} * 0.25)) END AS BIGINT) AS est FROM m, c"""


POINT = [("event_type", ["click"]), ("c1", ["3"])]
_TALL = f"e AS (SELECT {_H} AS h, event_type, CAST(user_id % 10 AS VARCHAR) AS c1 FROM events), tall AS (SELECT h, 'event_type' AS attribute, event_type AS value FROM e UNION ALL SELECT h, 'c1', c1 FROM e)"


@query("omni_point", _omni_sql(_TALL, POINT))
def omni_point(spark: SparkSession, sf: str) -> DataFrame:
    cells = samples.omni_cells(_events(spark, sf), ["event_type", "c1"], F.col("event_id").cast("string"), OMNI, OMNI_K)
    return samples.omni_estimate(cells, POINT, spark, OMNI, OMNI_K, 0.5, 0.1)


BLOCKS = [f"{l}:{i}" for l, i in badic.cover(2, 3, 21)]
RANGE = [("event_type", ["click"]), ("day", BLOCKS)]


@query("omni_range", _omni_sql(f"e AS (SELECT {_H} AS h, event_type, CAST(floor(epoch(ts) / 86400) - 19723 AS BIGINT) AS day FROM events), tall AS (SELECT h, 'event_type' AS attribute, event_type AS value FROM e UNION ALL SELECT h, 'day', concat(l, ':', CAST(floor(day / pow(2, l)) AS BIGINT)) FROM e, range(6) t(l))", RANGE))
def omni_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range attribute is a set of dyadic blocks, one a level for each record."""
    e = _events(spark, sf).withColumn("day", (F.floor(F.col("us") / 86_400_000_000) - 19723).cast("long"))
    tall = e.select("h", F.explode(F.concat(F.array(F.struct(F.lit("event_type").alias("attribute"), F.col("event_type").alias("value"))), F.array(*[F.struct(F.lit("day").alias("attribute"), F.concat(F.lit(f"{l}:"), level_index(F.col("day"), 2, l).cast("string")).alias("value")) for l in range(6)]))).alias("x")).select("h", "x.*")
    spread = tall.select("attribute", "h", F.posexplode(OMNI.positions(key_hash(F.concat_ws("=", "attribute", "value")))).alias("row", "col"))
    return samples.omni_estimate(samples.kmin(spread, ["attribute", "row", "col"], "h", OMNI_K), RANGE, spark, OMNI, OMNI_K, 0.5, 0.1)


@query("subset_inclusion_exclusion", f"WITH {LI_SQL} SELECT count(*) AS n_union FROM li WHERE c0 = 'A' OR c1 = 'F' OR c2 = '4'")
def subset_inclusion_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Size of a union from signed counts of all conjunctions, by one CUBE."""
    want = {"c0": "A", "c1": "F", "c2": "4"}
    g = li(spark, sf).groupBy(*want).count().cube(*want).agg(F.sum("count").alias("n"), F.grouping_id().cast("int").alias("gid"))
    match = F.lit(True)
    for i, (c, v) in enumerate(want.items()):
        match &= (F.col("gid").bitwiseAND(F.lit(4 >> i)) > 0) | (F.col(c) == v)
    bits = 3 - F.bit_count("gid")
    return g.where(match & (F.col("gid") < 7)).agg(F.sum(F.when(bits % 2 == 1, F.col("n")).otherwise(-F.col("n"))).cast("long").alias("n_union"))


BITS = 6


def _hilbert_sql(points: str) -> str:
    """CTE h(px, py, d): the curve index of ``points`` (x, y), a quadrant a step."""
    last = (1 << BITS) - 1
    return f"""pts AS ({points}), s(px, py, k, x, y, d) AS (
      SELECT x, y, {BITS - 1}, x, y, CAST(0 AS BIGINT) FROM pts
      UNION ALL
      SELECT px, py, k - 1,
        CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN {last} - y ELSE y END) ELSE x END,
        CASE WHEN ry = 0 THEN (CASE WHEN rx = 1 THEN {last} - x ELSE x END) ELSE y END,
        d + (CAST(1 AS BIGINT) << (2 * k)) * xor(3 * rx, ry)
      FROM (SELECT *, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry FROM s WHERE k >= 0)
    ), h AS (SELECT px, py, d FROM s WHERE k = -1)"""


@query("hilbert_index", f"WITH RECURSIVE {LI_SQL}, {_hilbert_sql('SELECT DISTINCT CAST(floor(i0 / 64.0) AS BIGINT) AS x, i2 AS y FROM li WHERE floor(i0 / 64.0) BETWEEN 0 AND 63 AND i2 BETWEEN 0 AND 63')} SELECT px AS x, py AS y, d AS h, count(*) AS n FROM h JOIN li ON floor(i0 / 64.0) = px AND i2 = py GROUP BY ALL")
def hilbert_index(spark: SparkSession, sf: str) -> DataFrame:
    """Curve index of each (day, quantity) cell; tests hold it against the defining properties."""
    c = li(spark, sf).select(level_index(F.col("i0"), 2, 6).alias("x"), F.col("i2").alias("y")).where("x between 0 and 63 and y between 0 and 63").groupBy("x", "y").agg(F.count("*").alias("n"))
    return c.select("x", "y", hilbert.encode(F.col("x"), F.col("y"), BITS).alias("h"), "n")


LO, HI = (3, 5), (29, 40)


@query("hilbert_coverage", f"SELECT CAST({(HI[0] - LO[0] + 1) * (HI[1] - LO[1] + 1)} AS BIGINT) AS covered, TRUE AS apart")
def hilbert_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges of a box cover as many indices as it has points, none twice."""
    r = hilbert.ranges(hilbert.box_points(spark, LO, HI), BITS)
    return r.agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("covered"), (F.count("*") == F.count_distinct("start")).alias("apart"))


@query("hilbert_ranges", f"WITH RECURSIVE {_hilbert_sql(f'SELECT x, y FROM range({LO[0]}, {HI[0] + 1}) a(x), range({LO[1]}, {HI[1] + 1}) b(y)')}, g AS (SELECT d, d - row_number() OVER (ORDER BY d) AS run FROM h) SELECT min(d) AS start, max(d) AS end FROM g GROUP BY run")
def hilbert_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.ranges(hilbert.box_points(spark, LO, HI), BITS)


@query("border_points", f"SELECT x, y FROM range({LO[0]}, {HI[0] + 1}) a(x), range({LO[1]}, {HI[1] + 1}) b(y) WHERE x IN ({LO[0]}, {HI[0]}) OR y IN ({LO[1]}, {HI[1]})")
def border_points(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert.border(hilbert.box_points(spark, LO, HI), LO, HI)


@query("hilbert_sketch_estimate", f"WITH {LI_SQL} SELECT count(*) AS estimate FROM li WHERE floor(i0 / 64.0) BETWEEN {LO[0]} AND {HI[0]} AND i2 BETWEEN {LO[1]} AND {HI[1]}")
def hilbert_sketch_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """A box as index ranges, counted over the curve index of each row."""
    counts = hilbert_index(spark, sf)
    r = hilbert.ranges(hilbert.box_points(spark, LO, HI), BITS)
    return counts.join(F.broadcast(r), F.col("h").between(F.col("start"), F.col("end"))).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("estimate"))

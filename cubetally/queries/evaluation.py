"""Metrics, sizes, workloads, preparation, storage and streams."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubetally.functions.hashing import HashFamily
from cubetally.operators import countmin, evaluate, regions, workload
from cubetally.plans import badic, predicates, sizing
from cubetally.plans.schema import Layout, level_index
from cubetally.queries.fixtures import EV, EV_SQL, LI, LI_SMALL, LI_SQL, QUERIES, counts_sql, ev, event_columns, key_sql, li, regions_sql, rows_sql, where_sql
from cubetally.queries.synopses import _KEY, _key
from cubetally.sources import store
from cubetally.streaming import region_stream

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SMALL = HashFamily(2, 23, 5)
_EST = f"""c AS (SELECT r.row AS row, r.col AS col, sum(w) AS cnt FROM (SELECT w, unnest({rows_sql(SMALL)}) AS r FROM (SELECT {key_sql(_KEY)} AS h, count(*) AS w FROM li GROUP BY h)) GROUP BY ALL),
  k AS (SELECT {_KEY} AS key, count(*) AS true_count FROM li GROUP BY ALL),
  e AS (SELECT key, true_count, CAST(min(cnt) AS BIGINT) AS estimate FROM (SELECT key, true_count, unnest({rows_sql(SMALL, key_sql('key'))}) AS r FROM k) p JOIN c ON c.row = p.r.row AND c.col = p.r.col GROUP BY ALL)"""


def _estimates(spark, sf) -> DataFrame:
    """A small sketch (so with errors) asked for every category triple."""
    rows = li(spark, sf)
    keys = rows.groupBy(_key().alias("key")).agg(F.count("*").alias("true_count"))
    est = countmin.point_estimates(keys.select("key"), F.col("key"), countmin.cells(rows, _key(), SMALL, None), SMALL)
    return keys.join(est, "key").select("key", "true_count", F.col("est").alias("estimate"))


@query("error_metrics", f"WITH {LI_SQL}, {_EST} SELECT key, true_count, estimate, abs(true_count - estimate) AS absolute_error, round(abs(true_count - estimate) / (SELECT count(*) FROM li)::DOUBLE, 12) AS normalized_error, round(CASE WHEN true_count = 0 THEN 0 ELSE abs(true_count - estimate) / true_count::DOUBLE END, 12) AS relative_error FROM e")
def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = _estimates(spark, sf)
    total = e.agg(F.sum("true_count").alias("total"))
    out = evaluate.errors(e.join(F.broadcast(total), F.lit(True)), F.col("total")).drop("total")
    return out.withColumns({c: F.round(c, 12) for c in ("normalized_error", "relative_error")})


@query("region_accuracy", f"WITH {LI_SQL}, {_EST} SELECT round(avg(abs(true_count - estimate)), 9) AS mean_error, max(abs(true_count - estimate)) AS most, min(abs(true_count - estimate)) AS least, count(*) FILTER (true_count = estimate) AS n_exact FROM e")
def region_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    a = F.abs(F.col("true_count") - F.col("estimate"))
    return _estimates(spark, sf).agg(F.round(F.avg(a), 9).alias("mean_error"), F.max(a).alias("most"), F.min(a).alias("least"), F.count_if(F.col("true_count") == F.col("estimate")).alias("n_exact"))


@query("relative_entropy", f"WITH {LI_SQL}, {_EST}, t AS (SELECT greatest(true_count, 1)::DOUBLE AS p, greatest(estimate, 1)::DOUBLE AS q FROM e), s AS (SELECT sum(p) AS sp, sum(q) AS sq FROM t) SELECT round(sum(p / sp * ln((p / sp) / (q / sq))), 9) AS divergence FROM t, s")
def relative_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.relative_entropy(_estimates(spark, sf)).select(F.round("divergence", 9).alias("divergence"))


@query("error_quantiles", f"WITH {LI_SQL}, {_EST} SELECT split_part(key, '|', 1) AS c0, quantile_cont(abs(true_count - estimate), 0.25) AS q25, quantile_cont(abs(true_count - estimate), 0.5) AS median, quantile_cont(abs(true_count - estimate), 0.75) AS q75 FROM e GROUP BY ALL")
def error_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    e = _estimates(spark, sf).select(F.split_part("key", F.lit("|"), F.lit(1)).alias("c0"), F.abs(F.col("true_count") - F.col("estimate")).alias("a"))
    return evaluate.quartiles(e, "a", ["c0"])


@query("iqr_outliers", f"WITH {LI_SQL}, {_EST}, q AS (SELECT quantile_cont(true_count, 0.25) AS a, quantile_cont(true_count, 0.75) AS b FROM e) SELECT key, true_count, estimate FROM e, q WHERE true_count BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.without_outliers(_estimates(spark, sf), "true_count")


@query("query_work", f"WITH {LI_SQL}, d AS (SELECT count(DISTINCT concat_ws('|', c0, c1)) AS nodes FROM li) SELECT nodes, 3::BIGINT AS cubes, nodes + 3 AS total_lookups FROM d")
def query_work(spark: SparkSession, sf: str) -> DataFrame:
    d = li(spark, sf).agg(F.count_distinct(F.concat_ws("|", "c0", "c1")).alias("nodes")).withColumn("cubes", F.lit(3).cast("long"))
    return evaluate.work(d, ["nodes", "cubes"])


@query("equivalent_sketches", " UNION ALL ".join(f"SELECT * FROM (WITH {LI_SQL}, c AS (SELECT r.row AS row, r.col AS col, sum(w) AS cnt FROM (SELECT w, unnest({rows_sql(HashFamily(2, w, 5))}) AS r FROM (SELECT {key_sql(_KEY)} AS h, count(*) AS w FROM li GROUP BY h)) GROUP BY ALL), k AS (SELECT DISTINCT {_KEY} AS key FROM li) SELECT {w}::BIGINT AS width, key, CAST(min(cnt) AS BIGINT) AS est FROM (SELECT key, unnest({rows_sql(HashFamily(2, w, 5), key_sql('key'))}) AS r FROM k) p JOIN c ON c.row = p.r.row AND c.col = p.r.col GROUP BY key)" for w in (23, 101)))
def equivalent_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """The same keys asked of several sketches."""
    rows, out = li(spark, sf), None
    for w in (23, 101):
        f = HashFamily(2, w, 5)
        part = countmin.point_estimates(rows.select(_key().alias("key")).distinct(), F.col("key"), countmin.cells(rows, _key(), f, None), f).withColumn("width", F.lit(w).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query("bloom_fpr_model", "SELECT n, k, round(pow(1 - exp(-k * n / 9586.0), k), 9) AS fpr, round(9586.0 / n * ln(2), 9) AS best_k FROM range(1, 9) a(k), (VALUES (500::BIGINT), (1000), (2000)) b(n)")
def bloom_fpr_model(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.range(1, 9).select(F.col("id").alias("k"), F.explode(F.array(*[F.lit(n).cast("long") for n in (500, 1000, 2000)])).alias("n"))
    return t.select("n", "k", F.round(evaluate.bloom_false_positives(F.col("k"), F.col("n"), F.lit(9586.0)), 9).alias("fpr"), F.round(evaluate.best_hashes(F.col("n"), F.lit(9586.0)), 9).alias("best_k"))


@query("cover_volume", "SELECT * FROM (VALUES " + ", ".join(f"({l}::BIGINT, {sum(3**l for x, _ in badic.cover(3, 4, 200) if x == l)}::BIGINT)" for l in sorted({x for x, _ in badic.cover(3, 4, 200)})) + ") t(lvl, volume)")
def cover_volume(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.createDataFrame([(3, 4, 200)], "base long, lo long, hi long")
    return badic.cover_table(r, 8).groupBy(F.col("lvl").cast("long").alias("lvl")).agg(F.sum(F.pow("base", "lvl").cast("long")).alias("volume"))


_SIZES = sizing.sizes(272, 5, 9586, 64) | {f"updates_{k}": v for k, v in sizing.updates(LI).items()}


@query("sketch_sizes", "SELECT * FROM (VALUES ('count_min', 5440::BIGINT), ('bloom', 1199), ('bitmap', 16), ('node_set', 0)) t(structure, bytes)")
def sketch_sizes(spark: SparkSession, sf: str) -> DataFrame:
    w, d = countmin.dimensions(0.01, 0.01)
    bits, _ = sizing.filter_for(1000, 0.01)
    return spark.createDataFrame(list(sizing.sizes(w, d, bits, 64).items()), "structure string, bytes long")


@query("update_costs", "SELECT * FROM (VALUES ('cat', 4::BIGINT), ('num', 36), ('region', 144)) t(structure, n)")
def update_costs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(sizing.updates(LI).items()), "structure string, n long")


@query("memory_budget", "SELECT * FROM (VALUES ('count_min', 16777216::BIGINT), ('num_index', 10066329), ('region_index', 40265319)) t(structure, bytes)")
def memory_budget(spark: SparkSession, sf: str) -> DataFrame:
    b = sizing.budget(64 << 20, LI, 60_000)
    return spark.createDataFrame([(k, v) for k, v in b.items() if k != "hashes"], "structure string, bytes long")


@query("level_widths", "SELECT CAST(l AS BIGINT) AS lvl, CAST(ceil(10000 / pow(pow(100, l), 0.5)) AS BIGINT) AS width FROM range(5) t(l)")
def level_widths(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(l, w) for l, (_, w, _) in enumerate(sizing.decreasing_levels(LI, 10_000, 3, 0.5))], "lvl long, width long")


@query("value_frequencies", f"WITH {LI_SQL}, t AS (SELECT 'c0' AS col, c0 AS value FROM li UNION ALL SELECT 'c1', c1 FROM li UNION ALL SELECT 'c2', c2 FROM li) SELECT col, value, count(*) AS n, count(*) / (SELECT count(*) FROM li)::DOUBLE AS freq FROM t GROUP BY ALL")
def value_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return workload.value_frequencies(li(spark, sf), ["c0", "c1", "c2"])


@query("category_predicate", f"WITH {LI_SQL}, t AS (SELECT c2 AS value, count(*) / (SELECT count(*) FROM li)::DOUBLE AS freq FROM li GROUP BY c2) SELECT 'c2' AS col, value, freq FROM t ORDER BY abs(freq - 0.1), value LIMIT 1")
def category_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return workload.category_for(workload.value_frequencies(li(spark, sf), ["c2"]), 0.1)


@query("numeric_predicate", f"WITH {LI_SQL}, p AS (SELECT count(*) FILTER (i0 < 500) / count(*)::DOUBLE + 0.2 AS p FROM li), o AS (SELECT i0, row_number() OVER (ORDER BY i0) - 1 AS k FROM li), w AS (SELECT p * ((SELECT count(*) FROM li) - 1) AS place FROM p), h AS (SELECT CAST(floor((SELECT i0 FROM o, w WHERE k = floor(place)) + (place - floor(place)) * ((SELECT i0 FROM o, w WHERE k = ceil(place)) - (SELECT i0 FROM o, w WHERE k = floor(place)))) AS BIGINT) AS hi FROM w) SELECT 500::BIGINT AS lo, hi, round(avg(CASE WHEN i0 BETWEEN 500 AND hi THEN 1.0 ELSE 0 END), 9) AS selectivity FROM li, h GROUP BY hi")
def numeric_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return workload.range_for(li(spark, sf), "i0", 500, 0.2).withColumn("selectivity", F.round("selectivity", 9))


@query("profile_num_cols", f"WITH {LI_SQL}, q AS (SELECT 'i0' AS col, 5.0 AS b, quantile_cont(i0, 0.75) - quantile_cont(i0, 0.25) AS iqr FROM li UNION ALL SELECT 'i1', 10.0, quantile_cont(i1, 0.75) - quantile_cont(i1, 0.25) FROM li UNION ALL SELECT 'i2', 2.0, quantile_cont(i2, 0.75) - quantile_cont(i2, 0.25) FROM li) SELECT col, iqr, CAST(ceil(ln(greatest(1.0, iqr)) / ln(b)) AS BIGINT) AS n_levels FROM q")
def profile_num_cols(spark: SparkSession, sf: str) -> DataFrame:
    return workload.profile(li(spark, sf), LI)


@query("random_workload", "SELECT i AS query_id, TRUE AS same FROM range(12) t(i)")
def random_workload(spark: SparkSession, sf: str) -> DataFrame:
    """Random queries: whether their counts from the region store and from the rows agree."""
    rows = li(spark, sf)
    qs = workload.random_queries(rows, LI, 12, 3, 0.4, 11)
    return regions.estimates(rows, qs, LI).join(predicates.count_each(rows, qs, LI), "query_id").select("query_id", (F.col("n") == F.col("estimate")).alias("same"))


@query("selectivity_workload", f"WITH {LI_SQL}, t AS (SELECT c0, count(*) AS n FROM li GROUP BY c0) SELECT n FROM t ORDER BY abs(n / (SELECT count(*) FROM li)::DOUBLE - 0.33), c0 LIMIT 1")
def selectivity_workload(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf)
    q = {"c0": [workload.category_for(workload.value_frequencies(rows, ["c0"]), 0.33).first()["value"]]}
    return predicates.count_each(rows, [q], LI).select("n")


@query("synthetic_rows", "SELECT 5000::BIGINT AS n, 3::BIGINT AS dims")
def synthetic_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = workload.synthetic(spark, 5000, 3, 1)
    return t.agg(F.count("*").alias("n")).withColumn("dims", F.lit(len(t.columns)).cast("long"))


@query("partition_slices", "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) AS n, o_orderkey FROM orders) SELECT CAST(least(i // (n // 7), 6) AS BIGINT) AS part, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM o GROUP BY ALL")
def partition_slices(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return store.sliced(o, ["o_orderkey"], 7).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("prep_dense_rank", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS BIGINT) AS day FROM orders")
def prep_dense_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Dense day numbers: ranks over the distinct days (few), joined back to the rows."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    days = o.select("d").distinct().withColumn("day", (F.row_number().over(Window.orderBy("d")) - 1).cast("long"))
    return o.join(days, "d").select("o_orderkey", "day")


@query("prep_day_of_year", "SELECT o_orderkey, CAST(dayofyear(o_orderdate) - 1 AS BIGINT) AS day, strftime(o_orderdate, '%d.%m.%Y') AS text FROM orders")
def prep_day_of_year(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", (F.dayofyear("o_orderdate") - 1).cast("long").alias("day"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("text"))


@query("prep_join", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def prep_join(spark: SparkSession, sf: str) -> DataFrame:
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("prep_substring", "SELECT DISTINCT substr(p_brand, 1, 3) AS head, length(p_type) AS n FROM part")
def prep_substring(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(F.substring("p_brand", 1, 3).alias("head"), F.length("p_type").cast("long").alias("n")).distinct()


@query("prep_numbers", "SELECT c_custkey, CAST(trunc(abs(coalesce(c_acctbal, 0))) AS BIGINT) AS x, CAST(floor(c_acctbal) AS BIGINT) AS low FROM customer")
def prep_numbers(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", F.abs(F.coalesce("c_acctbal", F.lit(0.0))).cast("long").alias("x"), F.floor("c_acctbal").cast("long").alias("low"))


@query("prep_chunks", "SELECT CAST(k AS BIGINT) AS chunk, count(*) AS n FROM (SELECT ntile(5) OVER (ORDER BY o_orderkey) AS k FROM orders) GROUP BY k")
def prep_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Five even chunks, counted apart and put together again."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    n = o.count()
    small, extra = divmod(n, 5)
    edges, at = [], 0
    for k in range(5):
        at += small + (k < extra)
        edges.append(at)
    placed = store.sliced(o, ["o_orderkey"], n)  # slices of one row: the place in the order
    chunk = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("part"))) + 1
    return placed.groupBy(chunk.cast("long").alias("chunk")).agg(F.count("*").alias("n"))


@query("prep_summary", "SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS priorities, round(avg(o_totalprice), 6) AS mean_price, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def prep_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("priorities"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


def _scratch(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="cubetally-")).rstrip("/") + f"/store-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


@query("sketch_roundtrip", f"WITH {LI_SQL}, {regions_sql(LI_SMALL, 'g', 'li')} SELECT CAST(lvl AS BIGINT) AS lvl, gid, count(*) AS n_regions, CAST(sum(n) AS BIGINT) AS n_updates, (SELECT count(*) FROM li) AS n_rows FROM g GROUP BY lvl, gid")
def sketch_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Saved, loaded and summed: layout, row count and regions all come back."""
    rows, path = li(spark, sf), _scratch(spark)
    store.save_sketch(path, LI_SMALL, rows.count(), {"regions": regions.region_table(rows, LI_SMALL)})
    layout, n, parts = store.load_sketch(spark, path)
    if layout != LI_SMALL:
        raise ValueError("the layout changed")
    return parts["regions"]().groupBy(F.col("lvl").cast("long").alias("lvl"), F.col("gid").cast("long").alias("gid")).agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("n_updates")).withColumn("n_rows", F.lit(n).cast("long"))


@query("csv_roundtrip", "SELECT r_regionkey, r_name FROM region")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    store.write_table(spark.read.parquet(f"{sf}/region.parquet"), path, "csv")
    return store.read_table(spark, path, "csv", "r_regionkey int, r_name string")


_WORKLOAD = json.dumps({"queryset_name": "standing", "num_queries": len(QUERIES), "queries": [[list(q[c]) if c in q else "*" for c in LI.columns] for q in QUERIES]})


@query("workload_json", f"WITH {LI_SQL} {counts_sql(QUERIES, 'li')}")
def workload_json(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON workload, loaded and answered."""
    return predicates.count_each(li(spark, sf), store.workload_from(_WORKLOAD, LI), LI)


@query("stream_region_counts", f"WITH {EV_SQL}, {regions_sql(EV, 'g', 'ev')} SELECT lvl, gid, count(*) AS n_regions, CAST(sum(n) AS BIGINT) AS n_updates, max(n) AS most FROM g GROUP BY lvl, gid")
def stream_region_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of files, counted batch by batch."""
    path = _scratch(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = event_columns(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    region_stream.start(stream, EV, f"{path}/deltas", f"{path}/checkpoint").awaitTermination()
    return region_stream.current(spark, EV, f"{path}/deltas").groupBy("lvl", "gid").agg(F.count("*").alias("n_regions"), F.sum("n").cast("long").alias("n_updates"), F.max("n").alias("most"))

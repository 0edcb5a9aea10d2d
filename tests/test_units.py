"""Covers, predicates, layouts, sizes, samples and storage on small cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cubetally.functions import noise
from cubetally.functions.hashing import HashFamily, matrix_hash, matrix_rows
from cubetally.operators import countmin, hilbert, membership, regions, samples, servers, workload
from cubetally.plans import badic, predicates, sizing
from cubetally.plans.schema import Layout, best_mask, full_masks, level_index, near_full_masks
from cubetally.sources import store

L = Layout(("a", "b"), ("x", "y"), (2, 5), 3, domains={"a": ("p", "q"), "b": ("r", "s")})


@given(st.integers(2, 7), st.integers(-500, 500), st.integers(0, 700), st.none() | st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_cover_is_a_minimal_partition(base, lo, size, cap):
    hi = lo + size
    blocks = badic.cover(base, lo, hi, cap)
    points = [v for l, i in blocks for v in range(i * base**l, (i + 1) * base**l)]
    assert points == list(range(lo, hi + 1))
    for l, i in blocks:
        if cap is None or l < cap:
            p = i // base
            assert p * base ** (l + 1) < lo or (p + 1) * base ** (l + 1) - 1 > hi


@pytest.mark.parametrize(
    ("base", "lo", "hi", "blocks"),
    [(2, 1, 6, {(0, 1), (0, 6), (1, 1), (1, 2)}), (5, 0, 24, {(2, 0)}), (2, -2, 1, {(1, -1), (1, 0)}), (1, 3, 5, {(0, 3), (0, 4), (0, 5)})],
)
def test_known_covers(base, lo, hi, blocks):
    assert set(badic.cover(base, lo, hi)) == blocks


@given(st.lists(st.tuples(st.sampled_from([2, 3, 5]), st.integers(-30, 30), st.integers(0, 40)), min_size=1, max_size=3))
@settings(max_examples=60, deadline=None)
def test_boxes_add_up(parts):
    ranges = [(b, lo, lo + n) for b, lo, n in parts]
    volume = sum(math.prod((h - l + 1) * b**m for (l, h), (b, _, _) in zip(lim, ranges, strict=True)) for m, lim in badic.boxes(ranges, 3))
    assert volume == math.prod(hi - lo + 1 for _, lo, hi in ranges)


def test_predicates_are_checked():
    assert predicates.checked({"a": "*", "x": [3, 5], "b": {"s", "r"}}, L) == {"x": (3, 5), "b": ("r", "s")}
    for bad in ({"x": [5, 3]}, {"a": ["z"]}, {"nope": [1]}):
        with pytest.raises(ValueError):
            predicates.checked(bad, L)
    for bad in ({"x": [1.5, 2]}, {"x": 3}, {"a": 7}, {"x": (True, 2)}):
        with pytest.raises(TypeError):
            predicates.checked(bad, L)
    assert predicates.from_vector(["*", ["r"], [1, 2], "*"], L) == {"b": ["r"], "x": [1, 2]}


def test_masks():
    assert len(full_masks(3)) == 7 and len(near_full_masks(5)) == 16
    assert best_mask([(0, 1, 2), (1,), (0, 2)], {2}) == (0, 2)
    with pytest.raises(ValueError):
        best_mask([(1,)], {0})
    assert L.grouping_id(1, (1,)) == 0b0110


def test_level_index_floors(spark):
    rows = spark.createDataFrame([(v,) for v in (-7, -1, 0, 7, 2**60 + 1, -(2**60) - 1)], "v long")
    got = [r[0] for r in rows.select(level_index(F.col("v"), 2, 1)).collect()]
    assert got == [v // 2 for v in (-7, -1, 0, 7, 2**60 + 1, -(2**60) - 1)]
    rows = spark.createDataFrame([(2**62 + 3,), (10**18 + 7,), (-(2**63),), (None,)], "v long")
    for base, level in ((5, 1), (2, 1), (10, 3), (2, 64)):
        got = [r[0] for r in rows.select(level_index(F.col("v"), base, level)).collect()]
        assert got == [v // base**level for v in (2**62 + 3, 10**18 + 7, -(2**63))] + [None]


def test_region_estimates_equal_counts(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("a"), F.when(F.col("id") % 2 == 0, "r").otherwise("s").alias("b"), (F.col("id") % 41 - 20).alias("x"), (F.col("id") % 17 - 3).alias("y"))
    qs = [{"x": (-13, 9)}, {"a": ["p"], "y": (-2, 11)}, {"b": ["s"], "x": (-20, 20), "y": (0, 0)}, {"b": ["r"]}, {}, {"x": (100, 200)}]
    got = {r["query_id"]: r["estimate"] for r in regions.estimates(rows, qs, L).collect()}
    want = {r["query_id"]: r["n"] for r in predicates.count_each(rows, qs, L).collect()}
    assert got == want


def test_empty_table(spark):
    rows = spark.createDataFrame([], "a string, b string, x long, y long")
    assert [r["estimate"] for r in regions.estimates(rows, [{"x": (0, 3)}, {}], L).orderBy("query_id").collect()] == [0, 0]
    # the grand total of nothing is a group of its own
    assert regions.region_table(rows, L).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == 0


def test_count_min_never_under_counts(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("string").alias("k"))
    f = HashFamily(2, 11, 1)
    cells = countmin.cells(df, F.col("k"), f, None)
    true = df.groupBy("k").count()
    est = countmin.point_estimates(true.select("k"), F.col("k"), cells, f)
    assert true.join(est, "k").where("est < count").count() == 0
    assert countmin.dimensions(0.01, 0.01) == (272, 5)
    parts = [countmin.cells(df.where(F.col("k") % 2 == i), F.col("k"), f, None) for i in (0, 1)]
    assert countmin.merged(parts).exceptAll(cells).count() == 0


def test_bloom_has_no_false_negative(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    f = HashFamily(3, 997, 2)
    assert membership.probe(df, F.col("k"), membership.bloom(df, F.col("k"), f), f).where(~F.col("present")).count() == 0
    assert membership.bloom_dimensions(1000, 0.01) == (9586, 7)


def test_bitmaps_with_negatives(spark):
    a = spark.createDataFrame([(v,) for v in (3, -4, 0, 7, -1)], "v long")
    bits = membership.bitmaps(a, {"v": 2}, 8)
    assert {(r["e"], r["bucket"]) for r in bits.collect()} == {(0, v) for v in (3, -4, 0, 7, -1)}
    more = membership.merged_bitmaps([bits, membership.bitmaps(spark.createDataFrame([(12,)], "v long"), {"v": 2}, 8)], {"v": 2})
    assert {(r["e"], r["bucket"]) for r in more.collect()} == {(1, v // 2) for v in (3, -4, 0, 7, -1, 12)}


def test_matrix_hash_of_zero(spark):
    rows = matrix_rows(8, 4, 3)
    got = {r["id"]: r["h"] for r in spark.range(16).select("id", matrix_hash(F.col("id"), rows, 8).alias("h")).collect()}
    assert got[0] == 255 and got[1] == rows[0] and got[6] == rows[1] ^ rows[2]


def test_kmin_keeps_the_least(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 50).alias("h"))
    got = samples.kmin(df, ["g"], "h", 5).collect()
    for g in (0, 1):
        assert sorted(r["h"] for r in got if r["g"] == g) == sorted({i * 7 % 50 for i in range(100) if i % 2 == g})[:5]
        assert {r["n_seen"] for r in got if r["g"] == g} == {50}


def test_hilbert_steps_are_neighbours(spark):
    pts = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    got = sorted((r["h"], r["x"], r["y"]) for r in pts.select("x", "y", hilbert.encode(F.col("x"), F.col("y"), 4).alias("h")).collect())
    assert [g[0] for g in got] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:], strict=False))
    assert hilbert.ranges(hilbert.box_points(spark, (1, 1), (6, 6)), 3).agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0] == 36


def test_budget_is_kept(spark):
    rows = spark.createDataFrame([("p", "r", 1, 1)], "a string, b string, x long, y long")
    server = servers.CentralServer(rows, L, 1.0)
    server.answer([{}], 0.6)
    with pytest.raises(servers.BudgetExceeded):
        server.answer([{}], 0.6)
    assert server.ledger.remaining() == pytest.approx(0.4)


def test_laplace_noise_has_its_scale(spark):
    got = spark.range(20000).select(noise.laplace(noise.fresh(3), 2.0).alias("x")).agg(F.avg("x"), F.avg(F.abs("x"))).first()
    assert abs(got[0]) < 0.1 and abs(got[1] - 2.0) < 0.1


def test_sizes():
    assert sizing.updates(Layout(("a", "b", "c"), ("x", "y", "z"), (2, 2, 2), 5)) == {"cat": 4, "num": 36, "region": 144}
    assert sizing.updates(Layout(("a", "b", "c"), ("x", "y", "z"), (2, 2, 2), 5, collapsed=True))["cat"] == 3
    assert sizing.reduced(5000, 0.1) == 1000


def test_layout_and_workload_round_trip():
    assert store.layout_from(store.layout_json(L)) == L
    assert store.workload_from('{"queries": [["*", ["r"], [1, 2], "*"]]}', L) == [{"b": ["r"], "x": (1, 2)}]


def test_random_queries_are_valid(spark):
    rows = spark.range(300).select(F.lit("p").alias("a"), F.when(F.col("id") % 2 == 0, "r").otherwise("s").alias("b"), F.col("id").alias("x"), (F.col("id") % 9).alias("y"))
    for q in workload.random_queries(rows, L, 20, 3, 0.5, 4):
        assert predicates.checked(q, L)


def test_stream_with_watermark(spark, sf, tmp_path):
    from cubetally.streaming.region_stream import windowed_counts

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = windowed_counts(stream, "ts", "1 day", "12 hours", ["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()

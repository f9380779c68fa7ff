"""Rules, joins, routes, terrain and streams on small fixtures; SQL of every query."""

import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from vistaframe.functions import geodesic, scores, tags
from vistaframe.operators import ordered, ranking, routes, scenes, spatial, terrain
from vistaframe.plans import catalogue
from vistaframe.sources import contexts
from vistaframe.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _cell(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return repr(float(x)) if isinstance(x, (int, float, np.integer, np.floating)) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF), duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted(tuple(map(_cell, r)) for r in rows)
    assert key(got.select(*names).collect()) == key(want.fetchall())


def test_contract_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(catalogue.queries()) > 150


def test_routes_have_no_cost_bound(spark, tmp_path):
    rows = [(1, 1, 5, 2, 50.0), (1, 2, 6, 3, 50.0), (1, 3, 9, 4, 70.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.end: (r.path, r.minutes) for r in catalogue.queries()["i03_route_back_trace"](spark, str(tmp_path)).collect()}
    assert got == {5: ("5", 0.0), 6: ("6,5", 0.7), 9: ("9,6,5", 1.5), 12: ("12,9,6,5", 2.5)}


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_access_policy_rows(spark):
    rows = [({"highway": "footway"}, "map_supported"), ({"highway": "footway", "access": "private"}, "excluded"), ({"highway": "path"}, "exploratory_only"), ({"highway": "path", "foot": "yes"}, "map_supported"), ({"highway": "footway", "bridge": "yes"}, "excluded"), ({"highway": "footway", "opening_hours": "Mo"}, "exploratory_only"), ({"highway": "primary"}, "excluded")]
    df = spark.createDataFrame(rows, "tags map<string,string>, want string")
    assert df.filter(tags.access_policy(F.col("tags"))["state"] != F.col("want")).count() == 0


def test_golden_scores(spark):
    """Weighted means of known criteria, with coverage."""
    rows = [(100.0, 92.0, 86.0, 85.0, 100.0), (50.0, 60.0, None, None, None), (None,) * 5]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    score, known = scores.renormalised(dict(zip(scores.WEIGHTS, map(F.col, "abcde"), strict=True)))
    got = df.select(score.alias("s"), known.alias("k")).collect()
    assert got[0].s == pytest.approx(92.95) and got[0].k == pytest.approx(1.0)
    assert got[1].s == pytest.approx(30 / 0.55) and got[2].s is None


def test_override_needs_evidence_and_range(spark):
    df = spark.createDataFrame([(50.0, 70.0), (None, 70.0), (50.0, None)], "v double, o double")
    assert [r[0] for r in df.select(ranking.overridden(F.col("v"), F.col("o"))).collect()] == [70.0, None, 50.0]
    with pytest.raises(Exception, match="between 0 and 100"):
        spark.createDataFrame([(50.0, 170.0)], "v double, o double").select(ranking.overridden(F.col("v"), F.col("o"))).collect()


@pytest.mark.parametrize(("hours", "arrive", "leave", "fits"), [([(540, 720), (720, 1080)], 700, 760, True), ([(1320, 120)], 30, 90, True), ([(0, 1440)], 1400, 1500, True), ([(540, 720)], 700, 760, False), ([], 700, 760, False), (None, 700, 760, None)])
def test_opening_hours(spark, hours, arrive, leave, fits):
    df = spark.createDataFrame([(hours,)], "hours array<struct<start:int,stop:int>>")
    assert df.select(ranking.hours_cover(F.col("hours"), F.lit(arrive), F.lit(leave))).first()[0] is fits


def test_routes_avoid_and_respect_one_way(spark):
    edges = spark.createDataFrame([(1, 1, 2, 10.0, None), (2, 2, 3, 10.0, None), (3, 1, 3, 60.0, None), (4, 3, 4, 5.0, "yes"), (5, 9, 1, 5.0, "-1")], "eid long, u long, v long, length double, oneway_foot string")
    start = spark.createDataFrame([(1, 0.0)], "node long, cost double")
    best = routes.shortest(routes.adjacency(edges), start)
    assert {r.node: r.cost for r in best.collect()} == {1: 0.0, 2: 10.0, 3: 20.0, 4: 25.0, 9: 5.0}
    path = routes.back_trace(best, spark.createDataFrame([(4,)], "node long"))
    assert [r.node for r in path.orderBy("at").collect()] == [4, 3, 2, 1]
    no_way = routes.shortest(routes.adjacency(edges), spark.createDataFrame([(4, 0.0)], "node long, cost double"))
    assert no_way.count() == 1


def test_spatial_joins_match_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-200, 200, (150, 2)))]
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(np.c_[rng.integers(-200, 200, (60, 2)), rng.integers(0, 90, (60, 2))])]
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    b = spark.createDataFrame(boxes, "sid long, minx double, miny double, maxx double, maxy double")
    got = {(r.pid, r.sid) for r in spatial.point_in_box(p, b, 40.0).collect()}
    assert got == {(i, s) for i, x, y in pts for s, a, c, d, e in boxes if a <= x <= d and c <= y <= e}
    pairs = spatial.box_overlap(b, b, 40.0).select("sid", "o_sid").collect()
    want = sorted((u[0], v[0]) for u in boxes for v in boxes if u[1] <= v[3] and v[1] <= u[3] and u[2] <= v[4] and v[2] <= u[4])
    assert sorted((r.sid, r.o_sid) for r in pairs) == want


def test_terrain_is_exact_on_a_plane_and_bounded():
    rng = np.random.default_rng(2)
    p = rng.random((300, 2)) * 100
    z = 0.01 * p[:, 0] + 0.02 * p[:, 1]
    q = rng.random((200, 2)) * 100
    got = terrain.interpolate(p, z, q, 75.0)
    ok = ~np.isnan(got)
    assert ok.mean() > 0.9 and np.abs(got[ok] - (0.01 * q[ok, 0] + 0.02 * q[ok, 1])).max() < 1e-9
    assert np.isnan(terrain.interpolate(np.array([[0, 0], [100, 0], [0, 100.0]]), np.zeros(3), np.array([[10.0, 10]]), 75.0)).all()


def test_delaunay_circles_are_empty():
    rng = np.random.default_rng(3)
    p = rng.random((60, 2))
    tri = terrain.delaunay(p)
    c, r2 = terrain._circles(p, tri)
    for k in range(len(tri)):
        d = ((p - c[k]) ** 2).sum(axis=1)
        d[tri[k]] = np.inf
        assert d.min() >= r2[k] * (1 - 1e-9)


def test_resampling_of_a_right_angle(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 5.0, 0.0), (1, 2, 5.0, 5.0)], "line long, n int, x double, y double")
    got = sorted((r.at, r.px, r.py) for r in ordered.resample(line, ["line"], "n", 3.0).collect())
    assert got == [(0.0, 0.0, 0.0), (3.0, 3.0, 0.0), (6.0, 5.0, 1.0), (9.0, 5.0, 4.0), (10.0, 5.0, 5.0)]


def test_geodesic_known_lengths():
    assert geodesic.inverse(np.array([127.0]), np.array([37.0]), np.array([127.0]), np.array([38.0]))[0] == pytest.approx(110_985.8, abs=20)
    assert geodesic.inverse(np.array([5.0]), np.array([5.0]), np.array([5.0]), np.array([5.0]))[0] == 0


def test_context_needs_its_version(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"schema_version": 2, "nodes": [{"id": "a"}], "edges": []}')
    with pytest.raises(Exception, match="schema_version"):
        contexts.read_context(spark, str(tmp_path / "c.json"))[0].collect()


def test_sinks_are_exclusive_and_audited(spark, tmp_path):
    df = spark.range(3)
    contexts.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        contexts.write_once(df, str(tmp_path / "out"))
    assert contexts.fingerprints(spark, str(tmp_path / "out")).filter("length(sha256) = 64").count() >= 1


def test_stream_joins_only_current_observations(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' ts, 1 k UNION ALL SELECT timestamp'2024-01-01 07:00:00', 1 UNION ALL SELECT timestamp'2024-01-01 12:30:00', 1").write.parquet(str(tmp_path / "e.parquet"))
    visits = spark.sql("SELECT 1 k, timestamp'2024-01-01 11:00:00' visit_at")
    out = windows.drained(windows.current_observations(windows.read_events(spark, str(tmp_path / "e.parquet")), visits, "k"), "append")
    assert out.count() == 1


def test_a_drained_stream_stays_out_of_the_driver(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' ts, 1 k UNION ALL SELECT timestamp'2024-01-01 10:30:00', 1 UNION ALL SELECT timestamp'2024-01-01 12:30:00', 1").write.parquet(str(tmp_path / "e.parquet"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    out = windows.drained(windows.sessions(windows.read_events(spark, str(tmp_path / "e.parquet")), "k"))
    assert sorted(r.views for r in out.collect()) == [1, 2]
    assert out.inputFiles()  # rows of the memory sink, which the driver holds, have no files
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_sliding_windows_from_steps(spark):
    """The rates of steps give the windows that one count per window over a call gave."""
    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, s) AS ts, k FROM VALUES (0, 1), (9, 1), (10, 1), (59, 1), (60, 1), (61, 2), (9, null) t(s, k)")
    got = windows.slid(windows.sliding_rate(rows, "k", "10 seconds", "10 seconds"), "k")
    want = windows.sliding_rate(rows, "k")
    assert got.count() == want.count() > 20 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_product_and_sum_are_rounded_once(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(3000, 3)) * 10.0 ** rng.integers(-6, 6, (3000, 3))]
    rows += [(a, b, -a * b) for a, b, _ in rows[:500]]
    exact = [float(Fraction(a) * Fraction(b) + Fraction(c)) for a, b, c in rows]
    got = spark.createDataFrame(rows, "a double, b double, c double").select(ordered.fused(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == exact and any(a * b + c != x for (a, b, c), x in zip(rows, exact, strict=True))


def test_quantiles_equal_duckdb(spark, duck):
    """Also where a tie of half a millionth depends on the last bit, on nulls and lone values."""
    rng = np.random.default_rng(7)
    rows = [(k, float(v) / 1000) for k in range(300) for v in np.round(rng.random(int(rng.integers(2, 60))) * 1e5, 2)]
    rows += [(1000, 1.5), (1001, None), (1002, None), (1002, 2.0), (1002, 3.0), (None, 4.0), (None, 9.0), (1003, float("inf")), (1003, 1.0), (1003, float("nan"))]
    df = spark.createDataFrame(rows, "k long, v double")
    got = ordered.quantiles(df, "k", "v", {"a": 0.5, "b": 0.95}).collect()
    duck.execute("CREATE OR REPLACE TEMP TABLE q AS SELECT unnest(?::STRUCT(k BIGINT, v DOUBLE)[], recursive := true)", [[{"k": k, "v": v} for k, v in rows]])
    want = duck.execute("SELECT k, count(*), quantile_cont(v, 0.5), quantile_cont(v, 0.95) FROM q GROUP BY k").fetchall()
    assert sorted(tuple(map(_cell, r)) for r in got) == sorted(tuple(map(_cell, r)) for r in want)


def test_latency_statistics_at_ties(spark, duck, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(f"{k}", 1, 1, 1, float(p)) for k in range(300) for p in np.round(rng.random(int(rng.integers(2, 60))) * 1e5, 2)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double").withColumn("l_quantity", F.lit(1.0)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    name = "a11_latency_statistics"
    sql = catalogue.oracle_sql()[name].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_a_place_meets_few_regions(spark, monkeypatch):
    """Copies of a place are looked up once, and once found not against regions of larger ids."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(spatial, "in_ring", lambda x, y, ring: F.udf(lambda a, b: seen.add(1) or True, "boolean")(x, ring))
    points = spark.range(500).select("id", (F.col("id") % 2 + 10.0).alias("x"), F.lit(10.0).alias("y"))
    regions = spark.range(100).select(F.col("id").alias("sid"), *[F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 50.0), ("maxy", 50.0))], F.array("id").alias("ring"))
    got = spatial.assign_smallest(points, regions, 100.0, "id", "sid").collect()
    assert len(got) == 500 and {r.sid for r in got} == {0} and seen.value <= 4 * spatial.FIRST_REGIONS


def test_a_place_is_looked_up_to_the_last_region(spark):
    v = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    small, large = (F.array(v(0.0, 0.0), v(w, 0.0), v(w, w), v(0.0, w)) for w in (1.0, 50.0))
    regions = spark.range(90).select(F.col("id").alias("sid"), *[F.lit(x).alias(n) for n, x in (("minx", 0.0), ("miny", 0.0), ("maxx", 50.0), ("maxy", 50.0))], F.when(F.col("id") >= 80, large).otherwise(small).alias("ring"))
    points = spark.createDataFrame([(1, 10.0, 10.0), (1, 0.5, 0.5), (2, 10.0, 10.0), (3, 70.0, 10.0), (4, None, 1.0), (None, 10.0, 10.0)], "id long, x double, y double")
    got = spatial.assign_smallest(points, regions, 100.0, "id", "sid").collect()
    assert sorted((r.id or 0, r.x or 0.0, -1 if r.sid is None else r.sid) for r in got) == [(0, 10.0, -1), (1, 0.5, 0), (1, 10.0, 0), (2, 10.0, 80), (3, 70.0, -1), (4, 0.0, -1)]


def test_equal_spots_are_compared_once(spark, monkeypatch):
    """All pairs come, of copies too, though the experiences are compared by what differs."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(ranking, "TOGETHER", 7)
    real = ranking.same_experience
    monkeypatch.setattr(ranking, "same_experience", lambda a, b: F.udf(lambda p, q: seen.add(1) or True, "boolean")(a["lon"], b["lon"]) & real(a, b))
    rows = [(i, 126.97 + (i % 3) * 0.0005, 37.57, float(i % 2 * 15 + 350) % 360, 1, 2) for i in range(60)] + [(7, 126.97, 37.57, 5.0, 1, 2), (None, 126.97, 37.57, 5.0, 1, 2), (90, 126.97, 37.57, None, 1, 2)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, bearing double, target int, look int").withColumn("targets", F.array(F.lit("t"))).withColumn("signature", F.lit("s"))
    got = sorted(map(tuple, ranking.same_pairs(df, ["target", "look"]).collect()))
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, F.col("a.id") < F.col("b.id")).filter(real(F.struct("b.*"), F.struct("a.*"))).select("a.id", "b.id")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 800
    assert seen.value < len(got) / 2


def test_scene_needs_two_places(spark):
    rows = [(1, 0.0, 0.0, 7, "city", 1, 1, 10.0, 1), (1, 0.0, 0.0, 8, "city", 1, 2, 12.0, 1), (2, 0.0, 0.0, 7, "city", 1, 1, 10.0, 1), (2, 0.0, 0.0, 7, "city", 1, 1, 11.0, 1)]
    df = spark.createDataFrame(rows, "spot long, x double, y double, target long, category string, px long, py long, bearing double, state int")
    got = scenes.sectors(df).collect()
    assert [r.spot for r in got] == [1] and "skyline" in got[0].categories

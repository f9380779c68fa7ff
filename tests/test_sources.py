"""Sources, packages, inventories and audits on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from vistaframe.functions import datum
from vistaframe.operators import audit, inventory, ordered, ranking, routes, spatial, terrain
from vistaframe.sources import contexts, layers, osm, packages


def _map(spark):
    tags = lambda **k: {key.replace("__", ":"): v for key, v in k.items()}
    nodes = spark.createDataFrame([(i, 127.0 + 0.001 * (i % 5), 37.5 + 0.001 * (i // 5), tags(natural="peak") if i == 24 else {}) for i in range(25)], "node long, lon double, lat double, tags map<string,string>")
    ways = [
        (1, tags(highway="footway"), [0, 1, 2, 0]),  # a closed path stays a line
        (2, tags(highway="footway", area="yes"), [0, 1, 6, 0]),  # unless it is an area
        (3, tags(natural="water"), [5, 6, 11, 5]),
        (4, tags(natural="water"), [5, 6, 99]),  # a node is missing
        (5, tags(natural="water"), [7, 8, 7]),  # closed, but no ring
        (6, tags(power="line"), [1, 2]),  # no layer
        (7, {}, [10, 11, 12]),
        (8, {}, [12, 17, 10]),
        (9, {}, [16, 17]),
    ]
    relations = [(1, tags(type="multipolygon", landuse="forest")), (2, tags(type="multipolygon", natural="water")), (3, tags(type="route", natural="water"))]
    members = [(1, 7, "outer"), (1, 8, "outer"), (1, 3, "inner"), (2, 7, "outer"), (2, 9, "outer"), (3, 3, "outer")]
    return (
        nodes,
        spark.createDataFrame([(w, t) for w, t, _ in ways], "way long, tags map<string,string>"),
        spark.createDataFrame([(w, i, n) for w, _, ns in ways for i, n in enumerate(ns)], "way long, pos int, node long"),
        spark.createDataFrame(relations, "rel long, tags map<string,string>"),
        spark.createDataFrame(members, "rel long, way long, role string"),
    )


def test_map_features(spark):
    got = {(r.layer, r.source_id): (r.kind, r.points) for r in osm.features(*_map(spark)).collect()}
    assert got[("paths", "way/1")] == ("line", 4) and ("paths", "way/2") not in got and got[("public_spaces", "way/2")] == ("area", 4)
    assert got[("water", "way/3")] == ("area", 4)
    assert got[("quality", "way/4")][0] == got[("quality", "way/5")][0] == got[("quality", "relation/2")][0] == "issue"
    assert got[("green_space", "relation/1")] == ("area", 10) and ("peaks_ridges", "node/24") in got and ("landmarks", "node/24") in got
    assert not any(s in ("way/6", "relation/3") for _, s in got)
    nodes, _, way_nodes, relations, members = _map(spark)
    built = osm.relation_shapes(relations, members, osm.lines(nodes, way_nodes))
    assert tuple(osm.relation_report(relations, built).first()) == (2, 1, False)
    one = built.filter("rel = 1").first()
    assert (one.outer, one.inner) == (1, 1)


def test_rings_chain_whatever_their_direction():
    assert osm.chained([(1, 2), (3, 2), (3, 1)]) == [[0, 1, 2]]
    assert osm.chained([(4, 4), (1, 2), (2, 1)]) == [[0], [1, 2]]
    assert osm.chained([(1, 2), (2, 3)]) is None and osm.chained([(1, 2)] * 3) is None


def test_change_of_grid(spark):
    """There and back again to a millimetre, and a shift of the known size."""
    p = spark.createDataFrame([(200_000.0, 500_000.0), (183_000.0, 541_000.0), (215_432.1, 455_123.4)], "x double, y double")
    back = tuple(-v for v in datum.HELMERT)
    there = p.select("x", "y", datum.regridded(F.col("x"), F.col("y")).alias("q")).select("x", "y", "q", datum.regridded(F.col("q.x"), F.col("q.y"), datum.KOREA_2000, datum.KATECH_MODIFIED, back).alias("b"))
    for r in there.collect():
        assert math.hypot(r.x - r.b.x, r.y - r.b.y) < 0.05  # the inverse of small rotations is not exact
        assert 99_000 < r.q.y - r.y < 101_000 and abs(r.q.x - r.x) < 500
    one = F.struct(F.lit(127.3).alias("lon"), F.lit(37.2).alias("lat"))
    q = spark.range(1).select(datum.inverse(datum.forward(one, datum.KOREA_2000), datum.KOREA_2000).alias("q")).first().q
    assert q.lon == pytest.approx(127.3, abs=1e-9) and q.lat == pytest.approx(37.2, abs=1e-9)
    from vistaframe.functions import geo

    x, y = geo.to_plane(F.lit(127.3), F.lit(37.2))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), datum.forward(one, datum.KOREA_2000).alias("f")).first()
    assert r.x == pytest.approx(r.f.x, abs=1e-4) and r.y == pytest.approx(r.f.y, abs=1e-4)


def test_terrain_is_held_to_its_declaration(spark):
    rows = spark.createDataFrame([(1, 10.0, 200_000.0, 500_000.0), (2, 20.0, 200_010.0, 500_000.0)], "UFID long, CONT double, x double, y double")
    assert layers.terrain(rows, "EPSG:5174", "CONT", 2).count() == 2
    for crs, field, count in (("EPSG:4326", "CONT", 2), ("EPSG:5174", "NUME", 2), ("EPSG:5174", "CONT", 3)):
        with pytest.raises(ValueError):
            layers.terrain(rows, crs, field, count)
    holes = rows.withColumn("CONT", F.when(F.col("UFID") == 1, F.lit(float("nan"))).otherwise(F.col("CONT")))
    with pytest.raises(Exception, match="lacks its id"):
        layers.terrain(holes, "EPSG:5174", "CONT", 2).collect()


def test_row_groups_need_statistics(spark, tmp_path):
    rows = spark.range(1000).select("id", F.col("id").cast("double").alias("x"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/a")
    got, met, every = layers.pruned(spark, f"{tmp_path}/a", {"x": (10.0, 19.0)})
    assert got.count() == 10 and met == every == 1
    assert layers.pruned(spark, f"{tmp_path}/a", {"x": (5000.0, 6000.0)})[1] == 0
    rows.withColumn("x", F.when(F.col("id") != 5, F.col("x"))).coalesce(1).write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="statistics"):
        layers.pruned(spark, f"{tmp_path}/b", {"x": (10.0, 19.0)})


def test_footprints_refuse_what_breaks_the_contract(spark):
    ring = [(127.0, 37.5), (127.001, 37.5), (127.001, 37.501), (127.0, 37.5)]
    kind = "source_id long, ring array<struct<x:double,y:double>>, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, height double, var double"
    rows = spark.createDataFrame([(1, ring, (127.0, 37.5, 127.001, 37.501), 12.0, 1.0), (2, ring, (127.0, 37.5, 127.001, 37.501), float("nan"), None)], kind)
    got = {r.source_id: r for r in layers.footprints(rows, (126.0, 37.0, 128.0, 38.0)).collect()}
    assert got[1].height_m == 12.0 and not got[1].unresolved and got[2].unresolved and len(got[1].plane) == 4
    assert layers.footprints(rows, (126.0, 37.0, 126.5, 38.0)).count() == 0
    off = spark.createDataFrame([(3, ring, (127.0, 37.5, 127.002, 37.501), 12.0, 1.0)], kind)
    with pytest.raises(Exception, match="building 3: box"):
        layers.footprints(off, (126.0, 37.0, 128.0, 38.0)).collect()


def test_packages_refuse_and_validate(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two"))], "name string, body binary")
    receipts = packages.manifest(files).select("name", F.col("sha256").alias("receipt"))
    path = packages.publish(files, receipts, "v1", f"file://{tmp_path}")
    assert packages.validated(spark, path).count() == 0
    with pytest.raises(Exception, match="exists|EXISTS"):
        packages.publish(files, receipts, "v1", f"file://{tmp_path}")
    with pytest.raises(ValueError, match="b: checksum mismatch"):
        packages.publish(files, receipts.withColumn("receipt", F.when(F.col("name") == "b", "x").otherwise(F.col("receipt"))), "v1", f"file://{tmp_path}")
    with pytest.raises(ValueError, match="a: no receipt"):
        packages.publish(files, receipts.filter("name = 'b'"), "v1", f"file://{tmp_path}")
    files.filter("name = 'a'").write.mode("overwrite").parquet(f"{path}/artifacts")
    assert [tuple(r) for r in packages.validated(spark, path).collect()] == [("b", "missing")]


def test_sidecars_change_the_fingerprint(spark, tmp_path):
    for name, body in (("a.shp", "1"), ("a.dbf", "2"), ("b.tif", "3")):
        (tmp_path / name).write_text(body)
    one = {r.stem.rsplit("/", 1)[-1]: r for r in layers.sidecars(contexts.fingerprints(spark, str(tmp_path))).collect()}
    assert (one["a"].files, one["b"].files) == (2, 1)
    (tmp_path / "a.dbf").write_text("4")
    two = {r.stem.rsplit("/", 1)[-1]: r for r in layers.sidecars(contexts.fingerprints(spark, str(tmp_path))).collect()}
    assert one["a"].sha256 != two["a"].sha256 and one["b"].sha256 == two["b"].sha256


def test_places_take_the_text_as_it_is(spark):
    rows = [spark.createDataFrame([(1, "100% park"), (2, "100 park")], "id long, name string"), spark.createDataFrame([(1, "100% park"), (7, "A_b")], "id long, name string")]
    assert [(r.name, r.layer) for r in inventory.places(rows, " 100% ").collect()] == [("100% park", 0)]
    assert [r.name for r in inventory.places(rows, "a_B").collect()] == ["A_b"] and inventory.places(rows, "  ").count() == 0


def test_nearest_box_of_all(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 0.0), (3, 10.0, 10.0)], "pid long, x double, y double")
    boxes = spark.createDataFrame([(1, 8.0, 8.0, 12.0, 12.0), (2, 20.0, 0.0, 30.0, 5.0)], "sid long, minx double, miny double, maxx double, maxy double")
    got = {r.pid: (r.sid, round(r.metres, 6)) for r in spatial.nearest_box(points, boxes, 5.0, "pid", "sid").collect()}
    assert got == {1: (1, round(math.hypot(8, 8), 6)), 2: (2, 4970.0), 3: (1, 0.0)}
    assert spatial.nearest_box(points, boxes.limit(0), 5.0, "pid", "sid").count() == 0
    with pytest.raises(ValueError):
        spatial.bounded_product(points, boxes, 1)


def test_seams_show_what_differs(spark):
    plane = [(t, float(x), float(y), 0.1 * x + (0.0 if t == 0 else 0.25)) for t in (0, 1) for x in range(0, 101, 10) for y in range(0, 101, 10)]
    points = spark.createDataFrame(plane, "tile long, x double, y double, z double")
    seams = spark.createDataFrame([(0, 1, i, 50.0, 10.0 * i + 3) for i in range(9)] + [(0, 1, 9, 50.0, 500.0)], "one long, other long, probe long, x double, y double")
    r = terrain.seam_gaps(points, seams, "tile", 30.0).first()
    assert (r.probes, r.supported) == (10, 9) and r.gap == pytest.approx(0.25)


def test_routes_of_any_length(spark):
    arcs = spark.createDataFrame([(i, i + 1, i, 1.0) for i in range(70)] + [(0, 2, 900, 2.0)], "u long, v long, eid long, length double")
    start = spark.createDataFrame([(0, 0.0)], "node long, cost double")
    best = routes.shortest(arcs, start)
    # of two ways of equal length the one by the smaller parent
    assert best.filter("node = 2").first().parent == 0
    path = routes.back_trace(best, spark.createDataFrame([(70,), (0,)], "node long")).collect()
    mine = sorted((r.at, r.node) for r in path if r.end == 70)
    assert mine == [(i, 70 - i) for i in range(69)] + [(69, 0)] and [r.node for r in path if r.end == 0] == [0]


def test_representatives_are_those_of_one_fold(spark):
    import random

    rng = random.Random(4)
    rows = [(i, 127.0 + rng.random() / 500, 37.5, float(rng.randrange(360)), [rng.randrange(2)] if rng.random() < 0.8 else [], rng.choice(["a", "b", ""]), float(rng.randrange(5))) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, lon double, lat double, bearing double, targets array<int>, signature string, score double")
    row = F.struct("id", "lon", "lat", "bearing", "targets", "signature")
    order = [-F.col("score"), F.col("id")]
    one = ranking.greedy(frame.withColumn("one", F.lit(1)), ["one"], row, F.struct(order[0].alias("a"), order[1].alias("b")), ranking.same_experience)
    two = ranking.representatives(frame, row, order, ["targets", "signature"])
    assert [r.id for r in one.orderBy("place").collect()] == [r.id for r in two.orderBy("place").collect()]
    top = ranking.greedy_top(frame, row, F.struct(order[0].alias("a"), order[1].alias("b")), ranking.same_experience, 5)
    assert [r.id for r in top.orderBy("place").collect()] == [r.id for r in one.orderBy("place").limit(5).collect()]


def test_ranks_over_ranges(spark):
    rows = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v"))
    got = ordered.ranked(rows, [F.col("v").desc(), F.col("id")], ranges=7).collect()
    want = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r.place for r in want] == list(range(1, 501))


def test_nearest_in_time_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    left = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 7919 % 10_000).alias("at"))
    right = spark.range(30).select(F.col("id").alias("e"), (F.col("id") * 3607 % 10_000).alias("when"))
    got = {r.k: (r.e, r.gap) for r in spatial.nearest_in_time(left, right, 300, "k", "at", "when", "e").collect()}
    given = [(i * 3607 % 10_000, i) for i in range(30)]
    want = {}
    for k in range(200):
        gap, t, e = min((abs(t - (k * 7919 % 10_000)), t, e) for t, e in given)
        if gap <= 300:
            want[k] = (e, gap)
    assert got == want


def test_audits_find_differences(spark):
    source = spark.createDataFrame([(i, float(i), "s") for i in range(100)], "id long, h double, source string")
    stored = source.filter("id <> 7").withColumn("h", F.when(F.col("id") == 9, None).otherwise(F.col("h")))
    found = {r.id: r.problem for r in audit.sampled_mismatches(source, stored, "id", ["h", "source"], 100).collect() if r.problem}
    assert found == {7: "missing", 9: "changed"}
    assert audit.sampled_mismatches(source, source, "id", ["h"], 10).filter("problem IS NOT NULL").count() == 0

"""Analytical sight-line cases, seeded differential and metamorphic tests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.functions.geo import EARTH_DIAMETER_M
from vistaframe.functions.udtf import TraversedCells
from vistaframe.operators import sight
from vistaframe.sources import grids


def plain_state(surface, ray, res, k):
    """An independent evaluator: 3 unknown, 0 blocked, 1 visible, and the least clearance."""
    c0, r0, z0, c1, r1, z1 = ray
    q = k * (math.hypot(c1 - c0, r1 - r0) * res) ** 2 / EARTH_DIAMETER_M
    least, unknown = math.inf, False
    for row, col, a, b in TraversedCells().eval(c0, r0, c1, r1):
        s = surface.get((row, col))
        if s is None:
            unknown = True
            continue
        at = [a, b]
        if q > 0 and a < (turn := (q - (z1 - z0)) / (2 * q)) < b:
            at.append(turn)
        least = min(least, *(z0 + t * (z1 - z0) - s - q * t * (1 - t) for t in at))
    return 3 if unknown else 0 if least < -1e-6 else 1


def states(spark, surface, rays, res=1.0, k=6 / 7):
    cells = spark.createDataFrame([(r, c, s) for (r, c), s in surface.items()], "row int, col int, surface double")
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rays)], "ray_id long, c0 double, r0 double, z0 double, c1 double, r1 double, z1 double")
    return {r.ray_id: r.state for r in sight.sight_lines(frame, cells, res, ["ray_id"], 10_000, k).collect()}


def flat(n, wall=None, height=0.0):
    return {(r, c): height if c == wall else 0.0 for r in range(n) for c in range(n)}


def test_walls_and_contact(spark):
    ray = (0.5, 3.5, 1.7, 6.5, 3.5, 1.7)
    assert states(spark, flat(7), [ray], k=0)[0] == 1
    assert states(spark, flat(7, 3, 8.0), [ray], k=0)[0] == 0
    assert states(spark, flat(7, 3, 1.7), [ray], k=0)[0] == 1
    assert states(spark, flat(7, 3, 1.7 + 0.5e-6), [ray], k=0)[0] == 1
    assert states(spark, flat(7, 3, 1.7 + 2e-6), [ray], k=0)[0] == 0


def test_sloping_ray_uses_the_whole_column(spark):
    assert states(spark, flat(7, 6, 2.2), [(0.5, 3.5, 4.0, 6.5, 3.5, 2.0)], k=0)[0] == 0


def test_corner_column_blocks_and_unknown_dominates(spark):
    g = flat(5)
    g[1, 2] = 9.0
    ray = (0.5, 0.5, 1.0, 3.5, 3.5, 1.0)
    assert states(spark, g, [ray], k=0)[0] == 0  # touched at its corner (2, 2)
    g[2, 1] = None
    assert states(spark, g, [ray], k=0)[0] == 3
    del g[2, 1]
    assert states(spark, g, [ray], k=0)[0] == 3


def test_ray_along_an_edge_meets_both_sides(spark):
    g = flat(5)
    g[1, 2] = 5.0
    assert states(spark, g, [(0.5, 2.0, 1.0, 4.5, 2.0, 1.0), (0.5, 2.5, 1.0, 4.5, 2.5, 1.0)], k=0) == {0: 0, 1: 1}


def test_curvature_inside_one_cell(spark):
    one = {(0, 0): 0.0}
    ray = (0.1, 0.5, 100.0, 0.9, 0.5, 100.0)
    assert [states(spark, one, [ray], 120_000.0, k)[0] for k in (0, 6 / 7, 1)] == [1, 0, 0]


def test_random_rays_match_and_are_reciprocal(spark):
    rng = np.random.default_rng(12)
    surface = {(r, c): float(rng.integers(0, 12)) for r in range(20) for c in range(20) if rng.random() > 0.01}
    ends = [rng.choice([0.5, 1.0, 3.25, 7.5, 10.0, 12.75, 18.5, 19.0], 4) for _ in range(120)]
    rays = [(a, b, float(rng.integers(4, 16)), c, d, float(rng.integers(4, 16))) for a, b, c, d in ends if (a, b) != (c, d)]
    back = [(r[3], r[4], r[5], r[0], r[1], r[2]) for r in rays]
    got = states(spark, surface, rays + back, 200.0)
    for i, ray in enumerate(rays):
        assert got[i] == plain_state(surface, ray, 200.0, 6 / 7)
        assert got[i] == got[i + len(rays)]


@pytest.fixture(scope="module")
def open_ground(spark):
    base = spark.range(81 * 81).select(F.floor(F.col("id") / 81).cast("int").alias("row"), (F.col("id") % 81).cast("int").alias("col"))
    return base.select("*", F.lit(0.0).alias("dtm"), F.lit(0.0).alias("surface"), F.lit(0).alias("occupancy"), F.lit(3).alias("quality"), F.lit(1).alias("out_mask"))


def target(spark, z=20.0):
    return spark.range(1).select(F.lit(1).alias("target_id"), F.lit(40).alias("trow"), F.lit(40).alias("tcol"), F.lit(z).alias("tz"))


def counts(df):
    return {r.state: r["count"] for r in df.groupBy("state").count().collect()}


def test_flat_disk_has_317_visible_cells(spark, open_ground):
    got = counts(sight.viewshed(open_ground, target(spark), 50.0, 5.0, rows=6561))
    assert got[1] == 317 and 0 not in got


def test_wall_hides_what_is_behind_and_masks_do_not(spark, open_ground):
    wall = F.col("col") == 45
    walled = open_ground.withColumn("surface", F.when(wall, 30.0).otherwise(0.0)).withColumn("occupancy", wall.cast("int"))
    shown = sight.viewshed(walled, target(spark, 1.7), 150.0, 5.0, rows=6561)
    assert shown.filter("row = 40 AND col = 60").first().state == 0 and shown.filter("row = 40 AND col = 30").first().state == 1
    masked = walled.withColumn("out_mask", F.when(wall, 0).otherwise(1))
    both = sight.viewshed(masked, target(spark, 1.7), 150.0, 5.0, rows=6561).filter("row = 40 AND col = 60").first()
    assert both.state == 0


def test_unknown_cell_is_unknown_and_spreads_along_rays(spark, open_ground):
    hole = (F.col("row") == 40) & (F.col("col") == 44)
    got = sight.viewshed(open_ground.withColumn("surface", F.when(~hole, F.col("surface"))), target(spark), 50.0, 5.0, rows=6561)
    assert got.filter("row = 40 AND col = 44").first().state == 3 and got.filter("row = 40 AND col = 48").first().state == 3


@pytest.mark.parametrize("curvature", [0.0, 6 / 7])
@pytest.mark.parametrize("whole", [64, 5])
def test_octants_and_curvature_equal_the_relational_form(spark, monkeypatch, whole, curvature):
    """The same states whether a window is one group or eight, with and without curvature."""
    from vistaframe.operators import block_view

    monkeypatch.setattr(block_view, "WHOLE", whole)
    cells = grids.synthetic(spark)
    targets = spark.createDataFrame([(1, 30, 33, 40.0), (2, 5, 60, 25.0)], "target_id long, trow int, tcol int, tz double")
    one = sight.viewshed(cells, targets, 140.0, 5.0, rows=4096, curvature=curvature)
    two = block_view.viewshed(cells, targets, 140.0, 5.0, curvature=curvature)
    assert one.count() == two.count() and one.exceptAll(two).count() == 0
    three = block_view.viewshed_counts(block_view.tiled(cells, 16), targets, 140.0, 5.0, curvature=curvature, tiles=16)
    want = {(r.target_id, r.state): r["count"] for r in one.groupBy("target_id", "state").count().collect()}
    for r in three.collect():
        assert [r.blocked, r.visible, r.excluded, r.unknown] == [want.get((r.target_id, s), 0) for s in range(4)]


def test_curvature_hides_far_ground_only_if_asked(spark):
    """Flat ground over the former switch of sizes: all visible without curvature."""
    from vistaframe.operators import block_view

    flat = grids.synthetic(spark, 161).select("row", "col", F.lit(0.0).alias("dtm"), F.lit(0.0).alias("surface"), F.lit(0).alias("occupancy"), F.lit(3).alias("quality"), F.lit(1).alias("out_mask"))
    one = spark.createDataFrame([(1, 80, 80, 0.0)], "target_id long, trow int, tcol int, tz double")
    for radius in (300.0, 390.0):
        got = block_view.viewshed_counts(flat, one, radius, 5.0, eye=0.0, curvature=0.0).first()
        assert got.blocked == 0 and got.visible > 10_000
        assert block_view.viewshed_counts(flat, one, radius, 5.0, eye=0.0, curvature=300.0).first().blocked > 2000


@pytest.mark.parametrize("radius", [12.0, 60.0, 150.0])
def test_block_kernel_equals_the_relational_form(spark, radius):
    from vistaframe.operators import block_view

    cells = grids.synthetic(spark)
    targets = spark.range(5).select(F.col("id").alias("target_id"), (10 + F.col("id") * 11).cast("int").alias("trow"), (50 - F.col("id") * 9).cast("int").alias("tcol"), (30.0 + F.col("id") * 6).alias("tz"))
    one = sight.viewshed(cells, targets, radius, 5.0, rows=4096)
    two = block_view.viewshed(cells, targets, radius, 5.0, rows=4096)
    assert one.count() == two.count() and one.exceptAll(two).count() == 0


def test_partitioning_does_not_matter(spark, open_ground):
    one = sight.viewshed(open_ground, target(spark), 40.0, 5.0, rows=6561)
    two = sight.viewshed(open_ground.repartition(7), target(spark), 40.0, 5.0)
    assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count()


def test_projection_of_a_known_point(spark):
    from vistaframe.functions import geo

    x, y = geo.to_plane(F.lit(127.0), F.lit(38.0))
    assert spark.range(1).select(x.alias("x"), y.alias("y")).first() == (200_000.0, pytest.approx(600_000.0, abs=1e-6))


def test_udtf_agrees_with_the_operator(spark):
    from vistaframe.functions import udtf

    udtf.register(spark)
    rays = spark.createDataFrame([(0, 0.5, 0.5, 1.0, 6.25, 3.0, 1.0)], "ray_id long, c0 double, r0 double, z0 double, c1 double, r1 double, z1 double")
    cells = sight.touch_cells(rays).select("row", "col", "enter_t", "leave_t")
    table = spark.sql("SELECT * FROM traversed_cells(0.5D, 0.5D, 6.25D, 3.0D)")
    assert cells.exceptAll(table).count() == 0 == table.exceptAll(cells).count()


def test_guards(spark):
    g = grids.synthetic(spark)
    assert g.filter(grids.contract_violated()).count() == 0
    assert g.filter(~grids.cell_valid()).count() == 6

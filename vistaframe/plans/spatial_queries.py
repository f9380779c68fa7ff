"""Joins by place, time and key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..sources import grids
from .base import frame, micro, micro_sql, query

POINTS = "SELECT CAST(c_custkey AS BIGINT) AS pid, CAST(c_custkey * 137 % 2000 AS DOUBLE) + 0.25e0 AS x, CAST(c_custkey * 211 % 2000 AS DOUBLE) + 0.5e0 AS y FROM {customer}"
BOXES = "SELECT CAST(s_suppkey AS BIGINT) AS sid, CAST(s_suppkey * 173 % 1900 AS DOUBLE) AS minx, CAST(s_suppkey * 97 % 1900 AS DOUBLE) AS miny, CAST(s_suppkey * 173 % 1900 + 60 + s_suppkey % 90 AS DOUBLE) AS maxx, CAST(s_suppkey * 97 % 1900 + 50 + s_suppkey % 70 AS DOUBLE) AS maxy FROM {supplier}"
OTHER = "SELECT CAST(s_suppkey AS BIGINT) AS sid, CAST(s_suppkey * 173 % 1900 + s_suppkey % 9 AS DOUBLE) AS minx, CAST(s_suppkey * 97 % 1900 + s_suppkey % 25 AS DOUBLE) AS miny, CAST(s_suppkey * 173 % 1900 + 60 + s_suppkey % 90 AS DOUBLE) AS maxx, CAST(s_suppkey * 97 % 1900 + 50 + s_suppkey % 70 AS DOUBLE) AS maxy FROM {supplier}"
INSIDE = "x >= minx AND x <= maxx AND y >= miny AND y <= maxy"
MEET = "a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"
CELL = 100.0


def P(spark, d):  # noqa: N802
    return frame(spark, d, POINTS)


def B(spark, d):  # noqa: N802
    return frame(spark, d, BOXES)


@query("j01_box_range_join", f"SELECT pid, sid FROM ({POINTS}) p JOIN ({BOXES}) b ON {INSIDE}")
def j01(spark, d):
    return spatial.point_in_box(P(spark, d), B(spark, d), CELL).select("pid", "sid")


@query("j02_halo_points_with_cap", f"SELECT sid, pid, n > 12 AS over_cap FROM (SELECT sid, pid, row_number() OVER (PARTITION BY sid ORDER BY pid) AS r, count(*) OVER (PARTITION BY sid) AS n FROM ({POINTS}) p JOIN ({BOXES}) b ON x >= minx - 50 AND x <= maxx + 50 AND y >= miny - 50 AND y <= maxy + 50) WHERE r <= 5")
def j02(spark, d):
    from pyspark.sql import Window

    grown = B(spark, d).select("sid", (F.col("minx") - 50).alias("minx"), (F.col("miny") - 50).alias("miny"), (F.col("maxx") + 50).alias("maxx"), (F.col("maxy") + 50).alias("maxy"))
    got = spatial.point_in_box(P(spark, d), grown, CELL)
    w = Window.partitionBy("sid")
    return got.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("pid"))).filter("r <= 5").select("sid", "pid", (F.col("n") > 12).alias("over_cap"))


@query("j04_box_overlap", f"SELECT a.sid AS left_id, b.sid AS right_id FROM ({BOXES}) a JOIN ({OTHER}) b ON {MEET}")
def j04(spark, d):
    return spatial.box_overlap(B(spark, d), frame(spark, d, OTHER), CELL).select(F.col("sid").alias("left_id"), F.col("o_sid").alias("right_id"))


_V = [("minx", "miny"), ("maxx", "miny + 10"), ("maxx - 20", "maxy"), ("minx + 10", "maxy - 5")]
CROSS = " + ".join(
    f"CASE WHEN (({a[1]}) > y) <> (({b[1]}) > y) AND x < (({b[0]}) - ({a[0]})) * (y - ({a[1]})) / nullif(({b[1]}) - ({a[1]}), 0) + ({a[0]}) THEN 1 ELSE 0 END"
    for a, b in zip(_V, _V[1:] + _V[:1], strict=True)
)


def regions(spark, d):
    c = F.col
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return B(spark, d).withColumn("ring", F.array(v(c("minx"), c("miny")), v(c("maxx"), c("miny") + 10), v(c("maxx") - 20, c("maxy")), v(c("minx") + 10, c("maxy") - 5)))


@query("j05_point_in_polygon_smallest", f"SELECT p.pid, q.sid AS region FROM ({POINTS}) p LEFT JOIN (SELECT pid, min(sid) AS sid FROM ({POINTS}) JOIN ({BOXES}) ON {INSIDE} WHERE ({CROSS}) % 2 = 1 GROUP BY pid) q USING (pid)")
def j05(spark, d):
    return spatial.assign_smallest(P(spark, d), regions(spark, d), CELL, "pid", "sid").select("pid", F.col("sid").alias("region"))


AREA = "(least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny))"


@query("j06_best_iou_match", f"SELECT sid, arg_max(other, iou) AS match, {micro_sql('max(iou)')} AS iou_micro FROM (SELECT a.sid, b.sid AS other, {AREA} / ((a.maxx - a.minx) * (a.maxy - a.miny) + (b.maxx - b.minx) * (b.maxy - b.miny) - {AREA}) AS iou FROM ({BOXES}) a JOIN ({OTHER}) b ON {MEET}) WHERE iou >= 0.5 GROUP BY sid")
def j06(spark, d):
    pairs = spatial.box_overlap(B(spark, d), frame(spark, d, OTHER), CELL).withColumn("iou", spatial.iou()).filter("iou >= 0.5")
    return pairs.groupBy("sid").agg(F.max_by("o_sid", "iou").alias("match"), micro(F.max("iou")).alias("iou_micro"))


@query("j07_nodes_to_cells", f"WITH {grids.SYNTHETIC_SQL} SELECT pid, occupancy FROM ({POINTS}) p JOIN grid g ON g.row = CAST(floor((2000 - y) / 31.25) AS INTEGER) AND g.col = CAST(floor(x / 31.25) AS INTEGER)")
def j07(spark, d):
    row, col = grids.cell_of(F.col("x"), F.col("y"), 0.0, 2000.0, 31.25)
    return P(spark, d).withColumn("row", row).withColumn("col", col).join(grids.synthetic(spark), ["row", "col"]).select("pid", "occupancy")


ASKED = "SELECT o_orderkey AS oid, o_orderkey * 7919 % 2000000 AS vt FROM {orders}"
GIVEN = "SELECT event_id AS eid, event_id * 3607 % 2000000 AS et FROM {events}"


@query("j08_nearest_in_time", f"SELECT oid, eid, gap FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY gap, et, eid) AS r FROM (SELECT oid, eid, et, abs(vt - et) AS gap FROM ({ASKED}) JOIN ({GIVEN}) ON abs(vt - et) <= 3600)) WHERE r = 1")
def j08(spark, d):
    return spatial.nearest_in_time(frame(spark, d, ASKED), frame(spark, d, GIVEN), 3600, "oid", "vt", "et", "eid")


@query("j09_nearest_node", f"SELECT pid, sid, {micro_sql('metres')} AS metres_micro FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY metres, sid) AS r FROM (SELECT pid, sid, sqrt(pow(x - minx, 2) + pow(y - miny, 2)) AS metres FROM ({POINTS}) JOIN ({BOXES}) ON abs(x - minx) <= 80 AND abs(y - miny) <= 80) WHERE metres <= 80) WHERE r = 1")
def j09(spark, d):
    nodes = B(spark, d).select("sid", F.col("minx").alias("x"), F.col("miny").alias("y"))
    return spatial.nearest(P(spark, d), nodes, 80.0, "pid", "sid").select("pid", "sid", micro(F.col("metres")).alias("metres_micro"))


@query("j10_dictionary_names", "SELECT s_suppkey AS id, n_name AS name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey")
def j10(spark, d):
    return frame(spark, d, "SELECT s_suppkey AS id, n_name AS name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey")


EDGES = "SELECT l_orderkey * 10 + l_linenumber AS eid, l_partkey AS u, l_suppkey * 17 AS v, l_quantity AS length FROM {lineitem}"
NODES = "SELECT CAST(c_custkey AS BIGINT) AS node FROM {customer}"


@query("j11_dangling_edges_dropped", f"SELECT eid FROM ({EDGES}) JOIN ({NODES}) a ON a.node = u JOIN ({NODES}) b ON b.node = v")
def j11(spark, d):
    e, n = frame(spark, d, EDGES), frame(spark, d, NODES)
    return e.join(n.withColumnRenamed("node", "u"), "u").join(n.withColumnRenamed("node", "v"), "v").select("eid")


@query("j12_excluded_sources", f"SELECT pid FROM ({POINTS}) WHERE pid NOT IN (SELECT CAST(s_suppkey AS BIGINT) FROM {{supplier}})")
def j12(spark, d):
    gone = frame(spark, d, "SELECT CAST(s_suppkey AS BIGINT) AS pid FROM {supplier}")
    return P(spark, d).join(gone, "pid", "left_anti").select("pid")


@query("j13_covered_points", f"SELECT pid FROM ({POINTS}) WHERE EXISTS (SELECT 1 FROM ({BOXES}) WHERE {INSIDE})")
def j13(spark, d):
    return spatial.point_in_box(P(spark, d), B(spark, d), CELL, "left_semi").select("pid")


COINCIDENT = "SELECT CAST(c_custkey AS BIGINT) AS pid, CAST(c_custkey % 50 AS DOUBLE) AS x, CAST(c_custkey % 40 AS DOUBLE) AS y, c_custkey % 97 = 0 AS restricted FROM {customer}"


@query("j14_coincident_veto", f"WITH c AS ({COINCIDENT}) SELECT pid FROM c WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.restricted AND r.x = c.x AND r.y = c.y)")
def j14(spark, d):
    c = frame(spark, d, COINCIDENT)
    return spatial.vetoed(c, c.filter("restricted")).select("pid")


@query("j15_halo_alignment", f"WITH {grids.SYNTHETIC_SQL}, c AS (SELECT row, col, surface, unnest(range(CAST(floor((row - 2) / 16.0) AS BIGINT), CAST(floor((row + 2) / 16.0) AS BIGINT) + 1)) AS tr FROM grid), k AS (SELECT *, unnest(range(CAST(floor((col - 2) / 16.0) AS BIGINT), CAST(floor((col + 2) / 16.0) AS BIGINT) + 1)) AS tc FROM c) SELECT CAST(tr AS INTEGER) AS tile_row, CAST(tc AS INTEGER) AS tile_col, count(*) AS cells, count(*) FILTER (row // 16 <> tr OR col // 16 <> tc) AS halo FROM k GROUP BY tr, tc")
def j15(spark, d):
    own = (F.floor(F.col("row") / 16) == F.col("tile_row")) & (F.floor(F.col("col") / 16) == F.col("tile_col"))
    return grids.haloed_cells(grids.synthetic(spark), 16, 2).groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("cells"), F.count_if(~own).alias("halo"))


@query("j19_ring_completeness", f"SELECT u AS way, count(*) AS members, count(*) FILTER (n.node IS NULL) AS missing FROM ({EDGES}) e LEFT JOIN ({NODES}) n ON n.node = e.v GROUP BY u")
def j19(spark, d):
    n = frame(spark, d, NODES).select(F.col("node").alias("v"), F.lit(1).alias("hit"))
    return frame(spark, d, EDGES).join(n, "v", "left").groupBy(F.col("u").alias("way")).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query("j20_roofs_meeting_tiles", f"SELECT CAST(floor(x / 500) AS BIGINT) AS tx, CAST(floor(y / 500) AS BIGINT) AS ty, max(maxx) AS roof FROM ({POINTS}) JOIN ({BOXES}) ON {INSIDE} GROUP BY 1, 2")
def j20(spark, d):
    got = spatial.point_in_box(P(spark, d), B(spark, d), CELL)
    return got.groupBy(F.floor(F.col("x") / 500).cast("long").alias("tx"), F.floor(F.col("y") / 500).cast("long").alias("ty")).agg(F.max("maxx").alias("roof"))


@query("f25_bounds_intersect", f"SELECT sid, minx <= 900 AND 300 <= maxx AND miny <= 1200 AND 400 <= maxy AS meets FROM ({BOXES})")
def f25(spark, d):
    c, v = F.col, F.lit
    return B(spark, d).select("sid", spatial.overlaps(c("minx"), c("miny"), c("maxx"), c("maxy"), v(300.0), v(400.0), v(900.0), v(1200.0)).alias("meets"))


ENDPOINT = f"WITH p AS ({POINTS}), b AS ({BOXES}), hit AS (SELECT pid, count(*) AS n, bool_or(sid % 3 = 0) AS building, bool_or(sid % 3 = 1) AS water FROM p JOIN b ON {INSIDE} GROUP BY pid)"


@query("f21_endpoint_exclusion", f"{ENDPOINT} SELECT pid, CASE WHEN n > 5 THEN 'unknown' WHEN building THEN 'building' WHEN water THEN 'water' WHEN n > 0 THEN 'area' ELSE 'clear' END AS reason FROM p LEFT JOIN hit USING (pid)")
def f21(spark, d):
    s = F.col("sid") % 3
    hit = spatial.point_in_box(P(spark, d), B(spark, d), CELL).groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.bool_or(s == 0).alias("building"), F.bool_or(s == 1).alias("water"))
    reason = F.when(F.col("n") > 5, "unknown").when(F.col("building"), "building").when(F.col("water"), "water").when(F.col("n") > 0, "area").otherwise("clear")
    return P(spark, d).join(hit, "pid", "left").select("pid", reason.alias("reason"))

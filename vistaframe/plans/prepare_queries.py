"""Sources, guards, preparation, routes and scenes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, ordered, prepare, routes, sight, spatial, terrain
from ..sources import contexts, grids
from .base import frame, micro, micro_sql, query
from .sight_queries import CLEAR, PIECES, RAYS, VERDICT
from .spatial_queries import BOXES, INSIDE, POINTS, B, P

GRID = f"WITH {grids.SYNTHETIC_SQL}"
VALID = "(dtm IS NOT NULL AND surface IS NOT NULL AND (quality & 3) = 3 AND (quality & 248) = 0 AND occupancy <= 1)"


def G(spark):  # noqa: N802
    return grids.synthetic(spark)


def n():
    return F.count(F.lit(1))


# -- grids and scans -------------------------------------------------------------------


@query("s01_raster_window", f"{GRID} SELECT row, col, CASE WHEN dtm <> 7 THEN CAST(dtm AS BIGINT) END AS dtm FROM grid WHERE row BETWEEN 10 AND 29 AND col BETWEEN 5 AND 24")
def s01(spark, d):
    return grids.window(G(spark), 10, 5, 20, 20).select("row", "col", grids.cleaned(F.col("dtm"), 7.0).cast("long").alias("dtm"))


@query("s02_values_and_validity", f"{GRID} SELECT row, col, surface IS NOT NULL AND surface <> 20 AS valid FROM grid")
def s02(spark, d):
    return G(spark).select("row", "col", grids.cleaned(F.col("surface"), 20.0).isNotNull().alias("valid"))


@query("s03_tile_iteration", f"{GRID} SELECT CAST(row // 24 AS INTEGER) AS tile_row, CAST(col // 24 AS INTEGER) AS tile_col, max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width FROM grid GROUP BY 1, 2")
def s03(spark, d):
    t = G(spark).withColumn("tile_row", grids.tile_key(F.col("row"), 24)).withColumn("tile_col", grids.tile_key(F.col("col"), 24))
    span = lambda c: F.max(c) - F.min(c) + 1
    return t.groupBy("tile_row", "tile_col").agg(span("row").alias("height"), span("col").alias("width"))


TILES = "SELECT 'x' || tx || '_y' || ty AS tile_id, tx, ty FROM range(38, 43) a(tx), range(110, 114) b(ty)"


@query("s04_tile_grid", f"SELECT tile_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(tx * 5000 AS DOUBLE) AS minx, CAST(ty * 5000 AS DOUBLE) AS miny FROM ({TILES})")
def s04(spark, d):
    return grids.tile_grid(spark, 190_100, 551_000, 214_900, 569_000).select("tile_id", "tx", "ty", "minx", "miny")


@query("s05_halo_grid", f"SELECT tile_id, CAST(tx * 5000 - 55 AS DOUBLE) AS minx, CAST((tx + 1) * 5000 + 55 AS DOUBLE) AS maxx, 1022 AS width FROM ({TILES})")
def s05(spark, d):
    return grids.with_halo(grids.tile_grid(spark, 190_100, 551_000, 214_900, 569_000), 52).select("tile_id", "minx", "maxx", "width")


@query("s06_integer_crop", f"{GRID} SELECT row - 8 AS row, col - 16 AS col, occupancy FROM grid WHERE row BETWEEN 8 AND 23 AND col BETWEEN 16 AND 31")
def s06(spark, d):
    return grids.window(G(spark), 8, 16, 16, 16).select((F.col("row") - 8).alias("row"), (F.col("col") - 16).alias("col"), "occupancy")


BLOB = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 6 AS INTEGER) AS code FROM {customer}"


@query("s08_geometry_blob", f"SELECT id, CASE WHEN code <= 4 THEN [8, 40, 56, 56, 72][code + 1] END AS skipped, CASE WHEN code <= 4 THEN 1 END AS kind FROM ({BLOB})")
def s08(spark, d):
    skip = F.element_at(F.array(*[F.lit(x) for x in (8, 40, 56, 56, 72, 8)]), F.col("code") + 1)
    head = F.concat(F.lit("475000"), F.lpad(F.hex(F.col("code").cast("long") * 2), 2, "0"), F.repeat(F.lit("00"), skip - 4), F.lit("0101000000"), F.repeat(F.lit("00"), F.lit(16)))
    blob = F.unhex(head)
    body = contexts.geometry_body(blob)
    return frame(spark, d, BLOB).select("id", (F.length(blob) - F.length(body)).alias("skipped"), F.when(body.isNotNull(), contexts.wkb_point(body)["kind"]).alias("kind"))


@query("s09_layer_scan", f"SELECT sid FROM ({BOXES}) WHERE minx <= 1200 AND maxx >= 200 AND miny <= 1500 AND maxy >= 100 AND sid % 7 <> 0 ORDER BY (maxx - minx) * (maxy - miny) DESC, sid LIMIT 40")
def s09(spark, d):
    c = F.col
    hit = B(spark, d).filter((c("minx") <= 1200) & (c("maxx") >= 200) & (c("miny") <= 1500) & (c("maxy") >= 100) & (c("sid") % 7 != 0))
    return hit.orderBy(((c("maxx") - c("minx")) * (c("maxy") - c("miny"))).desc(), "sid").limit(40).select("sid")


@query("s18_synthetic_grid", f"{GRID} SELECT row, col, CAST(dtm AS BIGINT) AS dtm, CAST(surface AS BIGINT) AS surface, occupancy, quality, out_mask FROM grid")
def s18(spark, d):
    return G(spark).withColumn("dtm", F.col("dtm").cast("long")).withColumn("surface", F.col("surface").cast("long"))


@query("s19_forecast_hours", "SELECT CAST(s_suppkey AS BIGINT) AS id, h AS hour, CASE WHEN h % 5 <> 0 THEN h * 2 END AS rain FROM {supplier}, range(6) t(h)")
def s19(spark, d):
    base = frame(spark, d, "SELECT CAST(s_suppkey AS BIGINT) AS id FROM {supplier}")
    hours = F.sequence(F.lit(0), F.lit(5))
    times = F.array_join(F.transform(hours, lambda h: F.format_string('"2024-05-01T%02d:00"', h)), ",")
    rain = F.array_join(F.transform(hours, lambda h: F.when(h % 5 != 0, (h * 2).cast("string")).otherwise("null")), ",")
    none = F.lit("[null,null,null,null,null,null]")
    body = F.concat(F.lit('{"hourly":{"time":['), times, F.lit('],"precipitation":['), rain, F.lit('],"cloud_cover":'), none, F.lit(',"visibility":'), none, F.lit(',"wind_speed_10m":'), none, F.lit("}}"))
    got = contexts.hours(base.withColumn("body", body), "id", "body")
    return got.select("id", ((F.col("vt") - 1714521600) / 3600).cast("long").alias("hour"), F.col("rain").cast("long").alias("rain"))


@query("s20_extraction_polygon", "SELECT * FROM (VALUES ('1', FALSE, 4, 10.0::DOUBLE), ('1', FALSE, 5, 20.0::DOUBLE), ('1', FALSE, 6, 20.0::DOUBLE), ('!2', TRUE, 9, 12.5::DOUBLE), ('!2', TRUE, 10, 13.0::DOUBLE)) t(section, hole, n, x)")
def s20(spark, d):
    text = ["area", "", "1", "  10.0 5.0", " 20.0 5.0", " 2.0E1 9.5", "END", "!2", " 12.5 6", " 13.0 7", "END", "END"]
    lines = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in text])).alias("i", "value")).select((F.col("i") + 1).alias("n"), "value")
    return contexts.polygons(lines).select("section", "hole", "n", "x")


@query("k07_feature_viewport", f"SELECT pid AS id, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']}},\"properties\":{{\"name\":\"p' || pid || '\"}}}}' AS body FROM ({POINTS}) ORDER BY pid LIMIT 50")
def k07(spark, d):
    return contexts.features_json(P(spark, d).select(F.col("pid").alias("id"), "x", "y", F.concat(F.lit("p"), F.col("pid")).alias("name")), 50, 40_000)


# -- guards ----------------------------------------------------------------------------

REQ = "SELECT o_orderkey AS id, o_totalprice / 2000 - 20 AS minutes, o_custkey % 12 - 1 AS k, CASE o_orderkey % 5 WHEN 0 THEN 'flying' WHEN 1 THEN 'transit' ELSE 'walking' END AS mode, CASE WHEN o_orderkey % 4 = 0 THEN 'false' ELSE 'true' END AS flag FROM {orders}"


@query("f01_request_errors", f"SELECT id, array_to_string(list_filter([CASE WHEN NOT (minutes BETWEEN 1 AND 180) THEN 'minutes' END, CASE WHEN NOT (k BETWEEN 1 AND 10) THEN 'k' END, CASE WHEN mode NOT IN ('walking', 'transit', 'driving') THEN 'mode' END], lambda x: x IS NOT NULL), ',') AS errors FROM ({REQ})")
def f01(spark, d):
    from ..operators.validate import errors, in_range, one_of

    return frame(spark, d, REQ).select("id", F.array_join(errors({"minutes": in_range("minutes", 1, 180), "k": in_range("k", 1, 10), "mode": one_of("mode", "walking", "transit", "driving")}), ",").alias("errors"))


@query("f02_closed_schema", "SELECT event_id AS id, len(list_filter(json_keys(props), lambda k: k NOT IN ('k'))) = 0 AS closed FROM {events}")
def f02(spark, d):
    from ..operators.validate import closed

    return frame(spark, d, "SELECT * FROM {events}").select(F.col("event_id").alias("id"), closed(F.col("props"), ["k"]).alias("closed"))


@query("f03_local_time_gap_and_fold", "SELECT * FROM (VALUES ('2024-03-10 01:30:00', 'ok'), ('2024-03-10 02:30:00', 'nonexistent'), ('2024-11-03 01:30:00', 'ambiguous'), ('2024-11-03 03:00:00', 'ok'), ('soon', 'unreadable')) t(raw, verdict)")
def f03(spark, d):
    from ..operators.validate import local_time

    rows = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in ("2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 03:00:00", "soon")])).alias("raw"))
    return rows.select("raw", local_time(F.col("raw"), "America/New_York").alias("verdict"))


@query("f04_target_reason", f"{GRID} SELECT s.id, CASE WHEN NOT (agl BETWEEN 0 AND 40) THEN 'height' WHEN g.row IS NULL THEN 'outside' WHEN NOT {VALID} THEN 'unknown cell' WHEN dtm + agl < surface THEN 'below surface' ELSE 'ok' END AS reason FROM (SELECT s_suppkey AS id, s_suppkey * 7 % 70 AS row, s_suppkey * 11 % 66 AS col, s_suppkey % 45 - 2 AS agl FROM {{supplier}}) s LEFT JOIN grid g ON g.row = s.row AND g.col = s.col")
def f04(spark, d):
    t = frame(spark, d, "SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 70 AS INT) AS row, CAST(s_suppkey * 11 % 66 AS INT) AS col, s_suppkey % 45 - 2 AS agl FROM {supplier}")
    j = t.join(F.broadcast(G(spark).withColumn("hit", F.lit(1))), ["row", "col"], "left")
    reason = F.when(~F.col("agl").between(0, 40), "height").when(F.col("hit").isNull(), "outside").when(~grids.cell_valid(), "unknown cell").when(F.col("dtm") + F.col("agl") < F.col("surface"), "below surface").otherwise("ok")
    return j.select("id", reason.alias("reason"))


@query("f05_cell_validity", f"{GRID} SELECT row, col, {VALID} AS valid FROM grid")
def f05(spark, d):
    return G(spark).select("row", "col", grids.cell_valid().alias("valid"))


@query("f06_surface_contract", f"{GRID} SELECT count(*) AS violations FROM grid WHERE surface < dtm - 1e-6 OR (occupancy = 0 AND abs(surface - dtm) > 1e-6)")
def f06(spark, d):
    return G(spark).filter(grids.contract_violated()).agg(n().alias("violations"))


@query("f07_disk_coverage", f"{GRID} SELECT CAST(r AS INTEGER) AS radius, count(*) FILTER (NOT {VALID}) AS unsupported, count(*) AS cells FROM grid, (VALUES (5), (12), (20)) t(r) WHERE (row - 40) * (row - 40) + (col - 40) * (col - 40) <= (r + 1) * (r + 1) GROUP BY r")
def f07(spark, d):
    g = G(spark).withColumn("radius", F.explode(F.array(F.lit(5), F.lit(12), F.lit(20))))
    r = F.col("radius") + 1
    near = (F.col("row") - 40) * (F.col("row") - 40) + (F.col("col") - 40) * (F.col("col") - 40) <= r * r
    return g.filter(near).groupBy("radius").agg(F.count_if(~grids.cell_valid()).alias("unsupported"), n().alias("cells"))


@query("f08_output_eligibility", f"{GRID} SELECT row, col, occupancy = 0 AND (row - 32) * (row - 32) * 25 + (col - 32) * (col - 32) * 25 <= 10000 + 1e-9 AND out_mask <> 0 AND (row + col) % 2 = 0 AS eligible FROM grid")
def f08(spark, d):
    d2 = ((F.col("row") - 32) * (F.col("row") - 32) + (F.col("col") - 32) * (F.col("col") - 32)) * 25
    return G(spark).select("row", "col", ((F.col("occupancy") == 0) & (d2 <= 10_000 + 1e-9) & (F.col("out_mask") != 0) & ((F.col("row") + F.col("col")) % 2 == 0)).alias("eligible"))


@query("f22_tile_cell_reason", f"{GRID} SELECT row, col, CASE WHEN row >= 48 AND col >= 48 THEN 'missing_tile' WHEN row = 10 THEN 'terrain_overlap_disagreement' WHEN (row + col) % 50 = 0 THEN 'uncertain_region' WHEN (quality & 1) = 0 THEN 'terrain_unsupported' WHEN out_mask = 0 THEN 'outside_requested_support' WHEN (quality & 248) <> 0 OR surface IS NULL THEN 'obstruction_height_unknown' END AS reason FROM grid")
def f22(spark, d):
    g = G(spark).withColumn("tile_id", F.when(~((F.col("row") >= 48) & (F.col("col") >= 48)), "t")).withColumn("disagrees", F.col("row") == 10)
    g = g.withColumn("uncertainty", F.when((F.col("row") + F.col("col")) % 50 == 0, "u")).withColumn("terrain_quality", F.lit(1)).withColumn("contract_mask", F.col("out_mask"))
    return g.select("row", "col", prepare.tile_value_reason().alias("reason"))


@query("f23_observer_eligibility", f"{GRID} SELECT row, col, CASE WHEN occupancy = 1 THEN 'observer_cell_occupied' WHEN out_mask = 0 THEN 'outside_city' WHEN NOT (0.4 + (row + col) % 30 / 10.0 BETWEEN 0.5 AND 3) THEN 'eye_height' ELSE 'ok' END AS reason FROM grid")
def f23(spark, d):
    eye = 0.4 + (F.col("row") + F.col("col")) % 30 / 10
    return G(spark).select("row", "col", F.when(F.col("occupancy") == 1, "observer_cell_occupied").when(F.col("out_mask") == 0, "outside_city").when(~eye.between(0.5, 3), "eye_height").otherwise("ok").alias("reason"))


TARGETS = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'river' WHEN 1 THEN 'greenery' ELSE 'city' END AS category, CASE p_size % 5 WHEN 0 THEN 'river' WHEN 1 THEN 'pond' END AS water, p_retailprice * (p_partkey % 20) AS area, CAST(p_partkey * 131 % 5000 AS DOUBLE) AS x, CAST(p_partkey * 197 % 5000 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS height FROM {part}"
DIST = "sqrt((x - 2500) * (x - 2500) + (y - 2500) * (y - 2500))"
KEEP = f"{DIST} BETWEEN 40 AND 2000 AND NOT (category = 'river' AND NOT (coalesce(water = 'river', FALSE) OR area > 10000)) AND NOT (category = 'greenery' AND area < 10000)"


def _targets(spark, d):
    t = frame(spark, d, TARGETS)
    dist = F.sqrt((F.col("x") - 2500) * (F.col("x") - 2500) + (F.col("y") - 2500) * (F.col("y") - 2500))
    t = t.withColumn("dist", dist).filter(F.col("dist").between(40, 2000))
    river = (F.col("category") == "river") & ~(F.coalesce(F.col("water") == "river", F.lit(False)) | (F.col("area") > 10_000))
    return t.filter(~river & ~((F.col("category") == "greenery") & (F.col("area") < 10_000)))


@query("f24_target_filters", f"SELECT id FROM ({TARGETS}) WHERE {KEEP}")
def f24(spark, d):
    return _targets(spark, d).select("id")


IMP = "CASE WHEN category = 'city' THEN least(80, greatest(0, height)) / pow(1 + dist / 500, 1.5e0) ELSE (CASE WHEN area > 0 THEN sqrt(area) ELSE 20 END) / (1 + dist / 2000) END"
CHOSEN = f"""WITH t AS (SELECT *, {DIST} AS dist FROM ({TARGETS}) WHERE {KEEP}),
i AS (SELECT *, {IMP} AS imp, CAST(floor((degrees(atan2(x - 2500, y - 2500)) - 360 * floor(degrees(atan2(x - 2500, y - 2500)) / 360)) / 90) AS INTEGER) AS sector FROM t),
s AS (SELECT *, CASE WHEN dist <= 1200 AND row_number() OVER (PARTITION BY category, dist <= 1200, sector ORDER BY CAST(floor(imp * 1e6 + 0.5e0) AS BIGINT) DESC, dist, id) = 1 THEN 0
  WHEN dist > 1200 AND row_number() OVER (PARTITION BY category, dist <= 1200 ORDER BY CAST(floor(imp * 1e6 + 0.5e0) AS BIGINT) DESC, dist, id) = 1 THEN 1 ELSE 2 END AS pri FROM i)
SELECT category, CAST(r AS INTEGER) AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pri, CASE WHEN pri = 0 THEN sector END, dist, id) AS r FROM s) WHERE r <= 5"""


@query("o08_targets_per_category", CHOSEN)
def o08(spark, d):
    from ..functions import geo, scores

    t = _targets(spark, d).withColumn("imp", micro(scores.importance(F.col("category"), F.col("height"), F.col("area"), F.col("dist")))).withColumn("near", F.col("dist") <= 1200)
    t = t.withColumn("sector", F.floor(geo.planar_bearing(F.col("x") - 2500, F.col("y") - 2500) / 90).cast("int"))
    order = [F.col("imp").desc(), F.col("dist"), F.col("id")]
    in_sector = F.row_number().over(Window.partitionBy("category", "near", "sector").orderBy(*order))
    outer = F.row_number().over(Window.partitionBy("category", "near").orderBy(*order))
    t = t.withColumn("pri", F.when(F.col("near") & (in_sector == 1), 0).when(~F.col("near") & (outer == 1), 1).otherwise(2))
    w = Window.partitionBy("category").orderBy("pri", F.when(F.col("pri") == 0, F.col("sector")), "dist", "id")
    return t.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("category", "place", "id")


@query("f28_field_suggestion", "SELECT 'p_size' AS field, 'height' AS kind UNION ALL SELECT 'p_name', 'name'")
def f28(spark, d):
    from ..operators.validate import suggestions

    return suggestions(frame(spark, d, "SELECT * FROM {part}"), {"height": r"size|height", "name": r"_name$"})


@query("f31_context_radius", "SELECT CAST(c_custkey AS BIGINT) AS id FROM {customer} WHERE 2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians((c_custkey % 100) / 1e4) / 2), 2)))) <= 555.5")
def f31(spark, d):
    from ..functions.geo import haversine

    lat = 37.5 + (F.col("c_custkey") % 100) / 1e4
    return frame(spark, d, "SELECT * FROM {customer}").filter(haversine(F.lit(127.0), F.lit(37.5), F.lit(127.0), lat) <= 555.5).select(F.col("c_custkey").cast("long").alias("id"))


WAYS = "SELECT l_orderkey AS way, l_linenumber AS n, l_partkey AS node FROM {lineitem}"


@query("f33_way_completeness", f"SELECT way, count(*) >= 2 AND count(*) FILTER (node NOT IN (SELECT c_custkey FROM {{customer}})) = 0 AS complete FROM ({WAYS}) GROUP BY way")
def f33(spark, d):
    nodes = frame(spark, d, "SELECT CAST(c_custkey AS BIGINT) AS node, 1 AS hit FROM {customer}")
    return frame(spark, d, WAYS).join(nodes, "node", "left").groupBy("way").agg(((n() >= 2) & (F.count_if(F.col("hit").isNull()) == 0)).alias("complete"))


@query("f34_readiness", "SELECT o_orderpriority AS stage, bool_and(o_orderstatus <> 'P') AS ready FROM {orders} GROUP BY 1")
def f34(spark, d):
    return frame(spark, d, "SELECT * FROM {orders}").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("ready"))


# -- geometry of the grid ---------------------------------------------------------------


@query("g03_dependency_region", f"{GRID} SELECT row, col, sqrt((row - 32) * (row - 32) + (col - 32) * (col - 32)) * 5 <= 65 AS needed FROM grid WHERE abs(row - 32) <= 13 AND abs(col - 32) <= 13")
def g03(spark, d):
    r, c = F.col("row") - 32, F.col("col") - 32
    return G(spark).filter((F.abs(r) <= 13) & (F.abs(c) <= 13)).select("row", "col", (F.sqrt(r * r + c * c) * 5 <= 65).alias("needed"))


@query("g05_cell_centres", f"{GRID} SELECT row, col, 199800 + (col + 0.5e0) * 5 AS x, 550200 - (row + 0.5e0) * 5 AS y FROM grid")
def g05(spark, d):
    x, y = grids.centre_of(F.col("row"), F.col("col"), 199800.0, 550200.0, 5.0)
    return G(spark).select("row", "col", x.alias("x"), y.alias("y"))


@query("g06_affine_inverse", f"SELECT pid, {micro_sql('(-2 * (x - 10) - 0.5e0 * (y - 500)) / (4e0 * -2 - 0.5e0 * 1)')} AS u_micro, {micro_sql('(4e0 * (y - 500) - 1 * (x - 10)) / (4e0 * -2 - 0.5e0 * 1)')} AS v_micro FROM ({POINTS})")
def g06(spark, d):
    u, v = grids.inverse_affine(F.col("x"), F.col("y"), (10.0, 4.0, 0.5, 500.0, 1.0, -2.0))
    return P(spark, d).select("pid", micro(u).alias("u_micro"), micro(v).alias("v_micro"))


@query("g07_containing_cell", f"SELECT pid, CAST(floor((2000 - y) / 5e0) AS INTEGER) AS row, CAST(floor(x / 5e0) AS INTEGER) AS col FROM ({POINTS})")
def g07(spark, d):
    row, col = grids.cell_of(F.col("x"), F.col("y"), 0.0, 2000.0, 5.0)
    return P(spark, d).select("pid", row.alias("row"), col.alias("col"))


@query("g09_touching_indices", "SELECT id, unnest(CASE WHEN id % 4 = 0 THEN [id // 4 - 1, id // 4] ELSE [id // 4] END) AS cell FROM (SELECT CAST(c_custkey AS INTEGER) AS id FROM {customer})")
def g09(spark, d):
    return frame(spark, d, "SELECT CAST(c_custkey AS INT) AS id FROM {customer}").select("id", F.explode(sight.touching(F.col("id") / 4)).alias("cell"))


SLAB = "greatest(0, least((cx - 2.5e0 - x) / (cx - x), (cx + 2.5e0 - x) / (cx - x)), least((cy - 2.5e0 - y) / (cy - y), (cy + 2.5e0 - y) / (cy - y)))"


@query("g15_edge_target", f"SELECT pid, {micro_sql('t')} AS t_micro, {micro_sql('x + t * (cx - x)')} AS ex_micro FROM (SELECT *, CASE WHEN abs(cx - x) > 2.5 OR abs(cy - y) > 2.5 THEN {SLAB} END AS t FROM (SELECT *, 1002.5e0 AS cx, 997.5e0 AS cy FROM ({POINTS})))")
def g15(spark, d):
    t, x, _ = prepare.edge_target(F.col("x"), F.col("y"), F.lit(1002.5), F.lit(997.5), 5.0)
    return P(spark, d).select("pid", micro(t).alias("t_micro"), micro(x).alias("ex_micro"))


@query("g17_tile_sample", f"{GRID} SELECT p.pid, CASE WHEN g.row IS NULL THEN 'missing_tile' WHEN surface IS NULL OR (quality & 248) <> 0 THEN 'obstruction_height_unknown' ELSE 'supported' END AS state FROM ({POINTS}) p LEFT JOIN grid g ON g.row = CAST(floor((1500 - y) / 25) AS INTEGER) AND g.col = CAST(floor(x / 25) AS INTEGER)")
def g17(spark, d):
    row, col = grids.cell_of(F.col("x"), F.col("y"), 0.0, 1500.0, 25.0)
    g = G(spark).withColumn("tile_id", F.lit("t")).withColumn("disagrees", F.lit(False)).withColumn("uncertainty", F.lit(None).cast("string")).withColumn("terrain_quality", F.lit(1)).withColumn("contract_mask", F.lit(1))
    j = P(spark, d).withColumn("row", row).withColumn("col", col).join(F.broadcast(g), ["row", "col"], "left")
    return j.select("pid", F.coalesce(prepare.tile_value_reason(), F.lit("supported")).alias("state"))


AREAS = "SELECT CAST(s_suppkey AS INTEGER) AS place, 'r' || (s_suppkey % 5) AS reason, CAST(s_suppkey * 23 % 280 AS DOUBLE) AS minx, CAST(s_suppkey * 31 % 280 AS DOUBLE) AS miny, CAST(s_suppkey * 23 % 280 + 12 AS DOUBLE) AS maxx, CAST(s_suppkey * 31 % 280 + 18 AS DOUBLE) AS maxy FROM {supplier}"


@query("g18_uncertainty_reasons", f"{GRID} SELECT g.row, g.col, arg_max(reason, place) AS reason FROM grid g LEFT JOIN ({AREAS}) ON g.col BETWEEN floor((minx - 5) / 5) AND floor((maxx + 5) / 5) AND g.row BETWEEN floor((320 - maxy - 5) / 5) AND floor((320 - miny + 5) / 5) GROUP BY 1, 2")
def g18(spark, d):
    return prepare.uncertain(G(spark).select("row", "col"), frame(spark, d, AREAS), 5.0, 0.0, 320.0).select("row", "col", "reason")


@query("g21_minimum_filter", f"{GRID} SELECT a.row, a.col, CAST(min(b.dtm) AS BIGINT) AS least FROM grid a JOIN grid b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2")
def g21(spark, d):
    return prepare.min_filter(G(spark), "dtm").select("row", "col", F.col("min_dtm").cast("long").alias("least"))


FOOT = "SELECT CAST(p_partkey AS BIGINT) AS fid, CAST(p_partkey * 13 % 300 AS DOUBLE) AS minx, CAST(p_partkey * 29 % 300 AS DOUBLE) AS miny, CAST(p_partkey * 13 % 300 + 6 + p_size % 9 AS DOUBLE) AS maxx, CAST(p_partkey * 29 % 300 + 5 + p_size % 7 AS DOUBLE) AS maxy, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS measured, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 12 END AS floors FROM {part}"
BURN = f"burn AS (SELECT f.*, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT *, unnest(range(CAST(floor(minx / 5) AS BIGINT), CAST(floor(maxx / 5) AS BIGINT) + 1)) AS c FROM ({FOOT})) f, LATERAL (SELECT unnest(range(CAST(floor((320 - maxy) / 5) AS BIGINT), CAST(floor((320 - miny) / 5) AS BIGINT) + 1)) AS r))"


@query("g22_burn_footprints", f"WITH {BURN} SELECT fid, row, col FROM burn")
def g22(spark, d):
    return prepare.burn_boxes(frame(spark, d, FOOT), 5.0, 0.0, 320.0).select("fid", "row", "col")


@query("g23_whole_cells", f"SELECT fid, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM ({FOOT}), range(64) a(r), range(64) b(c) WHERE c * 5 >= minx AND (c + 1) * 5 <= maxx AND 320 - r * 5 <= maxy AND 320 - (r + 1) * 5 >= miny")
def g23(spark, d):
    return prepare.whole_cells(frame(spark, d, FOOT), 5.0, 0.0, 320.0).select("fid", "row", "col")


CASC = "CASE WHEN measured > 0 THEN measured WHEN floors > 0 THEN floors * 3.2e0 END"
PREP = f"""{GRID}, {BURN},
below AS (SELECT fid, quantile_cont(g.dtm, 0.5) AS base, max(g.dtm) AS top, max(g.dtm) - min(g.dtm) AS relief, bool_or(g.dtm IS NULL) AS incomplete FROM burn b LEFT JOIN grid g ON g.row = b.row AND g.col = b.col GROUP BY fid),
roofs AS (SELECT f.fid, {CASC} AS height, CASE WHEN measured > 0 THEN 0 WHEN floors > 0 THEN 1 ELSE 0 END AS estimated, b.*, ({CASC}) IS NULL OR base IS NULL OR incomplete AS unresolved, CASE WHEN NOT (({CASC}) IS NULL OR base IS NULL OR incomplete) THEN base + {CASC} END AS roof FROM ({FOOT}) f JOIN below b USING (fid)),
flags AS (SELECT *, coalesce(roof < top - 0.01 OR (roof IS NOT NULL AND relief > 20), FALSE) AS conflict FROM roofs)"""


def _roofs(spark, d):
    foot = frame(spark, d, FOOT)
    foot = foot.withColumn("h", prepare.height_cascade(F.col("measured"), F.col("floors"), 3.2)).select("*", "h.*").drop("h")
    burned = prepare.burn_boxes(foot, 5.0, 0.0, 320.0)
    below = prepare.bases(burned.select("fid", "row", "col"), G(spark), "fid")
    return foot, burned, prepare.roofs(foot, below, "fid")


@query("g25_building_heights", f"SELECT fid, {micro_sql(CASC)} AS height_micro, CASE WHEN measured > 0 THEN 'measured_height' WHEN floors > 0 THEN 'above_ground_floors' ELSE 'unresolved' END AS source FROM ({FOOT})")
def g25(spark, d):
    return _roofs(spark, d)[0].select("fid", micro(F.col("height")).alias("height_micro"), "source")


@query("a19_footprint_base", f"{PREP} SELECT fid, {micro_sql('base')} AS base_micro FROM below")
def a19(spark, d):
    return _roofs(spark, d)[2].select("fid", micro(F.col("base")).alias("base_micro"))


@query("a20_relief_and_conflict", f"{PREP} SELECT fid, CAST(relief AS BIGINT) AS relief, unresolved, conflict FROM flags")
def a20(spark, d):
    return _roofs(spark, d)[2].select("fid", F.col("relief").cast("long").alias("relief"), "unresolved", "conflict")


SURF = f"""{PREP}, per AS (SELECT b.row, b.col, max(roof) AS roof, max(estimated) AS estimated, bool_or(unresolved) AS unresolved, bool_or(conflict) AS conflict FROM burn b JOIN flags USING (fid) GROUP BY 1, 2)"""


def _surface(spark, d):
    _, burned, roofed = _roofs(spark, d)
    rows = burned.select("fid", "row", "col").join(roofed.select("fid", "roof", "estimated", "unresolved", "conflict"), "fid")
    return rows, prepare.surfaces(G(spark), rows, "fid")


@query("a18_highest_roof_per_cell", f"{SURF} SELECT row, col, {micro_sql('roof')} AS roof_micro FROM per")
def a18(spark, d):
    return _surface(spark, d)[0].groupBy("row", "col").agg(micro(F.max("roof")).alias("roof_micro"))


@query("g24_surfaces", f"{SURF} SELECT g.row, g.col, {micro_sql('greatest(dtm, roof)')} AS surface_micro, CASE WHEN per.row IS NULL THEN 0 ELSE 1 END AS occupancy, CAST(CASE WHEN dtm IS NOT NULL THEN 1 ELSE 0 END + 2 + CASE WHEN estimated = 1 THEN 4 ELSE 0 END + CASE WHEN unresolved THEN 8 ELSE 0 END + CASE WHEN conflict THEN 16 ELSE 0 END AS INTEGER) AS quality FROM grid g LEFT JOIN per ON per.row = g.row AND per.col = g.col")
def g24(spark, d):
    return _surface(spark, d)[1].select("row", "col", micro(F.col("surface")).alias("surface_micro"), "occupancy", "quality")


@query("g26_terrain_masks", f"{GRID} SELECT row, col, CAST(CASE WHEN row BETWEEN 4 AND 59 AND col BETWEEN 4 AND 59 THEN 1 ELSE 0 END + CASE WHEN row + col > 20 THEN 2 ELSE 0 END AS INTEGER) AS contract_mask FROM grid")
def g26(spark, d):
    support = F.col("row").between(4, 59) & F.col("col").between(4, 59)
    city = F.col("row") + F.col("col") > 20
    return G(spark).select("row", "col", (F.when(support, 1).otherwise(0) + F.when(city, 2).otherwise(0)).cast("int").alias("contract_mask"))


@query("g27_path_chainage", "WITH l AS (SELECT l_orderkey AS line, count(*) * 70 AS len FROM {lineitem} GROUP BY 1) SELECT line, vt AS metres, substring(sha256(line || ':' || vt), 1, 24) AS id FROM (SELECT line, unnest(range(0, CAST(len AS BIGINT) + 1, 20)) AS vt FROM l) WHERE vt % 300 < 200")
def g27(spark, d):
    per = frame(spark, d, "SELECT * FROM {lineitem}").groupBy(F.col("l_orderkey").alias("line")).agg((n() * 70).alias("len"))
    at = per.withColumn("metres", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / 20) * 20, F.lit(20).cast("long"))))
    return at.filter("metres % 300 < 200").select("line", "metres", F.substring(F.sha2(F.concat_ws(":", "line", "metres"), 256), 1, 24).alias("id"))


@query("g28_area_lattice", f"SELECT sid, CAST(gx * 20 AS BIGINT) AS x, CAST(gy * 20 AS BIGINT) AS y FROM (SELECT *, unnest(range(CAST(ceil(minx / 20) AS BIGINT), CAST(floor(maxx / 20) AS BIGINT) + 1)) AS gx FROM ({BOXES})) b, LATERAL (SELECT unnest(range(CAST(ceil(miny / 20) AS BIGINT), CAST(floor(maxy / 20) AS BIGINT) + 1)) AS gy)")
def g28(spark, d):
    span = lambda a, b: F.sequence(F.ceil(F.col(a) / 20), F.floor(F.col(b) / 20))
    b = B(spark, d).filter((F.ceil(F.col("minx") / 20) <= F.floor(F.col("maxx") / 20)) & (F.ceil(F.col("miny") / 20) <= F.floor(F.col("maxy") / 20)))
    return b.withColumn("gx", F.explode(span("minx", "maxx"))).withColumn("gy", F.explode(span("miny", "maxy"))).select("sid", (F.col("gx") * 20).alias("x"), (F.col("gy") * 20).alias("y"))


@query("g31_sample_points", f"SELECT sid, CAST(k AS INTEGER) AS k, minx + (maxx - minx) * k / 10 AS x, miny + (maxy - miny) * k / 10 AS y FROM ({BOXES}), (VALUES (3), (5), (7)) t(k)")
def g31(spark, d):
    c = F.col
    at = B(spark, d).withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7))))
    return at.select("sid", "k", (c("minx") + (c("maxx") - c("minx")) * c("k") / 10).alias("x"), (c("miny") + (c("maxy") - c("miny")) * c("k") / 10).alias("y"))


RAYSET = f"WITH {grids.SYNTHETIC_SQL}, rays AS ({RAYS}), {PIECES}, {CLEAR}"


@query("g13_ray_evidence", f"{RAYSET} SELECT ray_id, {VERDICT} AS state, count(DISTINCT (row, col)) AS cells, array_to_string(list_sort(list_distinct(list(CAST(row // 16 AS VARCHAR) || '_' || CAST(col // 16 AS VARCHAR)))), ',') AS tiles FROM clear GROUP BY ray_id")
def g13(spark, d):
    rays = frame(spark, d, RAYS)
    state = sight.sight_lines(rays, G(spark), 5.0, ["ray_id"], 4096).select("ray_id", "state")
    tile = F.concat_ws("_", F.floor(F.col("row") / 16), F.floor(F.col("col") / 16))
    seen = sight.pieces(rays).groupBy("ray_id").agg(F.count_distinct("row", "col").alias("cells"), F.array_join(F.array_sort(F.collect_set(tile)), ",").alias("tiles"))
    return state.join(seen, "ray_id")


@query("a26_ray_statistics", f"{RAYSET} SELECT ray_id, count(DISTINCT CASE WHEN s IS NULL THEN (row, col) END) AS unknown_cells, coalesce(bool_or(clear < -1e-6), FALSE) AS blocked FROM clear GROUP BY ray_id")
def a26(spark, d):
    rays = frame(spark, d, RAYS)
    dist = F.sqrt(F.pow(F.col("c1") - F.col("c0"), 2) + F.pow(F.col("r1") - F.col("r0"), 2)) * 5.0
    cut = sight.with_surface(sight.pieces(rays.withColumn("q", sight.sag(dist))), G(spark), 4096)
    low = sight.clearance(F.col("cell_surface"), F.col("q")) < -1e-6
    missing = F.when(F.col("cell_surface").isNull(), F.struct("row", "col"))
    return cut.groupBy("ray_id").agg(F.count_distinct(missing).alias("unknown_cells"), F.coalesce(F.bool_or(low), F.lit(False)).alias("blocked"))


@query("g33_first_blocker", f"{RAYSET} SELECT ray_id, min(enter_t) IS NOT NULL AS any_blocker, {micro_sql('min(enter_t)')} AS enter_micro FROM clear WHERE clear < -1e-6 GROUP BY ray_id")
def g33(spark, d):
    rays = frame(spark, d, RAYS)
    dist = F.sqrt(F.pow(F.col("c1") - F.col("c0"), 2) + F.pow(F.col("r1") - F.col("r0"), 2)) * 5.0
    cut = sight.with_surface(sight.pieces(rays.withColumn("q", sight.sag(dist))), G(spark), 4096)
    hit = cut.filter(sight.clearance(F.col("cell_surface"), F.col("q")) < -1e-6)
    return hit.groupBy("ray_id").agg(F.min("enter_t").isNotNull().alias("any_blocker"), micro(F.min("enter_t")).alias("enter_micro"))


@query("w11_cell_cuts", f"{RAYSET} SELECT ray_id, count(*) AS cuts FROM cuts GROUP BY ray_id")
def w11(spark, d):
    return sight.pieces(frame(spark, d, RAYS)).filter("enter_t = leave_t").select("ray_id", "enter_t").distinct().groupBy("ray_id").agg(n().alias("cuts"))


@query("j16_rays_to_cells", f"{RAYSET} SELECT ray_id, count(DISTINCT (row, col)) AS cells, count(DISTINCT CASE WHEN s IS NULL THEN (row, col) END) AS missing FROM clear GROUP BY ray_id")
def j16(spark, d):
    cut = sight.with_surface(sight.pieces(frame(spark, d, RAYS)), G(spark), 4096)
    return cut.groupBy("ray_id").agg(F.count_distinct("row", "col").alias("cells"), F.count_distinct(F.when(F.col("cell_surface").isNull(), F.struct("row", "col"))).alias("missing"))


@query("g36_window_sizes", "WITH p AS (SELECT l_suppkey % 4 AS tile, CAST(l_partkey * 37 % 320 AS DOUBLE) AS px, CAST(l_orderkey * 11 % 320 AS DOUBLE) AS py FROM {lineitem}), s AS (SELECT unnest([64, 32, 16]) AS size), w AS (SELECT tile, size, wx, wy, count(*) AS n FROM p, s, LATERAL (SELECT unnest(range(CAST(greatest(0, floor((px - 10) / (size * 5))) AS BIGINT), CAST(greatest(0, floor((px + 10) / (size * 5))) AS BIGINT) + 1)) AS wx), LATERAL (SELECT unnest(range(CAST(greatest(0, floor((py - 10) / (size * 5))) AS BIGINT), CAST(greatest(0, floor((py + 10) / (size * 5))) AS BIGINT) + 1)) AS wy) GROUP BY ALL), m AS (SELECT tile, size, max(n) AS n FROM w GROUP BY ALL) SELECT tile, max(CASE WHEN n <= 5200 THEN size END) AS size FROM m GROUP BY tile")
def g36(spark, d):
    p = frame(spark, d, "SELECT l_suppkey % 4 AS tile, CAST(l_partkey * 37 % 320 AS DOUBLE) AS px, CAST(l_orderkey * 11 % 320 AS DOUBLE) AS py FROM {lineitem}")
    return prepare.window_sizes(p, 64, 16, 5200, 5.0, 10.0)


TERRAIN = "SELECT l_suppkey % 3 AS tile, l_partkey * 7 % 40 * 2.5e0 + 1 AS x, l_orderkey * 13 % 40 * 2.5e0 + 1 AS y FROM {lineitem}"


@query("g19_triangulated_terrain")
def g19(spark, d):
    p = frame(spark, d, TERRAIN).dropDuplicates(["tile", "x", "y"]).withColumn("z", 0.01 * F.col("x") + 0.02 * F.col("y"))
    return terrain.interpolate_tiles(p, "tile", 20, 5.0, 75.0).select("tile", "row", "col", micro(F.col("z")).alias("z_micro"))


# -- routes ----------------------------------------------------------------------------

EDGES = "SELECT l_orderkey * 10 + l_linenumber AS eid, l_partkey % 120 AS u, l_suppkey * 3 % 120 AS v, l_quantity AS length, CASE l_partkey % 11 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway_foot FROM {lineitem} WHERE l_partkey % 120 <> l_suppkey * 3 % 120"
ARCS = f"edges AS ({EDGES}), arcs AS (SELECT eid, u, v, length FROM edges WHERE oneway_foot IS NULL OR oneway_foot <> '-1' UNION ALL SELECT eid, v, u, length FROM edges WHERE oneway_foot IS NULL OR oneway_foot IN ('no', '-1'))"


@query("i01_foot_adjacency", f"WITH {ARCS} SELECT eid, u, v FROM arcs")
def i01(spark, d):
    return routes.adjacency(frame(spark, d, EDGES)).select("eid", "u", "v")


# -- scenes ----------------------------------------------------------------------------


@query("i05_strata_retrieval", f"SELECT pid FROM (SELECT *, row_number() OVER (PARTITION BY x // 250, y // 250 ORDER BY sha256(CAST(pid AS VARCHAR))) AS turn, x // 250 AS sx, y // 250 AS sy FROM (SELECT pid, CAST(floor(x) AS BIGINT) AS x, CAST(floor(y) AS BIGINT) AS y FROM ({POINTS}))) WHERE turn <= 120 ORDER BY turn, sx, sy LIMIT 160")
def i05(spark, d):
    p = P(spark, d).select("pid", F.floor(F.col("x").cast("long") / 250).alias("sx"), F.floor(F.col("y").cast("long") / 250).alias("sy"))
    return ordered.round_robin(p, ["sx", "sy"], [F.sha2(F.col("pid").cast("string"), 256)], 160).select("pid")


@query("i12_edge_band", f"{GRID} SELECT CAST(least(col % 16, 15 - col % 16) AS INTEGER) AS band, count(*) AS cells, CAST(sum(dtm) AS BIGINT) AS total FROM grid GROUP BY 1")
def i12(spark, d):
    band = F.least(F.col("col") % 16, 15 - F.col("col") % 16)
    return G(spark).groupBy(band.cast("int").alias("band")).agg(n().alias("cells"), F.sum("dtm").cast("long").alias("total"))


@query("o14_quadrant_targets", f"{GRID} SELECT CAST(row // 32 AS INTEGER) AS qr, CAST(col // 32 AS INTEGER) AS qc, min(row * 64 + col) AS cell FROM grid WHERE occupancy = 0 AND row % 32 = 16 GROUP BY 1, 2")
def o14(spark, d):
    g = G(spark).filter("occupancy = 0 AND row % 32 = 16")
    return g.groupBy(grids.tile_key(F.col("row"), 32).alias("qr"), grids.tile_key(F.col("col"), 32).alias("qc")).agg(F.min(F.col("row") * 64 + F.col("col")).alias("cell"))

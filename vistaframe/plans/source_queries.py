"""Scans, packages, inventories, audits, routes and streams through the library's functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import audit, block_view, inventory, routes, sight, spatial, terrain
from ..session import shared_folder
from ..sources import contexts, grids, layers, osm, packages
from ..streaming import windows
from .audit_queries import BLD
from .base import frame, micro, micro_sql, query
from .prepare_queries import DIST, EDGES, KEEP, TARGETS, TERRAIN, _targets
from .sight_queries import DENSE, RADIUS, RES
from .sight_queries import TARGETS as VIEW_TARGETS
from .spatial_queries import BOXES, POINTS, B, P


def n():
    return F.count(F.lit(1))


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _array(*names: str):
    return F.array(*[F.lit(x) for x in names])


# -- vector, building and terrain scans ------------------------------------------------

SOURCES = """SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 4 WHEN 0 THEN 'a/b.dxf' WHEN 1 THEN 'a/b.shp' ELSE 'a/b.gpkg' END AS path,
  CASE WHEN p_partkey % 7 <> 0 THEN 'EPSG:5186' END AS crs, CASE p_partkey % 5 WHEN 0 THEN 'EPSG:5174' WHEN 1 THEN NULL ELSE 'EPSG:5186' END AS src_crs,
  CASE WHEN p_partkey % 3 = 0 THEN 'CP949' END AS encoding, CASE WHEN p_size % 6 = 0 THEN 'z' ELSE 'a' END AS layer, p_size % 2 AS cad FROM {part}"""


@query("s07_vector_layers", f"""SELECT id, CASE WHEN crs IS NULL THEN 'no CRS declared' WHEN src_crs <> crs THEN 'the CRS differs from the declared one'
  WHEN path LIKE '%.shp' AND encoding IS NULL THEN 'no encoding declared' WHEN path LIKE '%.dxf' AND cad = 0 THEN 'a drawing needs cad_layers' WHEN layer = 'z' THEN 'no such layer' END AS problem FROM ({SOURCES})""")
def s07(spark, d):
    rows = frame(spark, d, SOURCES).withColumn("layers", _array("a", "b")).withColumn("cad_layers", F.when(F.col("cad") == 1, _array("roads")))
    return rows.select("id", layers.declared(rows).alias("problem"))


@query("s10_file_fingerprints")
def s10(spark, d):
    """Two sources with their sidecars, by name without the folder."""
    files = contexts.fingerprints(spark, f"{d}/region.parquet").unionByName(contexts.fingerprints(spark, f"{d}/nation.parquet"))
    out = layers.sidecars(files)
    return out.select(F.element_at(F.split("stem", "/"), -1).alias("source"), "files", "bytes", "sha256")


@query("s11_bbox_pruned_scan", "SELECT l_orderkey AS id FROM {lineitem} WHERE l_partkey BETWEEN 100 AND 140 AND l_suppkey BETWEEN 10 AND 40")
def s11(spark, d):
    rows, _, _ = layers.pruned(spark, f"{d}/lineitem.parquet", {"l_partkey": (100, 140), "l_suppkey": (10, 40)})
    return rows.select(F.col("l_orderkey").alias("id"))


BUILT = """SELECT CAST(p_partkey AS BIGINT) AS source_id, 126.8e0 + (p_partkey * 37 % 1000) / 2500e0 AS x0, 37.4e0 + (p_partkey * 53 % 1000) / 3000e0 AS y0,
  2e-4 + (p_size % 5) * 1e-4 AS w, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN -1e0 ELSE CAST(p_size AS DOUBLE) END AS height, CAST(p_size % 3 AS DOUBLE) AS var FROM {part}"""


def _rings(spark, d):
    c = F.col
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1 = c("x0") + c("w"), c("y0") + c("w")
    ring = F.array(at(c("x0"), c("y0")), at(x1, c("y0")), at(x1, y1), at(c("x0"), y1), at(c("x0"), c("y0")))
    box = F.struct(c("x0").alias("xmin"), c("y0").alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))
    return frame(spark, d, BUILT).withColumn("ring", ring).withColumn("bbox", box)


_X, _Y = geo.to_plane_sql("x0", "y0")


@query("s14_building_scan", f"SELECT source_id, CASE WHEN height > 0 THEN height END AS height_m, var AS height_var, NOT coalesce(height > 0, FALSE) AS unresolved, CAST(floor(({_X}) * 1000 + 0.5) AS BIGINT) AS x_mm, CAST(floor(({_Y}) * 1000 + 0.5) AS BIGINT) AS y_mm FROM ({BUILT}) WHERE x0 <= 127.1 AND y0 <= 37.65 AND x0 + w >= 126.85 AND y0 + w >= 37.45")
def s14(spark, d):
    out = layers.footprints(_rings(spark, d), (126.85, 37.45, 127.1, 37.65))
    mm = lambda v: F.floor(F.get("plane", F.lit(0))[v] * 1000 + F.lit(0.5)).cast("long").alias(f"{v}_mm")
    return out.select("source_id", "height_m", "height_var", "unresolved", mm("x"), mm("y"))


@query("f26_building_rows", "SELECT CAST(p_partkey AS BIGINT) AS source_id, CASE WHEN p_partkey % 13 = 0 THEN 'not a polygon' WHEN p_partkey % 17 = 0 THEN 'coordinates' WHEN p_partkey % 11 = 0 THEN 'box' END AS problem FROM {part}")
def f26(spark, d):
    """Rows with an open ring, a far place, or a box that is a millionth of a degree off."""
    rows, i = _rings(spark, d), F.col("source_id")
    far = F.when(i % 17 == 0, 20.0).otherwise(0.0)
    ring = F.transform("ring", lambda p: F.struct((p["x"] + far).alias("x"), p["y"].alias("y")))
    ring = F.when(i % 13 == 0, F.slice(ring, 1, 4)).otherwise(ring)
    box = F.struct((F.col("bbox.xmin") + far + F.when(i % 11 == 0, 1e-6).otherwise(0.0)).alias("xmin"), "bbox.ymin", (F.col("bbox.xmax") + far).alias("xmax"), "bbox.ymax")
    return rows.select("source_id", ring.alias("ring"), box.alias("bbox")).select("source_id", layers.footprint_problem().alias("problem"))


OLD_GRID = "SELECT l_orderkey * 10 + l_linenumber AS UFID, l_quantity AS CONT, 180000e0 + l_partkey * 37 % 40000 AS x, 440000e0 + l_suppkey * 91 % 30000 AS y FROM {lineitem}"


@query("s16_terrain_projection")
def s16(spark, d):
    rows = frame(spark, d, OLD_GRID)
    out = layers.terrain(rows, "EPSG:5174", "CONT", rows.count())
    return out.select("source_id", "elevation_m", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("s16_terrain_report", f"SELECT count(*) AS features, count(*) - count(DISTINCT UFID) AS duplicate_ids, min(CONT) AS low, max(CONT) AS high FROM ({OLD_GRID})")
def s16_report(spark, d):
    rows = frame(spark, d, OLD_GRID)
    return layers.terrain_report(layers.terrain(rows, "EPSG:5174", "CONT", rows.count())).select("features", "duplicate_ids", "low", "high")


# -- map features ----------------------------------------------------------------------

#: Orders as ways (each fourth closed), customers as nodes (some nodes of ways are missing).
WAY_NODES = """SELECT way, pos, CASE WHEN way % 4 = 0 AND pos = top AND pos > 1 THEN head ELSE node END AS node FROM (
  SELECT l_orderkey AS way, l_partkey AS node, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS top,
    first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS head FROM {lineitem})"""
PLACES = "SELECT CAST(c_custkey AS BIGINT) AS node, 126.8e0 + (c_custkey * 37 % 1000) / 2500e0 AS lon, 37.4e0 + (c_custkey * 53 % 1000) / 3000e0 AS lat FROM {customer}"
WAY_KIND = "SELECT DISTINCT l_orderkey AS way, l_orderkey % 6 AS kind, l_orderkey % 8 = 1 AS area FROM {lineitem}"
RELATIONS = "SELECT CAST(o_custkey AS BIGINT) AS rel, o_orderkey AS way, o_custkey % 10 = 0 AS water FROM {orders} WHERE o_custkey % 5 = 0"
_MAP = f"""WITH place AS ({PLACES}), vertex AS (SELECT w.*, p.node IS NULL AS lost FROM ({WAY_NODES}) w LEFT JOIN place p USING (node)),
way AS (SELECT way, count(*) AS size, count(*) FILTER (lost) AS lost, arg_min(node, pos) AS a, arg_max(node, pos) AS b FROM vertex GROUP BY way),
known AS (SELECT k.*, size, lost, a, b, CASE kind WHEN 0 THEN 'water' WHEN 1 THEN CASE WHEN area THEN 'public_spaces' ELSE 'paths' END WHEN 2 THEN 'green_space' WHEN 3 THEN 'water' WHEN 4 THEN 'barriers' END AS layer,
  a <> b OR (kind IN (1, 3, 4) AND NOT area) AS as_line FROM ({WAY_KIND}) k JOIN way USING (way) WHERE kind <> 5),
shape AS (SELECT *, CASE WHEN lost > 0 OR size < 2 OR (NOT as_line AND size < 4) THEN 'issue' WHEN as_line THEN 'line' ELSE 'area' END AS form FROM known),
member AS (SELECT r.rel, r.water, r.way, w.size, w.lost, w.a, w.b FROM ({RELATIONS}) r LEFT JOIN way w USING (way)),
ends AS (SELECT rel, v, count(*) AS deg FROM (SELECT rel, a AS v FROM member WHERE a <> b UNION ALL SELECT rel, b FROM member WHERE a <> b) GROUP BY rel, v),
built AS (SELECT rel, any_value(water) AS water, bool_and(coalesce(lost = 0 AND size >= 2, FALSE)) AND coalesce((SELECT bool_and(deg = 2) FROM ends e WHERE e.rel = m.rel), TRUE) AS complete, sum(size) AS points FROM member m GROUP BY rel)"""


def _map(spark, d):
    kinds = frame(spark, d, WAY_KIND)
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    pairs = [F.when(F.col("kind") == i, tag(*kv)) for i, kv in enumerate((("natural", "water"), ("highway", "footway"), ("landuse", "forest"), ("waterway", "river"), ("barrier", "wall"), ("power", "line")))]
    tags = F.map_from_entries(F.array_compact(F.array(*pairs, F.when(F.col("area"), tag("area", "yes")))))
    ways = kinds.select("way", tags.alias("tags"))
    peak = F.when(F.col("node") % 50 == 0, F.create_map(F.lit("natural"), F.lit("peak"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = frame(spark, d, PLACES).withColumn("tags", peak)
    rows = frame(spark, d, RELATIONS)
    kind = F.create_map(F.lit("type"), F.lit("multipolygon"), F.when(F.col("water"), "natural").otherwise("landuse"), F.when(F.col("water"), "water").otherwise("forest"))
    relations = rows.select("rel", "water").distinct().select("rel", kind.alias("tags"))
    members = rows.select("rel", "way", F.lit("outer").alias("role"))
    return nodes, ways, frame(spark, d, WAY_NODES), relations, members


@query("s15_objects_to_layers", f"""{_MAP}, every AS (
  SELECT 'peaks_ridges' AS layer, 'point' AS kind, 1 AS points FROM place WHERE node % 50 = 0 UNION ALL SELECT 'landmarks', 'point', 1 FROM place WHERE node % 50 = 0
  UNION ALL SELECT CASE WHEN form = 'issue' THEN 'quality' ELSE layer END, form, size FROM shape
  UNION ALL SELECT CASE WHEN NOT complete THEN 'quality' WHEN water THEN 'water' ELSE 'green_space' END, CASE WHEN complete THEN 'area' ELSE 'issue' END, CASE WHEN complete THEN points END FROM built)
SELECT layer, kind, count(*) AS features, CAST(coalesce(sum(points), 0) AS BIGINT) AS points FROM every WHERE layer <> 'paths' OR kind = 'line' GROUP BY layer, kind""")
def s15(spark, d):
    return osm.features(*_map(spark, d)).groupBy("layer", "kind").agg(n().alias("features"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))


@query("s15_relation_report", f"{_MAP} SELECT count(*) AS expected, count(*) FILTER (complete) AS assembled, coalesce(bool_and(complete), TRUE) AS geometry_complete FROM built")
def s15_report(spark, d):
    nodes, _, way_nodes, relations, members = _map(spark, d)
    return osm.relation_report(relations, osm.relation_shapes(relations, members, osm.lines(nodes, way_nodes)))


# -- packages and reports --------------------------------------------------------------

ARTIFACTS = "SELECT 'part/' || p_brand AS name, p_partkey AS k FROM {part}"
MANIFEST = f"SELECT name, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM (SELECT name, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS body FROM ({ARTIFACTS}) GROUP BY name)"


def _artifacts(spark, d):
    body = F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: k.cast("string")), ",")
    return frame(spark, d, ARTIFACTS).groupBy("name").agg(body.cast("binary").alias("body"))


@query("k04_package_manifest", f"SELECT name, bytes, sha256, CASE WHEN name LIKE '%#1_' AND name LIKE '%2' THEN 'no receipt' WHEN name LIKE '%#3' THEN 'checksum mismatch' END AS problem FROM ({MANIFEST})")
def k04(spark, d):
    """Artifacts against their receipts, of which one kind is missing and one has another checksum."""
    files = _artifacts(spark, d)
    made = packages.manifest(files).filter(~F.col("name").like("%#1_") | ~F.col("name").like("%2"))
    receipts = made.select("name", F.when(F.col("name").like("%#3"), F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("receipt"))
    return packages.checked(files, receipts)


@query("k04_package_publish", f"SELECT 'v1-' || substring(sha256(string_agg(name || ' ' || sha256, chr(10) ORDER BY name)), 1, 12) AS package, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, 0 AS problems FROM ({MANIFEST})")
def k04_publish(spark, d):
    files = _artifacts(spark, d)
    receipts = packages.manifest(files).select("name", F.col("sha256").alias("receipt"))
    path = packages.publish(files, receipts, "v1", _folder(spark, "packages"))
    back = spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/manifest")
    bad = packages.validated(spark, path).agg(F.count(F.lit(1)).cast("int").alias("problems"))
    return back.agg(F.lit(path.rsplit("/", 1)[-1]).alias("package"), n().alias("files"), F.sum("bytes").alias("bytes")).join(F.broadcast(bad))


@query("k06_run_report", "SELECT l_returnflag AS kind, count(*) AS runs, min(l_quantity) AS low, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.95) AS p95, max(l_quantity) AS high FROM {lineitem} GROUP BY 1")
def k06(spark, d):
    runs = frame(spark, d, "SELECT l_returnflag AS kind, CAST(l_quantity AS DOUBLE) AS seconds FROM {lineitem}")
    return packages.run_report(runs, ["kind"], "seconds", _folder(spark, "report"))


MARKS = "SELECT l_orderkey AS scene, CAST(l_linenumber AS INTEGER) AS pos, CAST(l_partkey * 13 % 360 AS DOUBLE) AS bearing, CASE WHEN l_suppkey % 8 <> 0 THEN (l_suppkey % 61) * 0.25e0 - 7 END AS elevation, CAST(l_linenumber % 4 AS INTEGER) AS state, CAST(l_orderkey % 360 AS DOUBLE) AS centre, 58e0 AS fov FROM {lineitem}"


@query("k08_schematic", f"""SELECT scene, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 230" role="img">' || string_agg(mark, '' ORDER BY pos, mark) || '</svg>' AS svg FROM (
  SELECT scene, pos, printf('<path d="M%.1f 180V%.1f" stroke="%s" stroke-width="3"/><circle cx="%.1f" cy="%.1f" r="4" fill="%s"/>', px, py, colour, px, py, colour) AS mark FROM (
    SELECT scene, pos, 320 + turn / fov * 580 AS px, greatest(28e0, least(192e0, 160 - coalesce(elevation, 0) * 4)) AS py, CASE state WHEN 0 THEN '#9e7061' WHEN 1 THEN '#225c48' ELSE '#8d9091' END AS colour FROM (
      SELECT *, (bearing - centre + 180) - 360 * floor((bearing - centre + 180) / 360) - 180 AS turn FROM ({MARKS})))) GROUP BY scene""")
def k08(spark, d):
    return inventory.schematic(frame(spark, d, MARKS).withColumnRenamed("pos", "at"), "scene")


# -- guards and inventories ------------------------------------------------------------

NAMES = {"nation": ("n_nationkey", "n_name"), "region": ("r_regionkey", "r_name"), "supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name")}
_FOUND = " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS layer, CAST({k} AS BIGINT) AS id, {v} AS name FROM {{{t}}} WHERE lower({v}) LIKE '%an%' ORDER BY {k} LIMIT 25)" for i, (t, (k, v)) in enumerate(NAMES.items()))


@query("f29_name_search", f"SELECT name, CAST(layer AS INTEGER) AS layer, CAST(place AS INTEGER) AS place FROM (SELECT name, layer, row_number() OVER (ORDER BY layer, id, name) AS place FROM (SELECT name, layer, id, row_number() OVER (PARTITION BY name ORDER BY layer, id) AS r FROM ({_FOUND})) WHERE r = 1) WHERE place <= 20")
def f29(spark, d):
    rows = [frame(spark, d, f"SELECT {k} AS id, {v} AS name FROM {{{t}}}") for t, (k, v) in NAMES.items()]
    return inventory.places(rows, " AN ")


VIEWPORTS = "SELECT o_orderkey AS id, 123.5e0 + (o_custkey % 70) / 10e0 AS west, 123.5e0 + (o_custkey % 70) / 10e0 + (o_orderkey % 40) / 10e0 - 0.2 AS east, 31.8e0 + (o_custkey % 90) / 10e0 AS south, CASE WHEN o_orderkey % 31 <> 0 THEN 31.8e0 + (o_custkey % 90) / 10e0 + (o_orderkey % 37) / 10e0 - 0.2 END AS north, CAST(o_orderkey % 23 AS DOUBLE) AS zoom FROM {orders}"


@query("f30_viewport_check", f"SELECT id, CASE WHEN north IS NULL THEN 'not finite' WHEN NOT (west >= 124 AND west < east AND east <= 130 AND south >= 32 AND south < north AND north <= 40) THEN 'outside the country' WHEN east - west > 3 OR north - south > 3 THEN 'too wide' WHEN NOT zoom BETWEEN 8 AND 19 THEN 'zoom' END AS error FROM ({VIEWPORTS})")
def f30(spark, d):
    return frame(spark, d, VIEWPORTS).select("id", inventory.viewport_error().alias("error"))


@query("f32_geometry_contract", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'crs' WHEN s_suppkey % 7 = 0 OR s_suppkey % 5 = 0 THEN 'polygon' WHEN s_suppkey % 11 = 0 THEN 'coordinates' END AS problem FROM {supplier}")
def f32(spark, d):
    """Geometries with another CRS, of another kind, with an open ring, or beyond the pole."""
    i = F.col("id")
    north = F.when(i % 11 == 0, 95.0).otherwise(37.6)
    at = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    ring = F.array(at(126.9, F.lit(37.5)), at(127.1, F.lit(37.5)), at(127.1, north), at(126.9, F.lit(37.5)))
    rows = frame(spark, d, "SELECT CAST(s_suppkey AS BIGINT) AS id FROM {supplier}").select(
        "id", F.when(i % 9 == 0, "EPSG:5186").otherwise("EPSG:4326").alias("crs"), F.when(i % 7 == 0, "LineString").otherwise("Polygon").alias("kind"), F.when(i % 5 == 0, F.slice(ring, 1, 3)).otherwise(ring).alias("ring")
    )
    return rows.select("id", inventory.geometry_contract().alias("problem"))


@query("i06_target_bands", f"SELECT category, outer_ AS \"outer\", CAST(quadrant AS INTEGER) AS quadrant, count(*) AS targets, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY category, outer_, quadrant ORDER BY dist, id) AS turn FROM (SELECT *, {DIST} > 1200 AS outer_, {DIST} AS dist, CASE WHEN y >= 2500 THEN CASE WHEN x >= 2500 THEN 0 ELSE 3 END WHEN x >= 2500 THEN 1 ELSE 2 END AS quadrant FROM ({TARGETS}) WHERE {KEEP})) WHERE turn <= 50 GROUP BY 1, 2, 3")
def i06(spark, d):
    t = _targets(spark, d).withColumn("dx", F.col("x") - 2500).withColumn("dy", F.col("y") - 2500)
    got = inventory.inventory(t, 1200.0, 2000.0, 50, [F.col("metres"), F.col("id")])
    return got.groupBy("category", "outer", "quadrant").agg(n().alias("targets"), F.sum("id").alias("ids"))


# -- joins -----------------------------------------------------------------------------


@query("j03_left_outer_extents", f"SELECT p.pid, b.sid IS NULL AS missing, coalesce(minx <= 900 AND 0 <= maxx AND miny <= 900 AND 0 <= maxy, FALSE) AS meets FROM ({POINTS}) p LEFT JOIN ({BOXES}) b ON b.sid = p.pid")
def j03(spark, d):
    rows = spatial.with_extents(P(spark, d).select("pid"), B(spark, d).withColumnRenamed("sid", "pid"), "pid", strict=False)
    v = F.lit
    meets = spatial.overlaps(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), v(0.0), v(0.0), v(900.0), v(900.0))
    return rows.select("pid", F.col("extent_missing").alias("missing"), F.coalesce(meets, F.lit(False)).alias("meets"))


FEW = f"SELECT sid, k, minx + (maxx - minx) * k / 10 AS tx FROM ({BOXES}), (VALUES (3), (5), (7)) t(k) WHERE sid BETWEEN 1 AND 5"


@query("j17_bounded_product", f"SELECT pid, sid, CAST(k AS INTEGER) AS k, x < tx AS west FROM ({POINTS}), ({FEW})")
def j17(spark, d):
    """Every observer with every sample of five target groups."""
    groups = B(spark, d).filter(F.col("sid").between(1, 5)).withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(7))))
    few = groups.select("sid", "k", (F.col("minx") + (F.col("maxx") - F.col("minx")) * F.col("k") / 10).alias("tx"))
    return spatial.bounded_product(P(spark, d), few, 100).select("pid", "sid", "k", (F.col("x") < F.col("tx")).alias("west"))


@query("g29_point_box_distance", f"SELECT p.pid, {micro_sql('min(sqrt(pow(greatest(minx - x, 0, x - maxx), 2) + pow(greatest(miny - y, 0, y - maxy), 2)))')} AS metres_micro FROM ({POINTS}) p, ({BOXES}) b GROUP BY p.pid")
def g29(spark, d):
    return spatial.nearest_box(P(spark, d), B(spark, d), 50.0, "pid", "sid").select("pid", micro(F.col("metres")).alias("metres_micro"))


BUFFERS = {"city": 0.0, "recommendation": 1000.0, "support": 10_000.0}


@query("g37_buffered_extents", f"SELECT name, minx - v AS minx, miny - v AS miny, maxx + v AS maxx, maxy + v AS maxy, {micro_sql('((maxx - minx) * (maxy - miny) + 2 * v * (maxx - minx + maxy - miny) + pi() * v * v) / 1e6')} AS area_m2 FROM (SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM ({BOXES})), (VALUES ('city', 0e0), ('recommendation', 1000e0), ('support', 10000e0)) t(name, v)")
def g37(spark, d):
    return spatial.buffered_extents(B(spark, d), BUFFERS).withColumn("area", micro(F.col("area") / 1e6)).withColumnRenamed("area", "area_m2")


@query("g38_processing_extents", f"WITH {grids.SYNTHETIC_SQL}, a AS (SELECT *, out_mask = 1 AS city, row BETWEEN 2 AND 61 AS support FROM grid) SELECT name, min(row) AS first_row, max(row) AS last_row, min(col) AS first_col, max(col) AS last_col, 25 * count(*) AS area_m2 FROM (SELECT 'city' AS name, * FROM a WHERE city UNION ALL SELECT 'support', * FROM a WHERE support UNION ALL SELECT 'uncovered', * FROM a WHERE city AND NOT support) GROUP BY name")
def g38(spark, d):
    city, support = F.col("out_mask") == 1, F.col("row").between(2, 61)
    names = F.array_compact(F.array(F.when(city, "city"), F.when(support, "support"), F.when(city & ~support, "uncovered")))
    return grids.synthetic(spark).withColumn("name", F.explode(names)).groupBy("name").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), (25 * n()).alias("area_m2"))


# -- audits ----------------------------------------------------------------------------

CALLS = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(ceil(o_totalprice) AS BIGINT) AS micro_usd, o_orderpriority LIKE '1%' AS is_image FROM {orders}"


@query("a27_daily_ledger", f"SELECT *, CASE WHEN used > 900000 THEN 'daily_spending_exhausted' WHEN calls > 6 OR images > 1 THEN 'daily_request_cap_exhausted' END AS over FROM (SELECT day, CAST(sum(micro_usd) AS BIGINT) AS used, count(*) AS calls, count(*) FILTER (is_image) AS images FROM ({CALLS}) GROUP BY day)")
def a27(spark, d):
    calls = frame(spark, d, "SELECT o_orderdate, CAST(ceil(o_totalprice) AS BIGINT) AS micro_usd, o_orderpriority LIKE '1%' AS is_image FROM {orders}")
    return audit.ledger(calls, F.date_format("o_orderdate", "yyyy-MM-dd"), 900_000, 6, 1)


@query("a33_sampled_rows_match", f"SELECT id, CASE WHEN id % 7 = 0 THEN 'missing' WHEN id % 11 = 0 AND height IS NOT NULL THEN 'changed' END AS problem FROM ({BLD}) ORDER BY md5('m:' || id), id LIMIT 64")
def a33(spark, d):
    """A seeded sample against a stored table that lost some rows and changed others."""
    source = frame(spark, d, BLD)
    stored = source.filter("id % 7 <> 0").withColumn("height", F.when(F.col("id") % 11 == 0, F.col("height") + 1).otherwise(F.col("height")))
    return audit.sampled_mismatches(source, stored, "id", ["height", "source"])


CUT = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(min(l_quantity) AS DOUBLE) AS z, CAST(count(*) + 2 AS BIGINT) AS vertices, min(l_suppkey) % 3 AS region FROM {lineitem} GROUP BY 1"


@query("a34_subset_unchanged", f"SELECT count(*) AS kept, count(*) FILTER (id % 90 = 1) AS foreign, count(*) FILTER (id % 50 = 2 AND id % 90 <> 1) AS changed, CAST(sum(CASE WHEN id % 40 = 3 AND id % 90 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS vertices_lost, min(z + CASE WHEN id % 50 = 2 THEN 0.5 ELSE 0 END) AS low, max(z + CASE WHEN id % 50 = 2 THEN 0.5 ELSE 0 END) AS high FROM ({CUT}) WHERE region = 0")
def a34(spark, d):
    """A subset with rows of another table, moved elevations and lost vertices."""
    before, i = frame(spark, d, CUT), F.col("id")
    after = before.filter("region = 0").withColumn("z", F.col("z") + F.when(i % 50 == 2, 0.5).otherwise(0.0)).withColumn("vertices", F.col("vertices") - F.when(i % 40 == 3, 1).otherwise(0))
    return audit.subset_changes(before, after.withColumn("id", F.when(i % 90 == 1, -i).otherwise(i)), "id", "z", "vertices")


@query("g34_model_disagreement", f"SELECT count(*) AS cells, count(*) FILTER (a.state = 1 AND b.state = 0) AS false_visible, count(*) FILTER (a.state = 0 AND b.state = 1) AS false_blocked, count(*) FILTER (a.state IS NULL OR b.state IS NULL) AS missing FROM ({DENSE} SELECT * FROM dense) a FULL JOIN ({DENSE.replace('dtm + 1.7::DOUBLE', 'dtm + 6.7::DOUBLE')} SELECT * FROM dense WHERE row <> 30) b USING (target_id, row, col)")
def g34(spark, d):
    """States of two models, one with a higher eye and without one row of cells."""
    cells, targets = grids.synthetic(spark), frame(spark, d, VIEW_TARGETS)
    one = block_view.viewshed(cells, targets, RADIUS, RES, rows=4096)
    two = block_view.viewshed(cells, targets, RADIUS, RES, eye=6.7, rows=4096).filter("row <> 30")
    return audit.disagreement(one, two, ["target_id", "row", "col"])


@query("g35_outside_invariance", "SELECT 0 AS differences, TRUE AS sees_inside")
def g35(spark, d):
    """Cells beyond a target's region change no state; a wall within it does."""
    cells = grids.synthetic(spark)
    away = F.sqrt(F.pow(F.col("row") - 32, 2) + F.pow(F.col("col") - 32, 2))
    target = spark.range(1).select(F.lit(1).alias("target_id"), F.lit(32).alias("trow"), F.lit(32).alias("tcol"), F.lit(50.0).alias("tz"))

    def states(where):
        changed = cells.withColumn("surface", F.when(where, F.lit(500.0)).otherwise(F.col("surface")))
        return block_view.viewshed(changed, target, 60.0, 5.0, rows=4096)

    one = sight.viewshed(cells, target, 60.0, 5.0, rows=4096)
    out, inner = (states(w).withColumnRenamed("state", name) for w, name in ((away > 14, "outside"), ((away > 3) & (away < 5), "inside")))
    both = one.join(out, ["target_id", "row", "col"]).join(inner, ["target_id", "row", "col"])
    return both.agg(F.count_if(F.col("state") != F.col("outside")).cast("int").alias("differences"), (F.count_if(F.col("state") != F.col("inside")) > 20).alias("sees_inside"))


TILES = f"WITH {grids.SYNTHETIC_SQL}, c AS (SELECT row, col, surface, unnest(range(CAST(floor((row - 2) / 16.0) AS BIGINT), CAST(floor((row + 2) / 16.0) AS BIGINT) + 1)) AS tr FROM grid), k AS (SELECT *, unnest(range(CAST(floor((col - 2) / 16.0) AS BIGINT), CAST(floor((col + 2) / 16.0) AS BIGINT) + 1)) AS tc FROM c), made AS (SELECT tr * 100 + tc AS tile, row, col, surface + ((tr * 7 + tc * 3) - 5 * floor((tr * 7 + tc * 3) / 5.0)) * 0.5 AS v FROM k)"


@query("i11_overlap_audit", f"{TILES} SELECT CAST(a.tile AS BIGINT) AS one, CAST(b.tile AS BIGINT) AS other, count(*) AS shared, count(*) FILTER (a.v - b.v IS NULL) AS missing, count(*) FILTER (abs(a.v - b.v) > 0) AS over_0, count(*) FILTER (abs(a.v - b.v) > 1) AS over_1 FROM made a JOIN made b ON a.row = b.row AND a.col = b.col AND a.tile <> b.tile GROUP BY 1, 2")
def i11(spark, d):
    """Products that every tile made of its halo too, each with an offset of its own."""
    t = grids.haloed_cells(grids.synthetic(spark), 16, 2)
    own = F.pmod(F.col("tile_row") * 7 + F.col("tile_col") * 3, F.lit(5)) * 0.5
    made = t.select((F.col("tile_row") * 100 + F.col("tile_col")).cast("long").alias("tile"), "row", "col", (F.col("surface") + own).alias("v"))
    return audit.overlap(made, "tile", "v", [0, 1])


@query("g20_seam_probes")
def g20(spark, d):
    """Neighbouring tiles at the same coordinates of their seam, each by its own samples."""
    p = frame(spark, d, TERRAIN).dropDuplicates(["tile", "x", "y"]).withColumn("x", F.col("x") + 50 * F.col("tile")).withColumn("z", 0.01 * F.col("x") + 0.02 * F.col("y"))
    probes = spark.range(40).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("one"), F.col("id").alias("probe"))
    seams = probes.select("one", (F.col("one") + 1).alias("other"), "probe", (75.0 + 50 * F.col("one")).alias("x"), (F.col("probe") * 2.5).alias("y"))
    tiles = p.withColumn("tile", F.col("tile").cast("long"))
    return terrain.seam_gaps(tiles, seams, "tile", 75.0).withColumn("gap", micro(F.col("gap"))).withColumnRenamed("gap", "gap_micro")


# -- routes ----------------------------------------------------------------------------

_THIN = f"edges AS ({EDGES}), arcs AS (SELECT eid, u, v, length FROM edges WHERE oneway_foot IS NULL OR oneway_foot <> '-1' UNION ALL SELECT eid, v, u, length FROM edges WHERE oneway_foot IS NULL OR oneway_foot IN ('no', '-1')), thin AS (SELECT u, v, CAST(t.length AS DOUBLE) AS length, t.eid AS eid FROM (SELECT u, v, min(struct_pack(length := length, eid := eid)) AS t FROM arcs GROUP BY u, v))"
_BEST = f"WITH RECURSIVE {_THIN}, best(node, cost) USING KEY (node) AS (SELECT CAST(5 AS BIGINT), 0e0 UNION SELECT t.v, min(w.cost + t.length) FROM best w JOIN thin t ON t.u = w.node LEFT JOIN recurring.best r ON r.node = t.v WHERE r.cost IS NULL OR w.cost + t.length < r.cost GROUP BY t.v)"


def _cheapest(spark, d):
    arcs = routes.adjacency(frame(spark, d, EDGES)).groupBy("u", "v").agg(F.min(F.struct("length", "eid")).alias("b")).select("u", "v", "b.*")
    start = spark.range(1).select(F.lit(5).cast("long").alias("node"), F.lit(0.0).alias("cost"))
    return routes.shortest(arcs, start)


@query("i02_shortest_paths", f"{_BEST} SELECT node, CAST(cost AS BIGINT) AS cost FROM best")
def i02(spark, d):
    return _cheapest(spark, d).select("node", F.col("cost").cast("long").alias("cost"))


@query("i03_route_back_trace", f"""{_BEST}, up AS (SELECT node, p.u AS parent, p.e AS edge FROM (SELECT t.v AS node, min(struct_pack(u := t.u, e := t.eid)) AS p FROM thin t JOIN best a ON a.node = t.u JOIN best b ON b.node = t.v WHERE a.cost + t.length = b.cost AND t.v <> 5 GROUP BY t.v)),
trail AS (SELECT node AS "end", 0 AS pos, node FROM best UNION ALL SELECT "end", pos + 1, up.parent FROM trail JOIN up USING (node))
SELECT t."end", count(*) AS nodes, string_agg(CAST(t.node AS VARCHAR), ',' ORDER BY pos) AS path, coalesce(bool_or(up.edge % 7 = 0), FALSE) AS stairs, count(up.edge) AS edges, count(up.edge) FILTER (up.edge % 3 <> 0) AS unknown_access,
  floor(any_value(b.cost) / 66.67e0 * 10 + 0.5e0) / 10 AS minutes, CAST(arg_max(t.node, pos) AS BIGINT) AS first_node FROM trail t LEFT JOIN up USING (node) JOIN best b ON b.node = t."end" GROUP BY t."end" """)
def i03(spark, d):
    """Routes with stairs, unverified edges and geometry (of which the first point's node is shown)."""
    best = _cheapest(spark, d)
    path = routes.back_trace(best, best.select("node"))
    nodes = best.select("node", F.col("node").cast("double").alias("lon"), F.lit(37.5).alias("lat"))
    edges = frame(spark, d, EDGES).select("eid", (F.col("eid") % 7 == 0).alias("steps"), F.when(F.col("eid") % 3 == 0, "verified").otherwise("unknown").alias("access_status")).distinct()
    about = routes.described(path, best, nodes, edges)
    per = path.groupBy("end").agg(n().alias("nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda p: p["node"].cast("string")), ",").alias("path"))
    return per.join(about.select("end", "stairs", "edges", "unknown_access", "minutes", F.get("geometry", F.lit(0))["lon"].cast("long").alias("first_node")), "end")


# -- streams ---------------------------------------------------------------------------


def _events(spark, d):
    return windows.read_events(spark, f"{d}/events.parquet")


@query("st_daily_spend", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(floor(sum(value) + 0.5) AS BIGINT) AS spent, count(*) AS calls, sum(value) > 1000 AS over FROM {events} GROUP BY 1")
def st_daily(spark, d):
    out = windows.drained(windows.daily_spend(_events(spark, d), "value", 1000.0))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.floor(F.col("spent") + 0.5).alias("spent"), "calls", "over")


@query("st_sliding_rate", "SELECT user_id, CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 - 10 * k AS start, count(*) AS calls FROM {events}, range(6) t(k) GROUP BY 1, 2")
def st_rate(spark, d):
    steps = windows.drained(windows.sliding_rate(_events(spark, d), "user_id", "10 seconds", "10 seconds"))
    out = windows.slid(steps, "user_id")
    return out.select("user_id", F.unix_seconds("start").alias("start"), "calls")


@query("st_sessions", "SELECT user_id, min(us) AS start, max(us) + 3600000000 AS stop, count(*) AS views FROM (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM {events})) GROUP BY user_id, s")
def st_sessions(spark, d):
    out = windows.drained(windows.sessions(_events(spark, d), "user_id"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "views")


VISITS = "SELECT CAST(c_custkey AS BIGINT) AS user_id, TIMESTAMP '2024-01-05 12:00:00' + c_custkey % 400 * INTERVAL 1 HOUR AS visit_at FROM {customer}"


@query("st_current_observations", f"SELECT user_id, count(*) AS current FROM {{events}} JOIN ({VISITS}) USING (user_id) WHERE ts <= visit_at AND ts >= visit_at - INTERVAL 2 HOUR GROUP BY user_id")
def st_current(spark, d):
    visits = frame(spark, d, "SELECT CAST(c_custkey AS BIGINT) AS user_id, TIMESTAMP '2024-01-05 12:00:00' + make_dt_interval(0, CAST(c_custkey % 400 AS INT)) AS visit_at FROM {customer}")
    rows = windows.drained(windows.current_observations(_events(spark, d), visits, "user_id"), "append")
    return rows.groupBy("user_id").agg(n().alias("current"))

"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scores, tags
from .base import frame, micro, micro_sql, query

SPOTS = """
SELECT CAST(p_partkey AS BIGINT) AS id, 126.9e0 + (p_partkey * 37 % 1000) / 1e4 AS lon, 37.5e0 + (p_partkey * 53 % 1000) / 1e4 AS lat,
  CAST((p_partkey * 17 % 721) - 360 AS DOUBLE) AS dx, CAST((p_partkey * 29 % 641) - 320 AS DOUBLE) AS dy,
  CAST(p_size AS DOUBLE) AS size, p_retailprice AS price
FROM {part}"""
HAV = lambda a, b, c, d: f"2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2))))"
MOD = lambda x, m: f"(({x}) - {m} * floor(({x}) / {m}))"
BEAR = lambda a, b, c, d: MOD(f"degrees(atan2(sin(radians({c}) - radians({a})) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c}) - radians({a}))))", "360e0")


def S(spark, d):  # noqa: N802
    return frame(spark, d, SPOTS)


@query("m01_haversine", f"SELECT id, {micro_sql(HAV('lon', 'lat', '126.978e0', '37.571e0'))} AS metres_micro FROM ({SPOTS})")
def m01(spark, d):
    return S(spark, d).select("id", micro(geo.haversine(F.col("lon"), F.col("lat"), F.lit(126.978), F.lit(37.571))).alias("metres_micro"))


@query("m02_initial_bearing", f"SELECT id, {micro_sql(BEAR('lon', 'lat', '126.978e0', '37.571e0'))} AS bearing_micro FROM ({SPOTS})")
def m02(spark, d):
    return S(spark, d).select("id", micro(geo.initial_bearing(F.col("lon"), F.col("lat"), F.lit(126.978), F.lit(37.571))).alias("bearing_micro"))


@query("m03_planar_bearing", f"SELECT id, {micro_sql(MOD('degrees(atan2(dx, dy))', '360e0'))} AS bearing_micro FROM ({SPOTS})")
def m03(spark, d):
    return S(spark, d).select("id", micro(geo.planar_bearing(F.col("dx"), F.col("dy"))).alias("bearing_micro"))


@query("m04_angle_gap", f"SELECT id, CAST(abs({MOD('dx - dy + 180', '360e0')} - 180) AS BIGINT) AS gap FROM ({SPOTS})")
def m04(spark, d):
    return S(spark, d).select("id", geo.angle_gap(F.col("dx"), F.col("dy")).cast("long").alias("gap"))


@query("m05_compass_label", f"SELECT id, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((dx + 360 + 22.5e0) / 45) AS BIGINT) % 8 + 1] AS label FROM ({SPOTS})")
def m05(spark, d):
    return S(spark, d).select("id", geo.compass(F.col("dx") + 360).alias("label"))


VISITS = "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderdate AS TIMESTAMP) + make_interval({p}{m}o_orderkey * 7 % 1440{e}) AS vt, 126.9e0 + (o_orderkey % 100) / 1e3 AS lon, 37.4e0 + (o_orderkey % 77) / 1e3 AS lat FROM {orders}"
VISITS_SPARK = VISITS.replace("make_interval({p}{m}o_orderkey * 7 % 1440{e})", "make_interval(0, 0, 0, 0, 0, CAST(o_orderkey * 7 % 1440 AS INT), 0)")
VISITS_DUCK = VISITS.replace("make_interval({p}{m}o_orderkey * 7 % 1440{e})", "to_minutes(CAST(o_orderkey * 7 % 1440 AS INTEGER))")
SUN_SQL = f"""
SELECT id, {micro_sql('alt')} AS altitude_micro, {micro_sql('az')} AS azimuth_micro, CASE WHEN alt > 0 THEN 'daylight' WHEN alt > -6 THEN 'twilight' ELSE 'night' END AS phase FROM (
 SELECT id, degrees(asin(greatest(-1e0, least(1e0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(ha))))) AS alt,
  {MOD('degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(dec) * cos(phi))) + 180', '360e0')} AS az FROM (
  SELECT *, radians({MOD('hr * 60 + eq + 4 * lon', '1440e0')} / 4 - 180) AS ha, radians(lat) AS phi FROM (
   SELECT *, 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) AS eq,
    0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS dec FROM (
    SELECT *, 2 * pi() / (CASE WHEN (year(vt) % 4 = 0 AND year(vt) % 100 <> 0) OR year(vt) % 400 = 0 THEN 366 ELSE 365 END) * (dayofyear(vt) - 1 + (hr - 12) / 24) AS g FROM (
     SELECT *, hour(vt) + minute(vt) / 60e0 + second(vt) / 3600e0 AS hr FROM ({VISITS_DUCK}))))))"""


@query("m06_sun_position", SUN_SQL)
def m06(spark, d):
    altitude, azimuth, phase = geo.sun(F.col("lon"), F.col("lat"), F.col("vt"))
    return frame(spark, d, VISITS_SPARK).select("id", micro(altitude).alias("altitude_micro"), micro(azimuth).alias("azimuth_micro"), phase.alias("phase"))


@query("m07_angular_elevation", f"SELECT id, {micro_sql('degrees(atan2(dx, greatest(0.001e0, abs(dy))))')} AS angle_micro FROM ({SPOTS})")
def m07(spark, d):
    return S(spark, d).select("id", micro(geo.elevation_angle(F.col("dx"), F.abs(F.col("dy")))).alias("angle_micro"))


RAW = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'x' || event_type WHEN 3 THEN NULL ELSE CAST(event_id * 3 % 1000 AS VARCHAR(20)) END AS raw FROM {events}"


@query("m08_finite_number", f"SELECT id, CAST(CASE WHEN isfinite(TRY_CAST(raw AS DOUBLE)) THEN TRY_CAST(raw AS DOUBLE) END AS BIGINT) AS value FROM ({RAW})")
def m08(spark, d):
    return frame(spark, d, RAW).select("id", geo.finite(F.col("raw")).cast("long").alias("value"))


WEATHER = "SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN event_id % 9 * 0.5e0 END AS rain, event_id % 13 * 1e0 AS wind, event_id * 97 % 14000 * 1e0 AS sight FROM {events}"


@query("m09_weather_penalty", f"SELECT id, {micro_sql('CASE WHEN rain IS NOT NULL THEN greatest(0, 100 - (least(70, rain * 12) + least(50, greatest(0, wind - 3) * 6) + 40 * greatest(0, 1 - sight / 10000))) END')} AS score_micro FROM ({WEATHER})")
def m09(spark, d):
    return frame(spark, d, WEATHER).select("id", micro(scores.weather(F.col("rain"), F.col("wind"), F.col("sight"))).alias("score_micro"))


@query("m10_travel_score", f"SELECT id, {micro_sql('greatest(0, 100 * (1 - size / 30e0))')} AS score_micro FROM ({SPOTS})")
def m10(spark, d):
    return S(spark, d).select("id", micro(scores.travel(F.col("size"), F.lit(30.0))).alias("score_micro"))


CROWDED = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'quiet' WHEN 1 THEN 'balanced' ELSE 'lively' END AS wish, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS level FROM {part}"
CROWD_CASE = "CASE " + " ".join(f"WHEN wish = '{p}' AND level = '{k}' THEN {int(v)}" for p, ls in scores.CROWD.items() for k, v in ls.items()) + " END"


@query("m11_crowd_lookup", f"SELECT id, CAST({CROWD_CASE} AS BIGINT) AS score FROM ({CROWDED})")
def m11(spark, d):
    return frame(spark, d, CROWDED).select("id", scores.crowd(F.col("wish"), F.col("level")).cast("long").alias("score"))


SCENES = "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'framed' WHEN 1 THEN 'open' ELSE 'any' END AS kind, CAST(o_orderkey % 8 AS INTEGER) AS visible, CAST(o_orderkey % 8 + o_custkey % 5 AS INTEGER) AS intended, o_orderkey * 7 % 71 * 1e0 AS span, o_custkey * 13 % 3000 * 1e0 AS near, (o_orderkey % 5) / 4e0 AS match, CAST(o_orderkey % 60 - 30 AS DOUBLE) AS sun FROM {orders}"
SHAPE = "CASE WHEN kind = 'framed' THEN CASE WHEN visible >= 2 THEN greatest(0, 1 - abs(span - 15) / 30) ELSE 0 END WHEN kind = 'open' THEN CASE WHEN visible >= 3 THEN least(1, span / 55) ELSE 0 END ELSE least(1, visible / 6e0) END"


@query("m12_composition", f"SELECT id, {micro_sql(SHAPE)} AS shape_micro FROM ({SCENES})")
def m12(spark, d):
    return frame(spark, d, SCENES).select("id", micro(scores.composition(F.col("kind"), F.col("visible"), F.col("span"))).alias("shape_micro"))


SCENE_SCORE = f"45 * match + 25 * visible / greatest(1, intended) + 15 * ({SHAPE}) + 10 * greatest(0, 1 - near / 2500e0) + 5 * (CASE WHEN sun > 0 THEN 1e0 ELSE 0.3e0 END)"


def scene_score():
    shape = scores.composition(F.col("kind"), F.col("visible"), F.col("span"))
    return scores.scene(F.col("match"), F.col("visible"), F.col("intended"), shape, F.col("near"), F.lit(2500.0), F.col("sun"))


@query("m13_scene_score", f"SELECT id, {micro_sql(SCENE_SCORE)} AS score_micro FROM ({SCENES})")
def m13(spark, d):
    return frame(spark, d, SCENES).select("id", micro(scene_score()).alias("score_micro"))


TARGET = "SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'greenery' ELSE 'river' END AS category, p_size * 2e0 AS height, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 10 ELSE 0e0 END AS area, p_partkey * 31 % 4000 * 1e0 AS dist FROM {part}"
IMPORTANCE = "CASE WHEN category = 'city' THEN least(80, greatest(0, height)) / pow(1 + dist / 500, 1.5e0) ELSE (CASE WHEN area > 0 THEN sqrt(area) ELSE 20 END) / (1 + dist / 2000) END"


@query("m14_target_importance", f"SELECT id, {micro_sql(IMPORTANCE)} AS importance_micro FROM ({TARGET})")
def m14(spark, d):
    return frame(spark, d, TARGET).select("id", micro(scores.importance(F.col("category"), F.col("height"), F.col("area"), F.col("dist"))).alias("importance_micro"))


@query("m15_metre_offsets", f"SELECT id, {micro_sql('126.978e0 + dx / (111320 * cos(radians(37.571e0)))')} AS lon_micro, {micro_sql('37.571e0 + dy / 111320')} AS lat_micro FROM ({SPOTS})")
def m15(spark, d):
    return S(spark, d).select("id", micro(126.978 + F.col("dx") / (111320 * F.cos(F.radians(F.lit(37.571))))).alias("lon_micro"), micro(37.571 + F.col("dy") / 111320).alias("lat_micro"))


PATH = f"({HAV('lon', 'lat', '126.978e0', '37.571e0')}) * 1.2e0 + 80"


@query("m16_path_and_time", f"SELECT id, {micro_sql('CASE WHEN id % 3 = 0 THEN path ELSE least(450, path * 0.2e0) END')} AS walk_micro, {micro_sql('CASE id % 3 WHEN 0 THEN path / 75 WHEN 1 THEN 8 + path / 250 ELSE 8 + path / 400 END')} AS minutes_micro, CAST(CASE WHEN (id % 24 >= 18 OR id % 24 < 6) AND id % 5 = 0 THEN 45 WHEN (id % 24 >= 18 OR id % 24 < 6) AND id % 5 = 1 THEN 92 ELSE 86 END AS INTEGER) AS suits FROM (SELECT *, {PATH} AS path FROM ({SPOTS}))")
def m16(spark, d):
    path = geo.haversine(F.col("lon"), F.col("lat"), F.lit(126.978), F.lit(37.571)) * 1.2 + 80
    kind = F.col("id") % 3
    minutes = F.when(kind == 0, path / 75).when(kind == 1, 8 + path / 250).otherwise(8 + path / 400)
    tags_of = F.when(F.col("id") % 5 == 0, F.array(F.lit("forest"))).when(F.col("id") % 5 == 1, F.array(F.lit("night"))).otherwise(F.array().cast("array<string>"))
    return S(spark, d).select("id", micro(F.when(kind == 0, path).otherwise(F.least(F.lit(450.0), path * 0.2))).alias("walk_micro"), micro(minutes).alias("minutes_micro"), scores.time_suitability(F.col("id") % 24, tags_of).cast("int").alias("suits"))


@query("m17_season_and_solar_class", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) < 6 THEN 'spring' WHEN month(o_orderdate) < 9 THEN 'summer' ELSE 'autumn' END AS season, CAST(floor((o_orderkey % 181 - 90) / 5e0) * 5 AS INTEGER) AS sun_class FROM {orders}")
def m17(spark, d):
    m = F.month("o_orderdate")
    season = F.when(m.isin(12, 1, 2), "winter").when(m < 6, "spring").when(m < 9, "summer").otherwise("autumn")
    return frame(spark, d, "SELECT * FROM {orders}").select(F.col("o_orderkey").cast("long").alias("id"), season.alias("season"), (F.floor((F.col("o_orderkey") % 181 - 90) / 5) * 5).cast("int").alias("sun_class"))


@query("m19_canonical_identity", "SELECT CAST(p_partkey AS BIGINT) AS id, sha256('{\"brand\":\"' || p_brand || '\",\"key\":' || p_partkey || ',\"size\":' || p_size || '}') AS digest FROM {part}")
def m19(spark, d):
    body = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size")))
    return frame(spark, d, "SELECT * FROM {part}").select(F.col("p_partkey").cast("long").alias("id"), F.sha2(body, 256).alias("digest"))


@query("m20_always_open", "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_nationkey % 3 = 0 THEN '00:00-24:00' END AS hours FROM {supplier}")
def m20(spark, d):
    raw = F.when(F.col("s_nationkey") % 3 == 0, "24/7").otherwise("Mo-Fr 09:00-18:00")
    return frame(spark, d, "SELECT * FROM {supplier}").select(F.col("s_suppkey").cast("long").alias("id"), F.when(raw == "24/7", "00:00-24:00").alias("hours"))


@query("m21_median_of_even_count", "SELECT p_brand AS brand, CAST(2 * median(p_size) AS BIGINT) AS twice_median FROM {part} GROUP BY p_brand")
def m21(spark, d):
    return frame(spark, d, "SELECT * FROM {part}").groupBy(F.col("p_brand").alias("brand")).agg((2 * F.percentile("p_size", 0.5)).cast("long").alias("twice_median"))


@query("m22_half_even", f"SELECT id, CAST(round_even(dx / 4, 0) AS BIGINT) AS rounded FROM ({SPOTS})")
def m22(spark, d):
    return S(spark, d).select("id", F.rint(F.col("dx") / 4).cast("long").alias("rounded"))


@query("m23_json_tag", "SELECT event_id AS id, json_extract_string(props, '$.k') AS tag_k, json_extract_string(props, '$.page') AS page FROM {events}")
def m23(spark, d):
    return frame(spark, d, "SELECT * FROM {events}").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("tag_k"), F.get_json_object("props", "$.page").alias("page"))


@query("m24_truncated_name", "SELECT page_id AS id, substring(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 1, 24) AS name FROM {pages}")
def m24(spark, d):
    safe = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return frame(spark, d, "SELECT * FROM {pages}").select(F.col("page_id").alias("id"), F.substring(safe, 1, 24).alias("name"))


@query("m25_micro_usd_ceiling", "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(ceil(CAST(p_retailprice AS DECIMAL(18, 9)) / 7 * 1000000) AS BIGINT) AS micro_usd FROM (SELECT p_partkey, floor(p_retailprice) * 7 AS p_retailprice FROM {part})")
def m25(spark, d):
    cost = (F.floor("p_retailprice") * 7).cast("decimal(18,9)") / 7
    return frame(spark, d, "SELECT * FROM {part}").select(F.col("p_partkey").cast("long").alias("id"), F.ceil(cost * 1_000_000).cast("long").alias("micro_usd"))


@query("m26_description", f"SELECT id, 'Spot ' || id || ': ' || ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((dx + 360 + 22.5e0) / 45) AS BIGINT) % 8 + 1] || ', ' || CAST(size AS BIGINT) || ' min' AS words FROM ({SPOTS})")
def m26(spark, d):
    return S(spark, d).select("id", F.format_string("Spot %d: %s, %d min", "id", geo.compass(F.col("dx") + 360), F.col("size").cast("long")).alias("words"))


@query("m27_path_redaction", "SELECT page_id AS id, regexp_replace(url, '/[^/ ]+/', '/<redacted>/', 'g') AS body FROM {pages}")
def m27(spark, d):
    return frame(spark, d, "SELECT * FROM {pages}").select(F.col("page_id").alias("id"), F.regexp_replace("url", "/[^/ ]+/", "/<redacted>/").alias("body"))


X, Y = geo.to_plane_sql("lon", "lat")


@query("g08_projected_plane", f"SELECT id, CAST(floor(({X}) * 1000 + 0.5e0) AS BIGINT) AS x_mm, CAST(floor(({Y}) * 1000 + 0.5e0) AS BIGINT) AS y_mm FROM ({SPOTS})")
def g08(spark, d):
    x, y = geo.to_plane(F.col("lon"), F.col("lat"))
    mm = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return S(spark, d).select("id", mm(x).alias("x_mm"), mm(y).alias("y_mm"))


# -- tag rules --------------------------------------------------------------------------

TAGS = """
SELECT CAST(p_partkey AS BIGINT) AS id,
  CASE p_partkey % 9 WHEN 0 THEN 'footway' WHEN 1 THEN 'path' WHEN 2 THEN 'residential' WHEN 3 THEN 'steps' WHEN 4 THEN 'pedestrian' WHEN 5 THEN 'construction' WHEN 6 THEN 'track' WHEN 7 THEN 'cycleway' END AS highway,
  CASE p_partkey * 3 % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'private' WHEN 2 THEN 'yes' WHEN 3 THEN 'permissive' WHEN 4 THEN 'delivery' END AS access,
  CASE p_partkey * 5 % 13 WHEN 0 THEN 'yes' WHEN 1 THEN 'designated' WHEN 2 THEN 'no' WHEN 3 THEN 'use_sidepath' WHEN 4 THEN 'permissive' END AS foot,
  CASE p_size % 10 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS bridge,
  CASE p_size % 7 WHEN 0 THEN 'yes' END AS area,
  CASE p_partkey % 17 WHEN 0 THEN 'park' WHEN 1 THEN 'garden' END AS leisure,
  CASE p_partkey % 19 WHEN 0 THEN 'peak' WHEN 1 THEN 'water' WHEN 2 THEN 'wood' END AS nature,
  CASE p_partkey % 23 WHEN 0 THEN 'gate' WHEN 1 THEN 'wall' END AS barrier,
  CASE p_partkey % 29 WHEN 0 THEN 'Mo-Su' END AS hours,
  CASE p_partkey % 31 WHEN 0 THEN 'no @ night' END AS cond
FROM {part}"""
KEYS = {"highway": "highway", "access": "access", "foot": "foot", "bridge": "bridge", "area": "area", "leisure": "leisure", "nature": "natural", "barrier": "barrier", "hours": "opening_hours", "cond": "foot:conditional"}


def tagged(spark, d):
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))) for c, k in KEYS.items()])
    return frame(spark, d, TAGS).select("id", F.map_from_entries(F.array_compact(pairs)).alias("tags"))


USE = "coalesce(foot, access)"
POLICY = """CASE WHEN access IN ('no','private','customers','permit','military') OR foot IN ('no','private','use_sidepath') THEN 'excluded:mapped_access_restriction'
 WHEN highway = 'construction' THEN 'excluded:unusable_or_indoor'
 WHEN bridge <> 'no' OR highway = 'steps' THEN 'excluded:unsupported_structure_or_step_elevation'
 WHEN hours IS NOT NULL OR cond IS NOT NULL OR barrier = 'gate' THEN 'exploratory_only:schedule_or_gate_unresolved'
 WHEN highway IN ('residential', 'track') THEN 'excluded:road_carriageway_or_track_centerline'
 WHEN NOT coalesce(highway IN ('footway','pedestrian') OR (highway IN ('path','cycleway') AND foot IN ('yes','designated','permissive')), FALSE) THEN 'exploratory_only:pedestrian_access_unresolved'
 WHEN access NOT IN ('yes','permissive','designated') THEN 'exploratory_only:uninterpreted_access'
 ELSE 'map_supported:dedicated_mapped_pedestrian_use' END"""


@query("f14_access_policy", f"SELECT id, split_part(p, ':', 1) AS state, split_part(p, ':', 2) AS reason FROM (SELECT id, {POLICY} AS p FROM ({TAGS}))")
def f14(spark, d):
    return tagged(spark, d).select("id", tags.access_policy(F.col("tags")).alias("p")).select("id", "p.state", "p.reason")


@query("f15_access_evidence", f"SELECT id, CASE WHEN cond IS NOT NULL THEN 'conditional_unresolved' WHEN {USE} IN ('no','private','customers','destination','use_sidepath') THEN 'restricted' WHEN {USE} IN ('yes','designated','official') THEN 'mapped_permission_unverified' WHEN {USE} = 'permissive' THEN 'permissive_unverified' ELSE 'unknown' END AS status FROM ({TAGS})")
def f15(spark, d):
    return tagged(spark, d).select("id", tags.access_evidence(F.col("tags")).alias("status"))


@query("f16_edge_access", f"SELECT id, CASE WHEN cond IS NOT NULL THEN 'unknown' WHEN {USE} IN ('no','private','customers','destination','use_sidepath') THEN 'prohibited' WHEN {USE} IN ('yes','designated','official') THEN 'verified' WHEN {USE} = 'permissive' THEN 'estimated' ELSE 'unknown' END AS status FROM ({TAGS})")
def f16(spark, d):
    return tagged(spark, d).select("id", tags.edge_access(F.col("tags")).alias("status"))


WALK = """NOT (barrier = 'gate' AND id % 2 = 0) AND NOT coalesce(foot IN ('no','private'), FALSE)
 AND NOT (coalesce(access IN ('no','private'), FALSE) AND NOT coalesce(foot IN ('yes','designated','permissive'), FALSE)) AND NOT (id % 3 = 0 AND coalesce(highway = 'steps', FALSE))"""


@query("f17_edge_permitted", f"SELECT id, coalesce({WALK}, {WALK.replace(chr(39) + 'gate' + chr(39) + ' AND', chr(39) + 'gate' + chr(39) + ' AND').replace('barrier =', 'coalesce(barrier, ' + chr(39) + chr(39) + ') =')}) AS permitted FROM ({TAGS})")
def f17(spark, d):
    gate = F.when((F.element_at("tags", "barrier") == "gate"), F.array(F.create_map(F.lit("locked"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no")))).otherwise(F.array().cast("array<map<string,string>>"))
    gate = F.when(F.map_contains_key("tags", "barrier"), gate).otherwise(F.array().cast("array<map<string,string>>"))
    no = F.lit(False)
    return tagged(spark, d).select("id", tags.traversable(F.col("tags"), gate, F.lit(None).cast("string"), no, no, no, F.col("id") % 3 == 0).alias("permitted"))


CATS = """list_distinct(list_filter([
 CASE WHEN (highway IN ('footway','path','pedestrian','steps','residential','track','cycleway') OR (highway IS NOT NULL AND foot IN ('yes','designated'))) THEN CASE WHEN area = 'yes' THEN 'public_spaces' ELSE 'paths' END END,
 CASE WHEN leisure IN ('park','garden') THEN 'public_spaces' END, CASE WHEN nature = 'water' THEN 'water' END,
 CASE WHEN nature = 'wood' OR leisure = 'park' THEN 'green_space' END, CASE WHEN nature = 'peak' THEN 'peaks_ridges' END,
 CASE WHEN bridge <> 'no' THEN 'bridges' END, CASE WHEN nature = 'peak' THEN 'landmarks' END, CASE WHEN barrier IS NOT NULL THEN 'barriers' END], lambda x: x IS NOT NULL))"""


@query("f18_layer_classes", f"SELECT id, unnest({CATS}) AS layer FROM ({TAGS})")
def f18(spark, d):
    return tagged(spark, d).select("id", F.explode(tags.categories(F.col("tags"))).alias("layer"))


@query("f19_diagnostic_class", f"SELECT id, CASE WHEN nature = 'water' THEN 'water' WHEN bridge IS NOT NULL THEN 'bridge' WHEN nature = 'wood' THEN 'woodland' WHEN leisure IN ('park','garden') OR highway = 'pedestrian' THEN 'public_space' ELSE 'other' END AS class FROM ({TAGS})")
def f19(spark, d):
    return tagged(spark, d).select("id", tags.diagnostic_class(F.col("tags")).alias("class"))


@query("f20_pedestrian_area", f"SELECT id, cond IS NULL AND NOT coalesce({USE} IN ('no','private','customers','destination','use_sidepath'), FALSE) AND coalesce(highway = 'pedestrian' AND area = 'yes', FALSE) AS supported FROM ({TAGS})")
def f20(spark, d):
    return tagged(spark, d).select("id", tags.pedestrian_area(F.col("tags")).alias("supported"))

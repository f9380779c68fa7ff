"""Scenes end to end, scenarios, presentation, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geodesic import metres
from ..operators import scenes, sight
from ..sources import contexts, grids
from ..streaming import windows
from .base import frame, micro, micro_sql, query
from .rank_queries import ALL, BEST, _passed, scored
from .scalar_queries import HAV, MOD, SPOTS
from .spatial_queries import BOXES, POINTS, B, P

SAMPLES = "SELECT l_orderkey AS spot, CAST(l_orderkey * 31 % 900 AS DOUBLE) AS x, CAST(l_orderkey * 17 % 900 AS DOUBLE) AS y, l_partkey % 60 AS target, CASE l_partkey % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'city' WHEN 2 THEN 'mountain' ELSE 'greenery' END AS category, l_suppkey % 5 AS endp, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE 3 END AS ray, CAST(l_partkey * 13 % 360 AS DOUBLE) AS bearing, l_partkey % 97 AS px, l_suppkey % 89 AS py FROM {lineitem}"
REASON = "CASE WHEN category = 'river' THEN 'water_surface_not_modelled' WHEN endp = 0 THEN 'endpoint_water' WHEN ray = 3 THEN 'unknown_on_ray' END"
STATE = f"CASE WHEN category = 'river' THEN 3 WHEN endp = 0 THEN 2 ELSE ray END"


def samples(spark, d):
    s = frame(spark, d, SAMPLES)
    ok = F.lit("ok")
    reason = scenes.sample_reason(F.col("category"), F.when(F.col("endp") == 0, "water").otherwise("clear"), ok, ok, F.col("ray"))
    return s.withColumn("reason", reason).withColumn("state", scenes.sample_state(F.col("reason"), F.col("ray")))


@query("g32_sample_evaluation", f"SELECT coalesce({REASON}, 'none') AS reason, CAST({STATE} AS INTEGER) AS state, count(*) AS samples FROM ({SAMPLES}) GROUP BY 1, 2")
def g32(spark, d):
    return samples(spark, d).groupBy(F.coalesce("reason", F.lit("none")).alias("reason"), F.col("state").cast("int").alias("state")).agg(F.count(F.lit(1)).alias("samples"))


TURN = MOD("s.bearing - h.head + 180", "360e0") + " - 180"
HEADS = f"""WITH RECURSIVE s AS (SELECT *, {STATE} AS state FROM ({SAMPLES})),
b AS (SELECT spot, bearing, row_number() OVER (PARTITION BY spot ORDER BY bearing) AS i FROM s WHERE state = 1),
f AS (SELECT DISTINCT spot, 0 AS i, CAST([] AS DOUBLE[]) AS kept FROM b UNION ALL SELECT b.spot, b.i, CASE WHEN len(kept) >= 2 OR len(list_filter(kept, lambda y: abs({MOD('b.bearing - y + 180', '360e0')} - 180) <= 50)) > 0 THEN kept ELSE list_append(kept, b.bearing) END FROM f JOIN b ON b.spot = f.spot AND b.i = f.i + 1),
h AS (SELECT spot, unnest(kept) AS head FROM (SELECT spot, arg_max(kept, i) AS kept FROM f GROUP BY spot)),
n AS (SELECT s.*, h.head, {TURN} AS turn FROM s JOIN h ON s.spot = h.spot WHERE abs({TURN}) <= 35),
scene AS (SELECT spot, head, count(*) AS intended, count(*) FILTER (state = 1) AS visible, count(DISTINCT CASE WHEN state = 1 THEN (px, py) END) AS places, max(CASE WHEN state = 1 THEN turn END) - min(CASE WHEN state = 1 THEN turn END) AS span, count(DISTINCT CASE WHEN state = 1 AND category = 'city' THEN target END) AS buildings FROM n GROUP BY spot, head)"""


@query("i04_scene_sectors", f"{HEADS} SELECT spot, CAST(head AS BIGINT) AS head, intended, visible, CAST(span AS BIGINT) AS span, buildings >= 2 AS skyline FROM scene WHERE visible >= 2 AND places >= 2")
def i04(spark, d):
    s = scenes.sectors(samples(spark, d))
    return s.select("spot", F.col("head").cast("long").alias("head"), "intended", "visible", F.col("span").cast("long").alias("span"), F.array_contains("categories", "skyline").alias("skyline"))


@query("i04_scene_discovery")
def i04_full(spark, d):
    """The whole discovery: sectors, scores and the diverse top three."""
    s = scenes.scored(scenes.sectors(samples(spark, d)), ["city", "mountain"], "framed", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 2500.0, F.lit(10.0))
    return scenes.diverse(s, 3).select("place", "spot", F.col("head").cast("long").alias("head"))


@query("i08_scenario_landmarks", f"SELECT * FROM (VALUES ('river', 1300, 150), ('ridge', -1100, 1400), ('garden', -900, -1000), ('tower', 1800, 1000), ('bridge', 1100, -300)) t(id, dx, dy)")
def i08(spark, d):
    from ..sources.scenario import landmarks

    return landmarks(spark).select("id", "dx", "dy")


@query("i09_decorated_top", f"{BEST} SELECT id, 'Spot ' || id || ' looks ' || ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((bearing + 22.5e0) / 45) AS BIGINT) % 8 + 1] AS words FROM ranked WHERE place <= 5")
def i09(spark, d):
    best = _passed(spark, d).orderBy(F.col("score").desc_nulls_last(), F.col("coverage").desc(), "id").limit(5)
    return best.select("id", F.format_string("Spot %d looks %s", "id", geo.compass(F.col("bearing"))).alias("words"))


@query("i10_response_counts", f"{ALL} SELECT count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'failed') AS failed FROM scored")
def i10(spark, d):
    s = F.col("status")
    return scored(spark, d).agg(F.count_if(s == "passed").alias("passed"), F.count_if(s == "unverified").alias("unverified"), F.count_if(s == "failed").alias("failed"))


@query("f27_evidence_allow_list", "SELECT event_id AS id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k IN ('k'))), ',') AS kept FROM {events}")
def f27(spark, d):
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return frame(spark, d, "SELECT * FROM {events}").select(F.col("event_id").alias("id"), F.array_join(F.array_sort(F.array_intersect(keys, F.array(F.lit("k")))), ",").alias("kept"))


@query("g16_surface_target", f"WITH {grids.SYNTHETIC_SQL} SELECT row, col, CASE WHEN surface IS NULL THEN 'unknown' WHEN occupancy = 1 THEN 'roof' ELSE 'ground' END AS kind, CAST(surface AS BIGINT) AS z FROM grid")
def g16(spark, d):
    kind = F.when(F.col("surface").isNull(), "unknown").when(F.col("occupancy") == 1, "roof").otherwise("ground")
    return grids.synthetic(spark).select("row", "col", kind.alias("kind"), F.col("surface").cast("long").alias("z"))


WAYENDS = "SELECT l_orderkey AS rel, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM {lineitem}"


@query("g30_ring_degrees", f"SELECT rel, bool_and(n = 2) AS closed FROM (SELECT rel, v, count(*) AS n FROM (SELECT rel, a AS v FROM ({WAYENDS}) UNION ALL SELECT rel, b FROM ({WAYENDS})) GROUP BY rel, v) GROUP BY rel")
def g30(spark, d):
    w = frame(spark, d, WAYENDS)
    ends = w.select("rel", F.explode(F.array("a", "b")).alias("v"))
    return ends.groupBy("rel", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("rel").agg(F.bool_and(F.col("n") == 2).alias("closed"))


@query("m18_geodesic_length")
def m18(spark, d):
    return frame(spark, d, SPOTS).select("id", F.round(metres()(F.col("lon"), F.col("lat"), F.lit(126.978), F.lit(37.571)), 3).alias("metres"))


MANIFEST = "SELECT 'f' || s_suppkey AS name, CAST(s_suppkey * 10 AS BIGINT) AS length, sha256('b' || s_suppkey) AS sha256 FROM {supplier}"


@query("k05_package_validation", "SELECT 'f' || s_suppkey AS name, CASE WHEN s_suppkey % 9 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM {supplier} WHERE s_suppkey % 9 = 0 OR s_suppkey % 13 = 0")
def k05(spark, d):
    want = frame(spark, d, "SELECT concat('f', s_suppkey) AS name, CAST(s_suppkey * 10 AS BIGINT) AS length, sha2(concat('b', s_suppkey), 256) AS sha256, s_suppkey AS k FROM {supplier}")
    have = want.filter("k % 9 <> 0").withColumn("length", F.when(F.col("k") % 13 == 0, F.col("length") + 1).otherwise(F.col("length"))).drop("k")
    return contexts.compare_package(have, want.drop("k"))


@query("s17_context_nodes", "SELECT 'n' || c_custkey AS id, c_mktsegment AS tag FROM {customer}")
def s17(spark, d):
    rows = frame(spark, d, "SELECT * FROM {customer}")
    node = F.struct(F.concat(F.lit("n"), F.col("c_custkey")).alias("id"), F.lit(127.0).alias("lon"), F.lit(37.5).alias("lat"), F.create_map(F.lit("seg"), F.col("c_mktsegment")).alias("tags"))
    body = rows.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 500)).agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.collect_list(node).alias("nodes"), F.array().cast("array<struct<u:string>>").alias("edges"))).alias("body"))
    nodes, _ = contexts.split_context(body.select(F.from_json("body", contexts.CONTEXT).alias("c")).select("c.*"))
    return nodes.select("id", F.element_at("tags", "seg").alias("tag"))

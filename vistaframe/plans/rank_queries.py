"""Constraints, scores, diversity and validity rules over candidates made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import ordered, ranking
from ..operators.ranking import Request
from .base import frame, micro, micro_sql, query
from .scalar_queries import HAV, MOD, SCENE_SCORE, SCENES, scene_score

R = Request()
CANDS = """
SELECT CAST(p_partkey AS BIGINT) AS id, 126.97e0 + (p_partkey * 37 % 100) / 1e5 AS lon, 37.57e0 + (p_partkey * 53 % 100) / 1e5 AS lat,
  CASE p_partkey % 10 WHEN 0 THEN 'blocked' WHEN 1 THEN 'excluded' WHEN 2 THEN 'unknown' ELSE 'visible' END AS visibility,
  CASE WHEN p_partkey % 23 = 0 THEN 'transit' ELSE 'walking' END AS route_mode,
  CASE p_size % 7 WHEN 0 THEN 'estimated' WHEN 1 THEN NULL WHEN 2 THEN 'verified' ELSE 'scenario' END AS route_status,
  CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS DOUBLE) END AS minutes, p_size * 60e0 AS walk_m,
  CASE p_partkey % 13 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS public, CASE p_partkey % 11 WHEN 0 THEN 'estimated' ELSE 'scenario' END AS public_status,
  CASE p_partkey % 19 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS step_free, CASE p_partkey % 29 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS stairs,
  CASE WHEN p_partkey % 31 <> 0 THEN CAST(p_partkey % 10 AS DOUBLE) END AS slope,
  CAST(p_partkey % 5 AS INTEGER) AS shift, CASE WHEN p_partkey % 37 = 0 THEN 'estimated' ELSE 'scenario' END AS hours_status,
  CAST(p_partkey % 4 AS INTEGER) AS look, CASE p_partkey % 6 WHEN 0 THEN 'estimated' ELSE 'scenario' END AS composition_status,
  CASE WHEN p_partkey % 8 <> 0 THEN p_retailprice / 20 END AS composition,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS crowd_level, p_partkey % 7 <> 0 AS crowd_current,
  p_partkey % 14 <> 0 AS weather_current, p_partkey % 5 * 0.5e0 AS rain, p_partkey % 9 * 1e0 AS wind, p_partkey * 91 % 12000 * 1e0 AS sight,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(40 + p_partkey % 60 AS DOUBLE) END AS time_score,
  CAST(p_partkey * 41 % 360 AS DOUBLE) AS bearing, p_partkey % 3 AS target
FROM {part}"""
#: Opening hours by shift: null, none, split at noon and on, overnight, all day.
SHIFT = "CASE shift WHEN 1 THEN [] WHEN 2 THEN [{'start': 540, 'stop': 720}, {'start': 720, 'stop': 1140}] WHEN 3 THEN [{'start': 1080, 'stop': 120}] WHEN 4 THEN [{'start': 0, 'stop': 1440}] END"


def spots(spark, d):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"))
    s = F.col("shift")
    hours = F.when(s == 1, F.array().cast("array<struct<start:int,stop:int>>")).when(s == 2, F.array(span(540, 720), span(720, 1140))).when(s == 3, F.array(span(1080, 120))).when(s == 4, F.array(span(0, 1440)))
    looks = {0: ("nature", "river"), 1: ("city",), 2: ("nature", "park", "nature")}
    features = F.array().cast("array<string>")
    for k, names in looks.items():
        features = F.when(F.col("look") == k, F.array(*[F.lit(n) for n in names])).otherwise(features)
    return (
        frame(spark, d, CANDS)
        .withColumn("hours", hours)
        .withColumn("features", features)
        .withColumn("features_status", F.lit("scenario"))
        .withColumn("evidence_kind", F.lit("scenario"))
        .withColumn("targets", F.array(F.concat(F.lit("t"), F.col("target"))))
        .withColumn("signature", F.concat(F.lit("s"), F.col("look")))
    )


COVER = f"""
cand AS ({CANDS}),
arrive AS (SELECT *, 1080 + minutes AS arrival, 1080 + minutes + 45 AS departure, {SHIFT} AS hours FROM cand),
spans AS (SELECT id, arrival, departure, floor(arrival / 1440) * 1440 + day + h.start AS a,
   floor(arrival / 1440) * 1440 + day + CASE WHEN h.stop > h.start THEN h.stop ELSE h.stop + 1440 END AS b
   FROM (SELECT id, arrival, departure, unnest(hours) AS h FROM arrive WHERE hours IS NOT NULL), (VALUES (-1440), (0), (1440)) t(day)),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY a, b) AS g FROM marked),
merged AS (SELECT id, g, min(a) AS a, max(b) AS b, min(arrival) AS arrival, min(departure) AS departure FROM island GROUP BY id, g),
fit AS (SELECT id, bool_or(a <= arrival AND departure <= b) AS fits FROM merged GROUP BY id),
cover AS (SELECT r.*, CASE WHEN hours IS NULL THEN NULL WHEN len(hours) = 0 THEN FALSE ELSE fits END AS covered FROM arrive r LEFT JOIN fit USING (id))"""


@query("f13_opening_hours_cover", f"WITH {COVER} SELECT id, covered FROM cover")
def f13(spark, d):
    arrival = 1080 + F.col("minutes")
    covered = ranking.hours_cover(F.col("hours"), arrival, arrival + 45)
    return spots(spark, d).select("id", F.when(F.size("hours") == 0, F.when(F.col("hours").isNotNull(), F.lit(False))).otherwise(covered).alias("covered"))


@query("w03_interval_merge", f"WITH {COVER} SELECT id, count(*) AS stretches, CAST(sum(b - a) AS BIGINT) AS minutes FROM merged WHERE a IS NOT NULL GROUP BY id")
def w03(spark, d):
    from ..operators.ordered import merge_intervals

    base = spots(spark, d).filter("minutes IS NOT NULL")
    day = F.floor((1080 + F.col("minutes")) / 1440) * 1440
    h = base.select("id", day.alias("day"), F.explode("hours").alias("h"))
    stop = F.when(F.col("h.stop") > F.col("h.start"), F.col("h.stop")).otherwise(F.col("h.stop") + 1440)
    spans = h.withColumn("d", F.explode(F.array(F.lit(-1440), F.lit(0), F.lit(1440)))).select("id", (F.col("day") + F.col("d") + F.col("h.start")).alias("a"), (F.col("day") + F.col("d") + stop).alias("b"))
    return merge_intervals(spans, ["id"], "a", "b").groupBy("id").agg(F.count(F.lit(1)).alias("stretches"), F.sum(F.col("b") - F.col("a")).cast("long").alias("minutes"))


TRUST = lambda c: f"coalesce({c} IN ('verified', 'scenario'), FALSE)"
LISTS = f"""
judged AS (SELECT *, {TRUST('route_status')} AND route_mode = 'walking' AS ok FROM cover),
lists AS (SELECT *, list_filter([
  CASE WHEN visibility IN ('blocked', 'excluded') THEN 'visibility' END, CASE WHEN minutes > 40 THEN 'travel' END, CASE WHEN walk_m > 2400 THEN 'walk' END,
  CASE WHEN NOT public THEN 'public' END, CASE WHEN coalesce(stairs, FALSE) OR NOT coalesce(step_free, TRUE) THEN 'stairs' END,
  CASE WHEN ok AND slope > 8 THEN 'slope' END, CASE WHEN departure > 1260 THEN 'window' END, CASE WHEN minutes IS NOT NULL AND NOT covered THEN 'hours' END], lambda x: x IS NOT NULL) AS failures,
 list_filter([
  CASE WHEN visibility = 'unknown' THEN 'visibility' END, CASE WHEN route_mode <> 'walking' THEN 'route_mode' END,
  CASE WHEN NOT coalesce(minutes > 40, FALSE) AND (minutes IS NULL OR NOT ok) THEN 'travel' END,
  CASE WHEN NOT coalesce(walk_m > 2400, FALSE) AND NOT ok THEN 'walk' END,
  CASE WHEN coalesce(public, TRUE) AND (public IS NULL OR NOT {TRUST('public_status')}) THEN 'public' END,
  CASE WHEN NOT (coalesce(stairs, FALSE) OR NOT coalesce(step_free, TRUE)) AND (stairs IS NULL OR step_free IS NULL OR NOT ok) THEN 'stairs' END,
  CASE WHEN slope IS NULL OR NOT ok THEN 'slope' END,
  CASE WHEN minutes IS NOT NULL AND coalesce(covered, TRUE) AND (covered IS NULL OR NOT {TRUST('hours_status')}) THEN 'hours' END,
  CASE WHEN minutes IS NULL THEN 'arrival' END], lambda x: x IS NOT NULL) AS unknown FROM judged),
checked AS (SELECT *, CASE WHEN len(failures) > 0 THEN 'failed' WHEN len(unknown) > 0 THEN 'unverified' ELSE 'passed' END AS status FROM lists)"""


def checked(spark, d):
    return ranking.constraints(spots(spark, d), R)


@query("f10_hard_constraints", f"WITH {COVER}, {LISTS} SELECT id, status, array_to_string(failures, ',') AS failed, array_to_string(unknown, ',') AS open FROM checked")
def f10(spark, d):
    return checked(spark, d).select("id", "status", F.array_join("failures", ",").alias("failed"), F.array_join("unknown", ",").alias("open"))


@query("f12_trust", f"SELECT id, {TRUST('public_status')} AS trusted FROM ({CANDS})")
def f12(spark, d):
    return spots(spark, d).select("id", ranking.trusted(F.col("public_status"), R).alias("trusted"))


EVID = "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'forecast' WHEN 2 THEN 'estimated' WHEN 3 THEN 'scenario' WHEN 4 THEN 'observed' ELSE 'unknown' END AS status, CASE WHEN event_id % 17 <> 0 THEN event_id % 400 END AS ref, CASE WHEN event_id % 3 <> 0 THEN event_id % 200 END AS begins, CASE WHEN event_id % 5 <> 0 THEN event_id % 200 + 150 END AS ends, CASE WHEN event_id % 13 = 0 THEN 'residential_population' ELSE 'visitors' END AS basis, 200 + event_id * 7 % 200 AS vt FROM {events}"


@query("f11_evidence_current", f"SELECT id, coalesce(CASE WHEN status = 'scenario' THEN TRUE WHEN status NOT IN ('observed','forecast','estimated') OR basis = 'residential_population' OR ref IS NULL THEN FALSE WHEN status = 'observed' AND NOT (vt - ref BETWEEN 0 AND 120) THEN FALSE WHEN begins IS NOT NULL AND ends IS NOT NULL THEN vt BETWEEN begins AND ends AND ref <= vt ELSE status = 'observed' END, FALSE) AS current FROM ({EVID})")
def f11(spark, d):
    c = F.col
    return frame(spark, d, EVID).select("id", ranking.evidence_current(c("status"), c("ref"), c("begins"), c("ends"), c("basis"), c("vt"), R).alias("current"))


PREF = "CASE look WHEN 0 THEN 100e0 WHEN 1 THEN 0e0 WHEN 2 THEN 50e0 END"
VIS = "CASE WHEN visibility = 'visible' THEN coalesce(CASE WHEN composition_status = 'scenario' THEN greatest(0, least(100, composition)) END, 60e0) END"
WEA = "greatest(0, 100 - (least(70, rain * 12) + least(50, greatest(0, wind - 3) * 6) + 40 * greatest(0, 1 - sight / 10000)))"
TIME = f"coalesce(time_score, CASE WHEN weather_current THEN {WEA} END)"
TRAV = "CASE WHEN route_status IN ('verified','estimated','scenario') AND route_mode = 'walking' AND minutes >= 0 THEN greatest(0, 100 * (1 - minutes / 40e0)) END"
CROW = "CASE WHEN crowd_current THEN CASE crowd_level WHEN 'low' THEN 100e0 WHEN 'medium' THEN 45e0 WHEN 'high' THEN 0e0 END END"
SCORED = f"""
crit AS (SELECT *, {PREF} AS k1, {VIS} AS k2, {TIME} AS k3, {TRAV} AS k4, {CROW} AS k5 FROM checked),
known AS (SELECT *, 0e0 + CASE WHEN k1 IS NOT NULL THEN 0.3e0 ELSE 0 END + CASE WHEN k2 IS NOT NULL THEN 0.25e0 ELSE 0 END + CASE WHEN k3 IS NOT NULL THEN 0.2e0 ELSE 0 END + CASE WHEN k4 IS NOT NULL THEN 0.15e0 ELSE 0 END + CASE WHEN k5 IS NOT NULL THEN 0.1e0 ELSE 0 END AS coverage FROM crit),
scored AS (SELECT *, CASE WHEN coverage > 0 THEN (0e0 + coalesce(k1 * 0.3e0, 0) + coalesce(k2 * 0.25e0, 0) + coalesce(k3 * 0.2e0, 0) + coalesce(k4 * 0.15e0, 0) + coalesce(k5 * 0.1e0, 0)) / coverage END AS score FROM known)"""
ALL = f"WITH RECURSIVE {COVER}, {LISTS}, {SCORED}"


def scored(spark, d):
    return ranking.scored(checked(spark, d), R)


@query("a10_renormalised_score", f"{ALL} SELECT id, {micro_sql('score')} AS score_micro, {micro_sql('coverage')} AS coverage_micro FROM scored")
def a10(spark, d):
    return scored(spark, d).select("id", micro(F.col("score")).alias("score_micro"), micro(F.col("coverage")).alias("coverage_micro"))


@query("u01_preference_overlap", f"SELECT id, CAST({PREF} AS BIGINT) AS percent FROM ({CANDS})")
def u01(spark, d):
    from ..functions.scores import preference

    return spots(spark, d).select("id", preference(F.col("features"), F.array(F.lit("nature"), F.lit("river"))).cast("long").alias("percent"))


BEST = f"{ALL}, ranked AS (SELECT *, row_number() OVER (ORDER BY CAST(floor(score * 1e6 + 0.5e0) AS BIGINT) DESC NULLS LAST, coverage DESC, id) AS place FROM scored WHERE status = 'passed')"


def _passed(spark, d):
    return scored(spark, d).filter("status = 'passed'").withColumn("score", micro(F.col("score")))


@query("o01_top_k_with_shortfall", f"{BEST} SELECT CAST(place AS INTEGER) AS place, id, status, greatest(0, 10 - (SELECT count(*) FROM ranked)) AS shortfall FROM ranked WHERE place <= 10")
def o01(spark, d):
    found = _passed(spark, d)
    short = found.agg(F.greatest(F.lit(0), 10 - F.count(F.lit(1))).alias("shortfall"))
    return ranking.top_k(found, 10).crossJoin(F.broadcast(short)).select("place", "id", "status", "shortfall")


@query("o02_score_order", f"{ALL} SELECT id, CAST(row_number() OVER (ORDER BY CAST(floor(score * 1e6 + 0.5e0) AS BIGINT) DESC NULLS LAST, coverage DESC, id) AS INTEGER) AS place FROM scored")
def o02(spark, d):
    rows = scored(spark, d).select("id", micro(F.col("score")).alias("s"), "coverage")
    return ordered.ranked(rows, [F.col("s").desc_nulls_last(), F.col("coverage").desc(), F.col("id")]).select("id", F.col("place").cast("int").alias("place"))


SAME = f"abs({MOD('r.bearing - c.bearing + 180', '360e0')} - 180) <= 20 AND ({HAV('r.lon', 'r.lat', 'c.lon', 'c.lat')}) <= 120 AND r.target = c.target AND r.look = c.look"
GREEDY = f"""{BEST.replace("WHERE status = 'passed'", "WHERE status <> 'failed'")},
walk AS (
  SELECT 0 AS i, [CAST(NULL AS STRUCT(id BIGINT, lon DOUBLE, lat DOUBLE, bearing DOUBLE, target BIGINT, look INTEGER))] AS kept
  UNION ALL
  SELECT i + 1, CASE WHEN len(list_filter(kept, lambda c: c IS NOT NULL AND coalesce({SAME}, FALSE))) > 0 THEN kept
    ELSE list_append(kept, {{'id': r.id, 'lon': r.lon, 'lat': r.lat, 'bearing': r.bearing, 'target': CAST(r.target AS BIGINT), 'look': r.look}}) END
  FROM walk JOIN ranked r ON r.place = walk.i + 1)
SELECT CAST(unnest(range(1, len(kept))) AS INTEGER) AS place, unnest(list_transform(kept[2:], lambda c: c.id)) AS id FROM walk ORDER BY i DESC LIMIT (SELECT len(kept) - 1 FROM walk ORDER BY i DESC LIMIT 1)"""


@query("o07_diverse_representatives", GREEDY)
def o07(spark, d):
    rows = scored(spark, d).filter("status <> 'failed'")
    row = F.struct("id", "lon", "lat", "bearing", "targets", "signature")
    order = [-F.coalesce(micro(F.col("score")), F.lit(-1)), -F.col("coverage"), F.col("id")]
    kept = ranking.representatives(rows, row, order, ["targets", "signature"])
    return kept.select(F.col("place").cast("int").alias("place"), "id")


SPREAD = f"SELECT o_orderkey AS id, CAST(o_orderkey % 40 AS INTEGER) AS req, CAST(o_orderkey * 31 % 900 AS DOUBLE) AS x, CAST(o_orderkey * 17 % 900 AS DOUBLE) AS y, CAST(o_orderkey * 13 % 360 AS DOUBLE) AS bearing, o_orderkey % 5 AS t, {SCENE_SCORE} AS score FROM (SELECT * FROM ({SCENES})) s JOIN {{orders}} o ON o.o_orderkey = s.id"
REDUNDANT = f"(sqrt((r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y)) < 180 AND abs({MOD('r.bearing - c.bearing + 180', '360e0')} - 180) < 40) OR (r.t = c.t AND sqrt((r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y)) < 500)"
DIVERSE = f"""WITH RECURSIVE s AS ({SPREAD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY CAST(floor(score * 1e6 + 0.5e0) AS BIGINT) DESC, id) AS place FROM s),
walk AS (
  SELECT DISTINCT req, 0 AS i, [CAST(NULL AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, bearing DOUBLE, t BIGINT))] AS kept FROM s
  UNION ALL
  SELECT walk.req, i + 1, CASE WHEN len(kept) > 3 OR len(list_filter(kept, lambda c: c IS NOT NULL AND coalesce({REDUNDANT}, FALSE))) > 0 THEN kept
    ELSE list_append(kept, {{'id': r.id, 'x': r.x, 'y': r.y, 'bearing': r.bearing, 't': CAST(r.t AS BIGINT)}}) END
  FROM walk JOIN ranked r ON r.req = walk.req AND r.place = walk.i + 1),
last AS (SELECT req, arg_max(kept, i) AS kept FROM walk GROUP BY req)
SELECT req, CAST(unnest(range(1, len(kept))) AS INTEGER) AS place, unnest(list_transform(kept[2:], lambda c: c.id)) AS id FROM last"""


@query("o06_diverse_top_3", DIVERSE)
def o06(spark, d):
    rows = frame(spark, d, SCENES).withColumn("score", scene_score())
    rows = rows.select("id", (F.col("id") % 40).cast("int").alias("req"), (F.col("id") * 31 % 900).cast("double").alias("x"), (F.col("id") * 17 % 900).cast("double").alias("y"), (F.col("id") * 13 % 360).cast("double").alias("bearing"), F.array(F.col("id") % 5).alias("targets"), "score")

    def redundant(a, b):
        gap = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
        overlap = F.size(F.array_intersect(a["targets"], b["targets"])) / F.greatest(F.lit(1), F.size(F.array_union(a["targets"], b["targets"])))
        return ((gap < 180) & (geo.angle_gap(a["bearing"], b["bearing"]) < 40)) | ((overlap > 0.75) & (gap < 500))

    kept = ranking.greedy(rows, ["req"], F.struct("id", "x", "y", "bearing", "targets"), F.struct((-micro(F.col("score"))).alias("s"), F.col("id").alias("i")), redundant, 3)
    return kept.select("req", F.col("place").cast("int").alias("place"), "id")


@query("u02_jaccard_overlap", "SELECT a.o_orderkey AS id, CAST(floor(1e6 * len(list_intersect([a.o_custkey % 4, a.o_orderkey % 3 + 2], [a.o_custkey % 5, 3])) / len(list_distinct(list_concat([a.o_custkey % 4, a.o_orderkey % 3 + 2], [a.o_custkey % 5, 3]))) + 0.5) AS BIGINT) AS overlap_micro FROM {orders} a")
def u02(spark, d):
    a = F.array(F.col("o_custkey") % 4, F.col("o_orderkey") % 3 + 2)
    b = F.array(F.col("o_custkey") % 5, F.lit(3).cast("long"))
    return frame(spark, d, "SELECT * FROM {orders}").select(F.col("o_orderkey").alias("id"), micro(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("overlap_micro"))


@query("i07_rank_summary", f"{ALL} SELECT status, count(*) AS spots, count(score) AS with_score FROM scored GROUP BY status")
def i07(spark, d):
    return scored(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("spots"), F.count("score").alias("with_score"))

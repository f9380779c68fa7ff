"""Sight lines, horizons and viewsheds over the synthetic grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import EARTH_DIAMETER_M
from ..operators import block_view, sight
from ..sources import grids
from .base import frame, micro, micro_sql, query

RES = 5.0
#: Observers from customers, target 1 of the suppliers; grid coordinates of eye and target.
RAYS = """
SELECT CAST(c_custkey AS BIGINT) AS ray_id, 31.5 AS c0, 33.5 AS r0, 60.0 AS z0,
  CAST(c_custkey * 13 % 60 + 2 AS DOUBLE) + (c_custkey % 4) * 0.25 AS c1,
  CAST(c_custkey * 7 % 60 + 2 AS DOUBLE) + (c_custkey % 3) * 0.5 AS r1,
  CAST((3 * (c_custkey * 7 % 60 + 2) + 5 * (c_custkey * 13 % 60 + 2)) % 23 AS DOUBLE) + 1.7 AS z1
FROM {customer}"""

TOUCH = lambda v: f"CASE WHEN abs(({v}) - round_even({v}, 0)) <= 1e-9 THEN [CAST(round_even({v}, 0) AS INTEGER) - 1, CAST(round_even({v}, 0) AS INTEGER)] ELSE [CAST(floor({v}) AS INTEGER)] END"
CUT = lambda a, b: f"SELECT *, (i - {a}) / ({b} - {a}) AS t FROM (SELECT rays.*, unnest(range(CAST(ceil(least({a}, {b})) AS BIGINT), CAST(floor(greatest({a}, {b})) AS BIGINT) + 1)) AS i FROM rays WHERE {a} <> {b})"
#: pieces(ray columns, enter_t, leave_t, row, col)
PIECES = f"""
cuts AS (
  SELECT DISTINCT ray_id, t FROM (
    SELECT ray_id, 0.0::DOUBLE AS t FROM rays UNION ALL SELECT ray_id, 1.0::DOUBLE FROM rays
    UNION ALL SELECT ray_id, t FROM ({CUT('c0', 'c1')}) UNION ALL SELECT ray_id, t FROM ({CUT('r0', 'r1')}))
  WHERE t >= 0 AND t <= 1),
spans AS (
  SELECT ray_id, t AS enter_t, t AS leave_t FROM cuts
  UNION ALL SELECT * FROM (SELECT ray_id, t, lead(t) OVER (PARTITION BY ray_id ORDER BY t) AS n FROM cuts) WHERE n IS NOT NULL),
mids AS (SELECT rays.*, enter_t, leave_t, r0 + (enter_t + leave_t) / 2 * (r1 - r0) AS mr, c0 + (enter_t + leave_t) / 2 * (c1 - c0) AS mc FROM spans JOIN rays USING (ray_id)),
rowed AS (SELECT *, unnest({TOUCH('mr')}) AS row FROM mids),
pieces AS (SELECT *, unnest({TOUCH('mc')}) AS col FROM rowed)"""
HEIGHT = lambda t: f"z0 + {t} * (z1 - z0) - s - q * {t} * (1 - {t})"
CLEAR = f"""
sag AS (SELECT p.*, g.surface AS s, (6.0::DOUBLE / 7) * (sqrt((c1 - c0) ** 2 + (r1 - r0) ** 2) * {RES}) * (sqrt((c1 - c0) ** 2 + (r1 - r0) ** 2) * {RES}) / {EARTH_DIAMETER_M} AS q
  FROM pieces p LEFT JOIN grid g ON g.row = p.row AND g.col = p.col),
turned AS (SELECT *, CASE WHEN q > 0 THEN (q - (z1 - z0)) / (2 * q) END AS turn FROM sag),
clear AS (SELECT *, CASE WHEN s IS NOT NULL THEN least({HEIGHT('enter_t')}, {HEIGHT('leave_t')}, CASE WHEN turn > enter_t AND turn < leave_t THEN {HEIGHT('turn')} END) END AS clear FROM turned)"""
RAYS_CTE = f"WITH {grids.SYNTHETIC_SQL}, rays AS ({RAYS}), {PIECES}, {CLEAR}"
VERDICT = "CAST(CASE WHEN bool_or(s IS NULL) THEN 3 WHEN min(clear) < -1e-6 THEN 0 ELSE 1 END AS INTEGER)"


@query("g10_traversed_cells", f"WITH rays AS ({RAYS}), {PIECES} SELECT ray_id, row, col, {micro_sql('min(enter_t)')} AS enter_micro, {micro_sql('max(leave_t)')} AS leave_micro FROM pieces GROUP BY ray_id, row, col")
def traversed(spark, sf_dir):
    out = sight.touch_cells(frame(spark, sf_dir, RAYS))
    return out.select("ray_id", "row", "col", micro(F.col("enter_t")).alias("enter_micro"), micro(F.col("leave_t")).alias("leave_micro"))


@query("g11_interval_clearance", f"{RAYS_CTE} SELECT ray_id, {micro_sql('min(clear)')} AS least_micro FROM clear GROUP BY ray_id HAVING NOT bool_or(s IS NULL)")
def interval_clearance(spark, sf_dir):
    out = sight.sight_lines(frame(spark, sf_dir, RAYS), grids.synthetic(spark), RES, ["ray_id"], 4096)
    return out.filter("least IS NOT NULL").select("ray_id", micro(F.col("least")).alias("least_micro"))


@query("g12_ray_verdict", f"{RAYS_CTE} SELECT ray_id, {VERDICT} AS state FROM clear GROUP BY ray_id")
def ray_verdict(spark, sf_dir):
    return sight.sight_lines(frame(spark, sf_dir, RAYS), grids.synthetic(spark), RES, ["ray_id"], 4096).select("ray_id", "state")


REASONS = """CASE WHEN row < 0 OR row > 63 OR col < 0 OR col > 63 THEN 'outside prepared coverage'
  WHEN far THEN 'beyond sparse interactive distance limit'
  WHEN bad THEN 'unknown observer cell' WHEN occupancy = 1 THEN 'building-occupied observer cell'
  WHEN out_mask = 0 THEN 'outside output boundary' END"""
OBSERVED = f"""observed AS (
  SELECT o.*, {REASONS} AS pre FROM (
    SELECT r.ray_id, CAST(floor(r.r1) AS INTEGER) AS row, CAST(floor(r.c1) AS INTEGER) AS col,
      sqrt((c1 - c0) ** 2 + (r1 - r0) ** 2) * {RES} > 180 AS far, g.occupancy, g.out_mask,
      g.surface IS NULL OR (g.quality & 248) <> 0 AS bad
    FROM rays r LEFT JOIN grid g ON g.row = floor(r.r1) AND g.col = floor(r.c1)) o)"""


def _observed(spark, sf_dir):
    """Observers with the first reason that keeps a sight line from being asked."""
    rays = frame(spark, sf_dir, RAYS)
    spot = rays.withColumn("row", F.floor("r1").cast("int")).withColumn("col", F.floor("c1").cast("int"))
    facts = spot.join(F.broadcast(grids.synthetic(spark)), ["row", "col"], "left")
    far = F.sqrt(F.pow(F.col("c1") - F.col("c0"), 2) + F.pow(F.col("r1") - F.col("r0"), 2)) * RES > 180
    bad = F.col("surface").isNull() | (F.col("quality").bitwiseAND(248) != 0)
    reason = (
        F.when((F.col("row") < 0) | (F.col("row") > 63) | (F.col("col") < 0) | (F.col("col") > 63), "outside prepared coverage")
        .when(far, "beyond sparse interactive distance limit")
        .when(bad, "unknown observer cell")
        .when(F.col("occupancy") == 1, "building-occupied observer cell")
        .when(F.col("out_mask") == 0, "outside output boundary")
    )
    return rays.join(facts.select("ray_id", reason.alias("pre")), "ray_id")


SPARSE = f"""{RAYS_CTE}, {OBSERVED}, lit AS (SELECT ray_id, {VERDICT} AS state FROM clear GROUP BY ray_id)
SELECT ray_id AS observer_id, CAST(CASE WHEN pre = 'unknown observer cell' THEN 3 WHEN pre IS NOT NULL THEN 2 ELSE state END AS INTEGER) AS state,
  coalesce(pre, CASE WHEN state = 3 THEN 'ray touches unknown coverage/height' END) AS reason
FROM observed JOIN lit USING (ray_id)"""


@query("g04_sparse_sight_lines", SPARSE)
def sparse(spark, sf_dir):
    seen = _observed(spark, sf_dir)
    lit = sight.sight_lines(seen.filter("pre IS NULL"), grids.synthetic(spark), RES, ["ray_id"], 4096).select("ray_id", F.col("state").alias("ray_state"))
    state = F.when(F.col("pre") == "unknown observer cell", 3).when(F.col("pre").isNotNull(), 2).otherwise(F.col("ray_state"))
    reason = F.coalesce("pre", F.when(state == 3, "ray touches unknown coverage/height"))
    return seen.join(lit, "ray_id", "left").select(F.col("ray_id").alias("observer_id"), state.cast("int").alias("state"), reason.alias("reason"))


@query("f09_observer_precheck", f"WITH {grids.SYNTHETIC_SQL}, rays AS ({RAYS}), {OBSERVED} SELECT coalesce(pre, 'clear') AS reason, count(*) AS observers FROM observed GROUP BY 1")
def precheck(spark, sf_dir):
    return _observed(spark, sf_dir).groupBy(F.coalesce("pre", F.lit("clear")).alias("reason")).agg(F.count(F.lit(1)).alias("observers"))


@query("a01_state_histogram", f"WITH h AS ({SPARSE.replace('WITH grid', 'WITH grid', 1)}) SELECT CAST(s AS INTEGER) AS state, count(h.state) AS n FROM range(4) t(s) LEFT JOIN h ON h.state = s GROUP BY s")
def histogram(spark, sf_dir):
    states = spark.range(4).select(F.col("id").cast("int").alias("state"))
    return states.join(sparse(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


TARGETS = "SELECT CAST(s_suppkey AS BIGINT) AS target_id, CAST(20 + s_suppkey * 11 % 24 AS INTEGER) AS trow, CAST(20 + s_suppkey * 5 % 24 AS INTEGER) AS tcol, CAST(40 + s_suppkey % 25 AS DOUBLE) AS tz FROM {supplier}"
RADIUS = 60.0
DENSE = f"""WITH {grids.SYNTHETIC_SQL}, targets AS ({TARGETS}),
around AS (SELECT t.*, g.*, (g.row - trow) * (g.row - trow) * {RES * RES} + (g.col - tcol) * (g.col - tcol) * {RES * RES} AS d2,
  surface IS NOT NULL AND (quality & 3) = 3 AND (quality & 248) = 0 AS known
  FROM targets t JOIN grid g ON abs(g.row - trow) <= {int(RADIUS // RES) + 1} AND abs(g.col - tcol) <= {int(RADIUS // RES) + 1}),
shown AS (SELECT *, d2 <= {RADIUS * RADIUS} + 1e-9 AND occupancy = 0 AND out_mask <> 0 AS open FROM around),
rays AS (SELECT target_id * 4096 + row * 64 + col AS ray_id, tcol + 0.5::DOUBLE AS c0, trow + 0.5::DOUBLE AS r0, tz AS z0, col + 0.5::DOUBLE AS c1, row + 0.5::DOUBLE AS r1, dtm + 1.7::DOUBLE AS z1 FROM shown WHERE open AND known),
{PIECES}, {CLEAR.replace('LEFT JOIN grid g', "LEFT JOIN (SELECT row, col, CASE WHEN (quality & 248) = 0 THEN surface END AS surface FROM grid) g")},
lit AS (SELECT ray_id, {VERDICT} AS state FROM clear GROUP BY ray_id),
dense AS (SELECT target_id, row, col, CAST(CASE WHEN NOT open THEN 2 WHEN NOT known THEN 3 ELSE lit.state END AS INTEGER) AS state
  FROM shown LEFT JOIN lit ON lit.ray_id = target_id * 4096 + row * 64 + col)"""


def _dense(spark, sf_dir):
    return block_view.viewshed(grids.synthetic(spark), frame(spark, sf_dir, TARGETS), RADIUS, RES, rows=4096)


@query("g01_relational_viewshed", f"{DENSE} SELECT * FROM dense")
def dense_relational(spark, sf_dir):
    """The same states by joins and one aggregation, for windows of any size."""
    return sight.viewshed(grids.synthetic(spark), frame(spark, sf_dir, TARGETS), RADIUS, RES, rows=4096)


@query("g01_dense_viewshed", f"{DENSE} SELECT * FROM dense")
def dense(spark, sf_dir):
    return _dense(spark, sf_dir)


@query("g02_dense_summary", f"{DENSE} SELECT target_id, count(*) FILTER (state = 1) AS visible, count(*) FILTER (state = 0) AS blocked, count(*) FILTER (state = 2) AS excluded, count(*) FILTER (state = 3) AS unknown FROM dense GROUP BY target_id")
def dense_summary(spark, sf_dir):
    return block_view.viewshed_counts(grids.synthetic(spark), frame(spark, sf_dir, TARGETS), RADIUS, RES, rows=4096)


#: A target of the region table in a large generated grid, its window of one kilometre.
WIDE, FAR = 4801, 1000.0
FAR_TARGETS = "SELECT CAST(r_regionkey AS BIGINT) AS target_id, CAST(2300 + 37 * r_regionkey AS INTEGER) AS trow, CAST(2350 - 41 * r_regionkey AS INTEGER) AS tcol, CAST(45 + 9 * r_regionkey AS DOUBLE) AS tz FROM {region}"
_H = int(FAR // RES) + 1
_TOP = lambda r, c: f"CASE WHEN ({r} * {WIDE} + {c}) % 997 = 13 THEN NULL WHEN {r} % 9 IN (3, 4) AND {c} % 7 IN (2, 3) THEN (3 * {r} + 5 * {c}) % 23 + 12 + (19 * ({c} // 7) + 31 * ({r} // 9)) % 17 ELSE (3 * {r} + 5 * {c}) % 23 END"
_LOW = lambda t: f"tz + ({t}) * dz - q * ({t}) * (1 - ({t}))"
#: Rays as slabs along their longer axis, and in each slab the cells of the shorter one that the closed ray meets.
FAR_SQL = f"""WITH targets AS ({FAR_TARGETS}),
cells AS (SELECT *, r - trow AS dr, c - tcol AS dc, {_TOP('r', 'c')} AS top, CAST((3 * r + 5 * c) % 23 AS DOUBLE) AS dtm FROM (
  SELECT t.*, CAST(trow + i AS BIGINT) AS r, CAST(tcol + j AS BIGINT) AS c FROM targets t, range({-_H}, {_H + 1}) a(i), range({-_H}, {_H + 1}) b(j))),
judged AS (SELECT *, (dr * dr + dc * dc) * {RES * RES} <= {FAR * FAR} + 1e-9 AND NOT (r % 9 IN (3, 4) AND c % 7 IN (2, 3)) AND c >= 4 AND r < {WIDE - 4} AS open, top IS NOT NULL AND NOT (r = 50 AND c = 50) AS known FROM cells),
rays AS (SELECT target_id, r, c, trow, tcol, tz, abs(dr) > abs(dc) AS by_row, greatest(abs(dr), abs(dc)) AS n, least(abs(dr), abs(dc)) AS m, sign(dr) AS sr, sign(dc) AS sc,
  dtm + 1.7::DOUBLE - tz AS dz, (6.0::DOUBLE / 7) * (dr * dr + dc * dc) * {RES * RES} / {EARTH_DIAMETER_M} AS q FROM judged WHERE open AND known AND (dr <> 0 OR dc <> 0)),
slabs AS (SELECT *, greatest(0, (k - 0.5::DOUBLE) / n) AS ta, least(1, (k + 0.5::DOUBLE) / n) AS tb FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM rays)),
met AS (SELECT *, unnest(range(CAST(ceil(m * ta - 0.5 - 1e-9) AS BIGINT), CAST(floor(m * tb + 0.5 + 1e-9) AS BIGINT) + 1)) AS j FROM slabs),
pieces AS (SELECT target_id, r, c, tz, dz, q,
  CASE WHEN m = 0 THEN ta ELSE least(tb, greatest(ta, (j - 0.5::DOUBLE) / m)) END AS t1, CASE WHEN m = 0 THEN tb ELSE greatest(ta, least(tb, (j + 0.5::DOUBLE) / m)) END AS t2,
  CAST(trow + sr * CASE WHEN by_row THEN k ELSE j END AS BIGINT) AS pr, CAST(tcol + sc * CASE WHEN by_row THEN j ELSE k END AS BIGINT) AS pc FROM met),
least_ AS (SELECT target_id, r, c, {_TOP('pr', 'pc')} AS s, CASE WHEN q > 0 THEN greatest(t1, least(t2, (q - dz) / (2 * q))) ELSE t2 END AS t, tz, dz, q FROM pieces),
lit AS (SELECT target_id, r, c, CASE WHEN bool_or(s IS NULL) THEN 3 WHEN min({_LOW('t')} - s) < -1e-6 THEN 0 ELSE 1 END AS state FROM least_ GROUP BY 1, 2, 3),
far AS (SELECT j.target_id, CASE WHEN NOT open THEN 2 WHEN NOT known THEN 3 WHEN dr = 0 AND dc = 0 THEN CASE WHEN least(tz, dtm + 1.7) - top < -1e-6 THEN 0 ELSE 1 END ELSE lit.state END AS state FROM judged j LEFT JOIN lit USING (target_id, r, c))"""


@query("g02_dense_summary_1km", f"{FAR_SQL} SELECT target_id, count(*) FILTER (state = 1) AS visible, count(*) FILTER (state = 0) AS blocked, count(*) FILTER (state = 2) AS excluded, count(*) FILTER (state = 3) AS unknown FROM far GROUP BY target_id")
def dense_summary_far(spark, sf_dir):
    return block_view.viewshed_counts(grids.synthetic(spark, WIDE), frame(spark, sf_dir, FAR_TARGETS), FAR, RES)


BEARINGS = """
SELECT CAST(c_custkey AS BIGINT) AS ray_id, 30.5 AS c0, 30.5 AS r0, 30.0 AS z0, 30.0 AS z1,
  CASE c_custkey % 4 WHEN 0 THEN 30.5 WHEN 1 THEN 60.25 WHEN 2 THEN 30.5 ELSE 1.25 END + (c_custkey % 7) AS c1,
  CASE c_custkey % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 30.5 WHEN 2 THEN 60.25 ELSE 30.5 END + (c_custkey % 5) * 0.5 AS r1
FROM {customer}"""
ANGLE = lambda d: f"degrees(atan2(s - z0 - (6.0::DOUBLE / 7) * ({d}) * ({d}) / {EARTH_DIAMETER_M}, {d}))"
BEARINGS_T = BEARINGS.replace("AS c0", "::DOUBLE AS c0").replace("AS r0", "::DOUBLE AS r0").replace("AS z0", "::DOUBLE AS z0").replace("30.0 AS z1", "30.0::DOUBLE AS z1").replace("(c_custkey % 7) AS c1", "(c_custkey % 7)::DOUBLE AS c1").replace("* 0.5 AS r1", "* 0.5::DOUBLE AS r1")


@query("g14_horizon", f"""WITH {grids.SYNTHETIC_SQL}, rays AS ({BEARINGS_T}), {PIECES},
reach AS (SELECT p.*, g.surface AS s, sqrt((c1 - c0) ** 2 + (r1 - r0) ** 2) * {RES} AS reach FROM pieces p LEFT JOIN grid g ON g.row = p.row AND g.col = p.col),
stops AS (SELECT ray_id, min(enter_t) AS stop_t FROM reach WHERE s IS NULL GROUP BY ray_id),
turned AS (SELECT r.*, stop_t, enter_t * reach AS lo, leave_t * reach AS hi, CASE WHEN s - z0 < 0 THEN sqrt(-(s - z0) * {EARTH_DIAMETER_M} / (6.0::DOUBLE / 7)) END AS turn FROM reach r LEFT JOIN stops USING (ray_id)),
seen AS (SELECT *, greatest(CASE WHEN lo > 0 THEN {ANGLE('lo')} END, CASE WHEN hi > 0 THEN {ANGLE('hi')} END, CASE WHEN turn > lo AND turn < hi THEN {ANGLE('turn')} END) AS angle FROM turned)
SELECT ray_id, {micro_sql('max(CASE WHEN enter_t < coalesce(stop_t, 2) THEN angle END)')} AS angle_micro, CAST(max(CASE WHEN stop_t IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS supported FROM seen GROUP BY ray_id""")
def horizon(spark, sf_dir):
    rays = frame(spark, sf_dir, BEARINGS)
    rays = rays.select("ray_id", *[F.col(c).cast("double").alias(c) for c in ("c0", "r0", "z0", "c1", "r1", "z1")])
    out = sight.horizon(rays, grids.synthetic(spark), RES, ["ray_id"], 4096)
    return out.select("ray_id", micro(F.col("angle")).alias("angle_micro"), F.col("supported").cast("int").alias("supported"))

"""Vector scans, file audits, sinks and caches."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..operators import sight
from ..session import shared_folder
from ..sources import contexts, grids
from .base import frame, micro, micro_sql, query
from .rank_queries import CANDS, SAME, spots
from .scalar_queries import TAGS, tagged
from .sight_queries import ANGLE, BEARINGS, BEARINGS_T, PIECES, RES


def n():
    return F.count(F.lit(1))


GROUPS = "SELECT l_suppkey % 40 AS file, l_orderkey * 64 AS start, l_partkey % 97 + 1 AS size FROM {lineitem}"


@query("s12_row_group_spans", f"SELECT file, count(*) FILTER (start < before) AS overlaps, count(*) FILTER (start - before > 640) AS gaps FROM (SELECT *, max(start + size) OVER (PARTITION BY file ORDER BY start, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({GROUPS})) GROUP BY file")
def s12(spark, d):
    w = Window.partitionBy("file").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    g = frame(spark, d, GROUPS).withColumn("before", F.max(F.col("start") + F.col("size")).over(w))
    return g.groupBy("file").agg(F.count_if(F.col("start") < F.col("before")).alias("overlaps"), F.count_if(F.col("start") - F.col("before") > 640).alias("gaps"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("k01_exclusive_sink", f"WITH {grids.SYNTHETIC_SQL} SELECT row, col, occupancy FROM grid")
def k01(spark, d):
    path = _folder(spark)
    contexts.write_once(grids.synthetic(spark).select("row", "col", "occupancy"), path)
    return spark.read.parquet(path)


@query("k02_partitioned_sink", f"WITH {grids.SYNTHETIC_SQL} SELECT row, col, CAST(row // 16 AS INTEGER) AS tile_row FROM grid WHERE row // 16 = 2")
def k02(spark, d):
    """A tiled write whose tile filter prunes folders on reading."""
    path = _folder(spark)
    contexts.write_once(grids.synthetic(spark).select("row", "col", grids.tile_key(F.col("row"), 16).alias("tile_row")).repartition("tile_row"), path, ["tile_row"])
    return spark.read.parquet(path).filter("tile_row = 2").select("row", "col", "tile_row")


@query("k03_atomic_json", "SELECT r_regionkey AS id, r_name AS name FROM {region}")
def k03(spark, d):
    path = _folder(spark)
    contexts.write_once(frame(spark, d, "SELECT r_regionkey AS id, r_name AS name FROM {region}"), path, fmt="json")
    return spark.read.schema("id int, name string").json(path)


@query("j18_same_experience_pairs", f"WITH s AS (SELECT * FROM ({CANDS})) SELECT c.id AS first, r.id AS second FROM s c JOIN s r ON c.id < r.id AND {SAME}")
def j18(spark, d):
    """Pairs of like experiences: equal targets, signatures and near bearings join, the distance decides."""
    from ..operators.ranking import same_pairs

    return same_pairs(spots(spark, d), ["target", "look"]).select("first", "second")


@query("w12_running_horizon", f"""WITH {grids.SYNTHETIC_SQL}, rays AS ({BEARINGS_T}), {PIECES},
cell AS (SELECT p.ray_id, min(enter_t) AS t, min(sqrt((c1 - c0) ** 2 + (r1 - r0) ** 2)) * {RES} AS reach, min(z0) AS z0, p.row, p.col, min(g.surface) AS s FROM pieces p JOIN grid g ON g.row = p.row AND g.col = p.col GROUP BY p.ray_id, p.row, p.col),
seen AS (SELECT *, t * reach AS d FROM cell WHERE t > 0 AND s IS NOT NULL),
run AS (SELECT *, {ANGLE('d')} AS angle FROM seen)
SELECT ray_id, count(*) FILTER (top) AS raises FROM (SELECT ray_id, angle > coalesce(max(angle) OVER (PARTITION BY ray_id ORDER BY t, row, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -90) + 1e-9 AS top FROM run) GROUP BY ray_id""")
def w12(spark, d):
    rays = frame(spark, d, BEARINGS)
    rays = rays.select("ray_id", *[F.col(c).cast("double").alias(c) for c in ("c0", "r0", "z0", "c1", "r1", "z1")])
    reach = F.sqrt(F.pow(F.col("c1") - F.col("c0"), 2) + F.pow(F.col("r1") - F.col("r0"), 2)) * RES
    cell = sight.pieces(rays.withColumn("reach", reach)).groupBy("ray_id", "row", "col").agg(F.min("enter_t").alias("t"), F.min("reach").alias("reach"), F.min("z0").alias("z0"))
    seen = sight.with_surface(cell, grids.synthetic(spark), 4096).filter("t > 0 AND cell_surface IS NOT NULL").withColumn("d", F.col("t") * F.col("reach"))
    angle = F.degrees(F.atan2(F.col("cell_surface") - F.col("z0") - (6 / 7) * F.col("d") * F.col("d") / geo.EARTH_DIAMETER_M, F.col("d")))
    w = Window.partitionBy("ray_id").orderBy("t", "row", "col").rowsBetween(Window.unboundedPreceding, -1)
    run = seen.withColumn("angle", angle)
    return run.withColumn("top", F.col("angle") > F.coalesce(F.max("angle").over(w), F.lit(-90.0)) + 1e-9).groupBy("ray_id").agg(F.count_if("top").alias("raises"))


@query("w14_recent_views", "SELECT user_id, event_type AS view FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS r FROM (SELECT user_id, event_type, max(ts) AS last FROM {events} GROUP BY 1, 2)) WHERE r <= 2")
def w14(spark, d):
    """What a cache of two views a user holds after all calls: the most recently used."""
    last = frame(spark, d, "SELECT user_id, event_type AS view, max(ts) AS last FROM {events} GROUP BY user_id, event_type")
    w = Window.partitionBy("user_id").orderBy(F.col("last").desc(), "view")
    return last.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("user_id", "view")

"""Scenes: samples of targets seen from standing points, sectors, scores and a diverse top three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scores
from .ordered import separated
from .ranking import greedy_top


def sample_reason(category: Column, endpoint: Column, observer: Column, target: Column, state: Column) -> Column:
    """Reason of a sample: rivers and unknown ends are unknown before any sight line counts."""
    return (
        F.when(category == "river", "water_surface_not_modelled")
        .when(endpoint != "clear", F.concat(F.lit("endpoint_"), endpoint))
        .when(observer != "ok", F.concat(F.lit("observer_"), observer))
        .when(target != "ok", F.concat(F.lit("target_"), target))
        .when(state == 3, "unknown_on_ray")
    )


def sample_state(reason: Column, state: Column) -> Column:
    """1 visible, 0 blocked, 2 excluded, 3 unknown."""
    excluded = reason.startswith("endpoint_") | reason.startswith("observer_")
    return F.when(reason.isNull(), state).when(excluded, 2).otherwise(3)


def sectors(samples: DataFrame, half: float = 35.0, apart: float = 50.0, most: int = 2) -> DataFrame:
    """Scenes of each standing point: up to two directions of visible samples that lie more
    than apart degrees from each other, with the samples within half of each direction.

    samples: spot, x, y, target, category, px, py, bearing, dist, state. A scene needs two
    visible samples at two places.
    """
    seen = samples.filter("state = 1").groupBy("spot").agg(F.array_sort(F.collect_list("bearing")).alias("all"))
    heads = seen.select("spot", F.explode(separated(F.col("all"), geo.angle_gap, apart, most)).alias("head"))
    near = samples.join(heads, "spot").withColumn("turn", F.pmod(F.col("bearing") - F.col("head") + 180, F.lit(360.0)) - 180).filter(F.abs("turn") <= half)
    lit = F.col("state") == 1
    per = near.groupBy("spot", "x", "y", "head").agg(
        F.count(F.lit(1)).alias("intended"),
        F.count_if(lit).alias("visible"),
        F.count_distinct(F.when(lit, F.struct("px", "py"))).alias("places"),
        (F.max(F.when(lit, F.col("turn"))) - F.min(F.when(lit, F.col("turn")))).alias("span"),
        F.array_sort(F.collect_set(F.when(lit, F.col("target")))).alias("targets"),
        F.array_sort(F.collect_set(F.when(lit, F.col("category")))).alias("categories"),
        F.count_distinct(F.when(lit & (F.col("category") == "city"), F.col("target"))).alias("buildings"),
    )
    per = per.filter("visible >= 2 AND places >= 2")
    return per.withColumn("categories", F.when(F.col("buildings") >= 2, F.array_sort(F.array_union("categories", F.array(F.lit("skyline"))))).otherwise(F.col("categories")))


def scored(scenes: DataFrame, wanted: list[str], kind: str, proximity: Column, radius: float, sun: Column) -> DataFrame:
    match = F.size(F.array_intersect(F.array(*[F.lit(w) for w in wanted]), F.col("categories"))) / len(wanted) if wanted else F.lit(1.0)
    shape = scores.composition(F.lit(kind), F.col("visible"), F.col("span"))
    return scenes.withColumn("score", scores.scene(match, F.col("visible"), F.col("intended"), shape, proximity, F.lit(radius), sun))


def diverse(scenes: DataFrame, k: int = 3) -> DataFrame:
    """The k best scenes that are not too like a better one."""

    def redundant(a: Column, b: Column) -> Column:
        d = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
        overlap = F.size(F.array_intersect(a["targets"], b["targets"])) / F.greatest(F.lit(1), F.size(F.array_union(a["targets"], b["targets"])))
        return ((d < 180) & (geo.angle_gap(a["head"], b["head"]) < 40)) | ((overlap > 0.75) & (d < 500))

    order = F.struct((-F.floor(F.col("score") * 100 + 0.5)).alias("s"), F.col("spot").alias("p"), F.col("head").alias("h"))
    return greedy_top(scenes, F.struct("spot", "x", "y", "head", "targets", "score"), order, redundant, k)

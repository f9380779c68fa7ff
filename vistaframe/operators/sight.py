"""Exact sight lines over closed constant-height cells, horizons and dense viewsheds.

A ray is cut where it crosses grid lines; between two cuts it lies in one cell (two
along an edge), and at a cut it touches every cell around the point. Cutting is array
arithmetic within the row of a ray, so the only shuffle is the one that gathers the
pieces of a ray (and the join on cells, unless the surface is small enough to send).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_DIAMETER_M

BLOCKED, VISIBLE, EXCLUDED, UNKNOWN = 0, 1, 2, 3
TOLERANCE = 1e-6
SMALL_SURFACE = 1_000_000


def touching(v: Column) -> Column:
    """Indices of the cells that a grid coordinate touches: two on a grid line."""
    near = F.rint(v)
    on = F.abs(v - near) <= 1e-9
    return F.when(on, F.array((near - 1).cast("int"), near.cast("int"))).otherwise(F.array(F.floor(v).cast("int")))


def _cuts(a: str, b: str) -> Column:
    """Ray parameters of the crossings of one axis."""
    lo, hi = F.ceil(F.least(a, b)).cast("int"), F.floor(F.greatest(a, b)).cast("int")
    every = F.transform(F.sequence(lo, hi), lambda i: (i - F.col(a)) / (F.col(b) - F.col(a)))
    return F.when((F.col(a) != F.col(b)) & (lo <= hi), F.filter(every, lambda t: (t > 0) & (t < 1))).otherwise(F.array().cast("array<double>"))


def pieces(rays: DataFrame) -> DataFrame:
    """Cells of each ray with the parameters where it enters and leaves them.

    rays: any columns with c0, r0, c1, r1 (grid coordinates). A cell may come in several
    pieces; touch_cells() merges them.
    """
    cut = rays.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _cuts("c0", "c1"), _cuts("r0", "r1")))))
    span = F.transform(
        F.sequence(F.lit(0), 2 * F.size("cuts") - 2),
        lambda i: F.struct(F.get("cuts", F.floor(i / 2).cast("int")).alias("enter"), F.get("cuts", F.floor((i + 1) / 2).cast("int")).alias("leave")),
    )
    cut = cut.withColumn("piece", F.explode(span)).drop("cuts")
    mid = (F.col("piece.enter") + F.col("piece.leave")) / 2
    at = lambda a, b: F.col(a) + mid * (F.col(b) - F.col(a))
    return cut.withColumn("row", F.explode(touching(at("r0", "r1")))).withColumn("col", F.explode(touching(at("c0", "c1")))).select("*", F.col("piece.enter").alias("enter_t"), F.col("piece.leave").alias("leave_t")).drop("piece")


def touch_cells(rays: DataFrame, key: str = "ray_id") -> DataFrame:
    """One row for each ray and touched cell: first and last parameter."""
    return pieces(rays).groupBy(key, "row", "col").agg(F.min("enter_t").alias("enter_t"), F.max("leave_t").alias("leave_t"))


def clearance(surface: Column, q: Column) -> Column:
    """Least height of the ray over a cell between enter_t and leave_t.

    q is curvature * distance^2 / diameter; the ray sags by q t (1 - t).
    """
    dz = F.col("z1") - F.col("z0")
    height = lambda t: F.col("z0") + t * dz - surface - q * t * (1 - t)
    a, b = F.col("enter_t"), F.col("leave_t")
    turn = F.try_divide(q - dz, 2 * q)
    inner = F.when((q > 0) & (turn > a) & (turn < b), height(turn))
    return F.least(height(a), height(b), inner)


def with_surface(cells: DataFrame, surface: DataFrame, rows: int | None = None) -> DataFrame:
    """Left join, so that a missing cell is unknown rather than clear."""
    side = surface.select("row", "col", F.col("surface").alias("cell_surface"))
    if rows is not None and rows <= SMALL_SURFACE:
        side = F.broadcast(side)
    return cells.join(side, ["row", "col"], "left")


def sag(distance: Column, curvature: float = 6 / 7) -> Column:
    return F.lit(curvature) * distance * distance / EARTH_DIAMETER_M


def verdict(least: Column, unknown: Column) -> Column:
    """Unknown beats blocked, blocked beats visible; contact within the tolerance is clear."""
    return F.when(unknown, UNKNOWN).when(least < -TOLERANCE, BLOCKED).otherwise(VISIBLE).cast("int")


def sight_lines(rays: DataFrame, surface: DataFrame, res: float, key: list[str], rows: int | None = None, curvature: float = 6 / 7) -> DataFrame:
    """State, least clearance and touched cells of each ray.

    rays: key columns, c0, r0, z0 (eye or target) to c1, r1, z1 in grid coordinates.
    """
    d = F.sqrt(F.pow(F.col("c1") - F.col("c0"), 2) + F.pow(F.col("r1") - F.col("r0"), 2)) * res
    cut = with_surface(pieces(rays.withColumn("q", sag(d, curvature))), surface, rows)
    return (
        cut.withColumn("clear", clearance(F.col("cell_surface"), F.col("q")))
        .groupBy(*key)
        .agg(F.min("clear").alias("least"), F.bool_or(F.col("cell_surface").isNull()).alias("unknown"), F.count_distinct("row", "col").alias("cells"))
        .select(*key, verdict(F.col("least"), F.col("unknown")).alias("state"), F.when(~F.col("unknown"), F.col("least")).alias("least"), "cells")
    )


def horizon(bearings: DataFrame, surface: DataFrame, res: float, key: list[str], rows: int | None = None, curvature: float = 6 / 7) -> DataFrame:
    """Largest elevation angle along each ray up to its first unknown cell.

    For a cell below the eye the angle has an inner extremum at sqrt(-h D / k).
    """
    d = F.sqrt(F.pow(F.col("c1") - F.col("c0"), 2) + F.pow(F.col("r1") - F.col("r0"), 2)) * res
    cut = with_surface(pieces(bearings.withColumn("reach", d)), surface, rows)
    h = F.col("cell_surface") - F.col("z0")
    angle = lambda at: F.degrees(F.atan2(h - curvature * at * at / EARTH_DIAMETER_M, at))
    lo, hi = F.col("enter_t") * F.col("reach"), F.col("leave_t") * F.col("reach")
    turn = F.when(h < 0, F.sqrt(-h * EARTH_DIAMETER_M / curvature))
    best = F.greatest(F.when(lo > 0, angle(lo)), F.when(hi > 0, angle(hi)), F.when((turn > lo) & (turn < hi), angle(turn)))
    first = cut.filter(F.col("cell_surface").isNull()).groupBy(*key).agg(F.min("enter_t").alias("stop_t"))
    seen = cut.withColumn("angle", best).join(first, key, "left")
    ahead = F.col("enter_t") < F.coalesce("stop_t", F.lit(2.0))
    return seen.groupBy(*key).agg(
        F.max(F.when(ahead, F.col("angle"))).alias("angle"),
        F.max(F.when(F.col("stop_t").isNull(), 1).otherwise(0)).alias("supported"),
        F.min(F.coalesce(F.col("stop_t"), F.lit(1.0)) * F.col("reach")).alias("supported_m"),
    )


def viewshed(cells: DataFrame, targets: DataFrame, radius: float, res: float, eye: float = 1.7, rows: int | None = None, curvature: float = 6 / 7) -> DataFrame:
    """State of every cell in a window around each target: target_id, row, col, state.

    targets: target_id, trow, tcol, tz (absolute). Cells outside the disk, occupied or
    masked are excluded after obstruction, so masks never remove obstacles; a cell of
    unknown ground is unknown.
    """
    half = int(radius // res) + 1
    span = F.sequence(F.lit(-half), F.lit(half))
    around = targets.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    around = around.select("target_id", "trow", "tcol", "tz", (F.col("trow") + F.col("dr")).alias("row"), (F.col("tcol") + F.col("dc")).alias("col"), ((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * res * res).alias("d2"))
    facts = cells if rows is None or rows > SMALL_SURFACE else F.broadcast(cells)
    placed = around.join(facts, ["row", "col"])
    inside = (F.col("d2") <= radius * radius + 1e-9) & (F.col("occupancy") == 0) & (F.col("out_mask") != 0)
    known = F.col("surface").isNotNull() & (F.col("quality").bitwiseAND(3) == 3) & (F.col("quality").bitwiseAND(248) == 0)
    placed = placed.withColumn("open", inside).withColumn("known", known)
    rays = placed.filter("open AND known").select(
        "target_id", "row", "col",
        (F.col("tcol") + 0.5).alias("c0"), (F.col("trow") + 0.5).alias("r0"), F.col("tz").alias("z0"),
        (F.col("col") + 0.5).alias("c1"), (F.col("row") + 0.5).alias("r1"), (F.col("dtm") + eye).alias("z1"),
    ).withColumnRenamed("row", "orow").withColumnRenamed("col", "ocol")
    blockers = cells.withColumn("surface", F.when((F.col("quality").bitwiseAND(3) == 3) & (F.col("quality").bitwiseAND(248) == 0), F.col("surface")))
    lit = sight_lines(rays, blockers, res, ["target_id", "orow", "ocol"], rows, curvature).select("target_id", F.col("orow").alias("row"), F.col("ocol").alias("col"), F.col("state").alias("ray_state"))
    state = F.when(~F.col("open"), EXCLUDED).when(~F.col("known"), UNKNOWN).otherwise(F.col("ray_state"))
    return placed.join(lit, ["target_id", "row", "col"], "left").select("target_id", "row", "col", state.cast("int").alias("state"))

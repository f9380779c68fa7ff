"""Buildings, surfaces, rasterising and masks of a prepared product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import cells_of


def height_cascade(measured: Column, floors: Column, floor_m: float, missing_m: float | None = None) -> Column:
    """struct(height, estimated, source): measured, floors, imputation, unresolved."""
    pack = lambda h, e, s: F.struct(h.cast("double").alias("height"), F.lit(e).alias("estimated"), F.lit(s).alias("source"))
    last = pack(F.lit(None), 0, "unresolved") if missing_m is None else pack(F.lit(missing_m), 1, "explicit_missing_height_imputation")
    return F.when(measured > 0, pack(measured, 0, "measured_height")).when(floors > 0, pack(floors * floor_m, 1, "above_ground_floors")).otherwise(last)


def burn_boxes(boxes: DataFrame, res: float, x0: float, y0: float) -> DataFrame:
    """Cells that each box touches (edges included): one row for a box and cell."""
    col = cells_of(F.col("minx") - x0, F.col("maxx") - x0, res)
    row = cells_of(F.lit(y0) - F.col("maxy"), F.lit(y0) - F.col("miny"), res)
    return boxes.withColumn("row", F.explode(row.cast("array<int>"))).withColumn("col", F.explode(col.cast("array<int>")))


def whole_cells(boxes: DataFrame, res: float, x0: float, y0: float) -> DataFrame:
    """Cells that lie wholly within each box."""
    first, last = F.ceil((F.col("minx") - x0) / res), F.floor((F.col("maxx") - x0) / res) - 1
    top, bottom = F.ceil((y0 - F.col("maxy")) / res), F.floor((y0 - F.col("miny")) / res) - 1
    some = boxes.filter((first <= last) & (top <= bottom))
    return some.withColumn("row", F.explode(F.sequence(top, bottom).cast("array<int>"))).withColumn("col", F.explode(F.sequence(first, last).cast("array<int>")))


def bases(burned: DataFrame, cells: DataFrame, key: str, by_maximum: bool = False) -> DataFrame:
    """Base, relief and completeness of the terrain below each footprint."""
    joined = burned.join(cells.select("row", "col", "dtm"), ["row", "col"], "left")
    base = F.max("dtm") if by_maximum else F.percentile("dtm", 0.5)
    return joined.groupBy(key).agg(base.alias("base"), F.max("dtm").alias("top"), (F.max("dtm") - F.min("dtm")).alias("relief"), F.bool_or(F.col("dtm").isNull()).alias("incomplete"))


def roofs(footprints: DataFrame, below: DataFrame, key: str, by_maximum: bool = False, slope_m: float = 20.0) -> DataFrame:
    """roof, unresolved and conflict of each footprint (height from height_cascade)."""
    f = footprints.join(below, key)
    unresolved = F.col("height").isNull() | F.col("base").isNull() | F.col("incomplete")
    roof = F.when(~unresolved, F.col("base") + F.col("height"))
    steep = (F.col("relief") > slope_m) & F.lit(not by_maximum)
    return f.withColumn("unresolved", unresolved).withColumn("roof", roof).withColumn("conflict", F.coalesce((roof < F.col("top") - 0.01) | (roof.isNotNull() & steep), F.lit(False)))


def surfaces(cells: DataFrame, burned: DataFrame, key: str) -> DataFrame:
    """Surface, occupancy and quality of every cell: the highest roof over a cell wins.

    burned: rows of (row, col, roof, estimated, unresolved, conflict). Quality bits: 1
    terrain, 2 coverage, 4 estimated, 8 unresolved, 16 conflict.
    """
    per = burned.groupBy("row", "col").agg(
        F.max("roof").alias("roof"), F.max("estimated").alias("estimated"), F.bool_or("unresolved").alias("unresolved"), F.bool_or("conflict").alias("conflict"), F.lit(1).alias("hit")
    )
    c = cells.select("row", "col", "dtm").join(per, ["row", "col"], "left")
    flag = lambda cond, bit: F.when(F.coalesce(cond, F.lit(False)), bit).otherwise(0)
    quality = flag(F.col("dtm").isNotNull(), 1) + F.lit(2) + flag(F.col("estimated") == 1, 4) + flag(F.col("unresolved"), 8) + flag(F.col("conflict"), 16)
    return c.select("row", "col", "dtm", F.greatest("dtm", "roof").alias("surface"), F.coalesce("hit", F.lit(0)).alias("occupancy"), quality.cast("int").alias("quality"))


def min_filter(cells: DataFrame, value: str) -> DataFrame:
    """Least value of the 3 x 3 cells around each cell (fewer at the border)."""
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    spread = cells.select(around("row"), "col", value).select("row", around("col"), value)
    least = spread.groupBy("row", "col").agg(F.min(value).alias(f"min_{value}"))
    return cells.join(least, ["row", "col"])


def uncertain(cells: DataFrame, regions: DataFrame, res: float, x0: float, y0: float, buffer_m: float = 5.0) -> DataFrame:
    """Reason of the last region (by order) whose buffered box touches each cell."""
    grown = regions.select("reason", "place", (F.col("minx") - buffer_m).alias("minx"), (F.col("miny") - buffer_m).alias("miny"), (F.col("maxx") + buffer_m).alias("maxx"), (F.col("maxy") + buffer_m).alias("maxy"))
    hit = burn_boxes(grown, res, x0, y0).groupBy("row", "col").agg(F.max_by("reason", "place").alias("reason"))
    return cells.join(hit, ["row", "col"], "left")


def window_sizes(points: DataFrame, largest: int, least: int, most: int, res: float, halo: float) -> DataFrame:
    """The largest power-of-two window (in cells) of each tile whose fullest window, halo
    included, holds at most most points. points: tile, px, py (metres from the tile's corner).

    All sizes are counted at once; a point counts in every window whose halo holds it.
    """
    sizes, s = [], largest
    while s >= least:
        sizes.append(s)
        s //= 2
    p = points.withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
    side = F.col("size") * res
    spread = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / side)), F.greatest(F.lit(0), F.floor((F.col(c) + halo) / side)))
    p = p.withColumn("wx", F.explode(spread("px"))).withColumn("wy", F.explode(spread("py")))
    full = p.groupBy("tile", "size", "wx", "wy").count().groupBy("tile", "size").agg(F.max("count").alias("fullest"))
    return full.groupBy("tile").agg(F.max(F.when(F.col("fullest") <= most, F.col("size"))).alias("size"))


def edge_target(ox: Column, oy: Column, cx: Column, cy: Column, res: float) -> tuple[Column, Column, Column]:
    """Where the segment from an observer to a cell's centre enters the cell's square: t, x, y.

    t is null if the observer is within the square.
    """
    half = res / 2

    def span(o: Column, c: Column) -> tuple[Column, Column]:
        d = c - o
        a, b = F.try_divide(c - half - o, d), F.try_divide(c + half - o, d)
        return F.when(d == 0, F.lit(0.0)).otherwise(F.least(a, b)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(a, b))

    (a1, b1), (a2, b2) = span(ox, cx), span(oy, cy)
    enter, leave = F.greatest(F.lit(0.0), a1, a2), F.least(F.lit(1.0), b1, b2)
    t = F.when((enter > 0) & (enter <= leave), enter)
    return t, ox + t * (cx - ox), oy + t * (cy - oy)


def tile_value_reason() -> Column:
    """Why a tile cell has no supported value (the first reason), or null."""
    q = F.col("quality")
    rules = [
        (F.col("tile_id").isNull(), "missing_tile"),
        (F.coalesce(F.col("disagrees"), F.lit(False)), "terrain_overlap_disagreement"),
        (F.col("uncertainty").isNotNull(), "uncertain_region"),
        (F.col("dtm").isNull() | (F.col("terrain_quality") != 1) | (q.bitwiseAND(1) == 0), "terrain_unsupported"),
        (F.col("contract_mask").bitwiseAND(1) == 0, "outside_requested_support"),
        ((q.bitwiseAND(2) != 2) | (F.col("occupancy") > 1), "obstruction_coverage_unknown"),
        ((q.bitwiseAND(248) != 0) | F.col("surface").isNull(), "obstruction_height_unknown"),
        ((F.col("surface") < F.col("dtm") - 1e-6) | ((F.col("occupancy") == 0) & (F.abs(F.col("surface") - F.col("dtm")) > 1e-6)), "surface_contract_violation"),
    ]
    return F.coalesce(*[F.when(rule, F.lit(reason)) for rule, reason in rules])

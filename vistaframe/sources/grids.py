"""Synthetic cell tables, tile grids, halos and affine indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic(spark: SparkSession, n: int = 64) -> DataFrame:
    """A deterministic n x n cell table: row, col, dtm, surface, occupancy, quality, out_mask.

    Buildings stand on a lattice; one surface value in 997 is missing, some heights are
    estimated (4) and one cell is unresolved (8).
    """
    r, c = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    cells = spark.range(n * n).select(r.alias("row"), c.alias("col"))
    bx, by = F.floor(F.col("col") / 7).cast("int"), F.floor(F.col("row") / 9).cast("int")
    occupied = (F.col("row") % 9).isin(3, 4) & (F.col("col") % 7).isin(2, 3)
    ground = (3 * F.col("row") + 5 * F.col("col")) % 23
    roof = ground + 12 + (19 * bx + 31 * by) % 17
    missing = (F.col("row") * n + F.col("col")) % 997 == 13
    quality = F.lit(3) + F.when(occupied & ((F.col("row") + F.col("col")) % 11 == 0), 4).otherwise(0) + F.when((F.col("row") == 50) & (F.col("col") == 50), 8).otherwise(0)
    return cells.select(
        "row",
        "col",
        ground.cast("double").alias("dtm"),
        F.when(~missing, F.when(occupied, roof).otherwise(ground)).cast("double").alias("surface"),
        occupied.cast("int").alias("occupancy"),
        quality.cast("int").alias("quality"),
        ((F.col("col") >= 4) & (F.col("row") < n - 4)).cast("int").alias("out_mask"),
    )


SYNTHETIC_SQL = """grid AS (
  SELECT *, CASE WHEN occupancy = 1 THEN 1 ELSE 0 END AS occ FROM (
  SELECT r AS row, c AS col, CAST((3 * r + 5 * c) % 23 AS DOUBLE) AS dtm,
    CASE WHEN (r * 64 + c) % 997 = 13 THEN NULL
      WHEN r % 9 IN (3, 4) AND c % 7 IN (2, 3) THEN CAST((3 * r + 5 * c) % 23 + 12 + (19 * (c // 7) + 31 * (r // 9)) % 17 AS DOUBLE)
      ELSE CAST((3 * r + 5 * c) % 23 AS DOUBLE) END AS surface,
    CASE WHEN r % 9 IN (3, 4) AND c % 7 IN (2, 3) THEN 1 ELSE 0 END AS occupancy,
    CAST(3 + CASE WHEN r % 9 IN (3, 4) AND c % 7 IN (2, 3) AND (r + c) % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN r = 50 AND c = 50 THEN 8 ELSE 0 END AS INTEGER) AS quality,
    CASE WHEN c >= 4 AND r < 60 THEN 1 ELSE 0 END AS out_mask
  FROM (SELECT CAST(id // 64 AS INTEGER) AS r, CAST(id % 64 AS INTEGER) AS c FROM range(4096) t(id))))"""


def window(cells: DataFrame, row0: int, col0: int, rows: int, cols: int) -> DataFrame:
    """A window of a cell table: a range filter that reaches the scan."""
    return cells.filter(F.col("row").between(row0, row0 + rows - 1) & F.col("col").between(col0, col0 + cols - 1))


def cleaned(c: Column, nodata: float) -> Column:
    """Elevations with the no-data value and NaN as null."""
    return F.when((c != F.lit(nodata)) & ~F.isnan(c), c)


def tile_key(c: Column, tile: int) -> Column:
    return F.floor(c / tile).cast("int")


def tile_grid(spark: SparkSession, xmin: float, ymin: float, xmax: float, ymax: float, tile_m: float = 5000.0, res: float = 5.0) -> DataFrame:
    """Tiles of a lattice fixed at the origin that cover the bounds: tile_id, tx, ty, bounds, width."""
    lo = lambda v: F.floor(F.lit(v) / tile_m).cast("int")
    hi = lambda v: (F.ceil(F.lit(v) / tile_m) - 1).cast("int")
    xs = spark.range(1).select(F.explode(F.sequence(lo(xmin), hi(xmax))).alias("tx"))
    both = xs.select("tx", F.explode(F.sequence(lo(ymin), hi(ymax))).alias("ty"))
    return both.select(
        F.format_string("x%d_y%d", "tx", "ty").alias("tile_id"),
        "tx",
        "ty",
        (F.col("tx") * tile_m).alias("minx"),
        (F.col("ty") * tile_m).alias("miny"),
        ((F.col("tx") + 1) * tile_m).alias("maxx"),
        ((F.col("ty") + 1) * tile_m).alias("maxy"),
        F.lit(int(tile_m / res)).alias("width"),
    )


def with_halo(tiles: DataFrame, halo_m: float, res: float = 5.0) -> DataFrame:
    """Tiles grown by whole cells on every side."""
    cells = F.ceil(F.lit(halo_m) / res).cast("int")
    d = cells * res
    return tiles.select("tile_id", (F.col("minx") - d).alias("minx"), (F.col("miny") - d).alias("miny"), (F.col("maxx") + d).alias("maxx"), (F.col("maxy") + d).alias("maxy"), (F.col("width") + 2 * cells).alias("width"))


def haloed_cells(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each cell once for every tile whose halo holds it: at most four copies for halo < tile."""
    spread = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    return cells.withColumn("tile_row", F.explode(spread("row"))).withColumn("tile_col", F.explode(spread("col")))


def cell_of(x: Column, y: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """Row and column of the containing cell (half-open)."""
    return F.floor((F.lit(y0) - y) / res).cast("int"), F.floor((x - x0) / res).cast("int")


def centre_of(row: Column, col: Column, x0: float, y0: float, res: float) -> tuple[Column, Column]:
    return F.lit(x0) + (col + 0.5) * res, F.lit(y0) - (row + 0.5) * res


def inverse_affine(x: Column, y: Column, gt: tuple) -> tuple[Column, Column]:
    """Grid coordinates (column, row) of a point under a general affine transform."""
    a, b, c, d, e, f = gt
    det = b * f - c * e
    if det == 0:
        raise ValueError("the transform has no inverse")
    dx, dy = x - a, y - d
    return (f * dx - c * dy) / det, (b * dy - e * dx) / det


def cell_valid() -> Column:
    """Supported terrain and obstruction coverage with resolved heights."""
    q = F.col("quality")
    return F.col("dtm").isNotNull() & F.col("surface").isNotNull() & (q.bitwiseAND(3) == 3) & (q.bitwiseAND(248) == 0) & (F.col("occupancy") <= 1)


def contract_violated(tolerance: float = 1e-6) -> Column:
    """Surface below terrain, or different from it where nothing stands."""
    return (F.col("surface") < F.col("dtm") - tolerance) | ((F.col("occupancy") == 0) & (F.abs(F.col("surface") - F.col("dtm")) > tolerance))

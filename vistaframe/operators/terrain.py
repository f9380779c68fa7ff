"""Terrain samples: triangulated interpolation with bounded edges, per tile.

A tile is one group of bounded size (its points and halo), so the triangulation runs in
a grouped Arrow kernel; Spark has no built-in for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (indices) of a Delaunay triangulation by incremental insertion."""
    n = len(points)
    if n < 3:
        return np.empty((0, 3), int)
    low, high = points.min(axis=0), points.max(axis=0)
    mid, span = (low + high) / 2, float((high - low).max()) or 1.0
    far = np.array([[mid[0] - 30 * span, mid[1] - span], [mid[0], mid[1] + 30 * span], [mid[0] + 30 * span, mid[1] - span]])
    p = np.vstack([points, far])
    tri = np.array([[n, n + 1, n + 2]])
    centre, radius2 = _circles(p, tri)
    for i in range(n):
        hit = ((centre - p[i]) ** 2).sum(axis=1) <= radius2 * (1 + 1e-12)
        bad = tri[hit]
        edges = np.sort(np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]]), axis=1)
        rim, count = np.unique(edges, axis=0, return_counts=True)
        rim = rim[count == 1]
        new = np.column_stack([rim, np.full(len(rim), i)])
        area = _cross(p[new[:, 0]], p[new[:, 1]], p[new[:, 2]])
        new = new[np.abs(area) > 1e-12 * span * span]
        c, r = _circles(p, new)
        tri, centre, radius2 = np.vstack([tri[~hit], new]), np.vstack([centre[~hit], c]), np.concatenate([radius2[~hit], r])
    return tri[(tri < n).all(axis=1)]


def _cross(a, b, c):
    return (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])


def _circles(p: np.ndarray, tri: np.ndarray):
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    d = 2 * _cross(a, b, c)
    d = np.where(d == 0, np.finfo(float).tiny, d)
    ab, ac = b - a, c - a
    l1, l2 = (ab**2).sum(axis=1), (ac**2).sum(axis=1)
    off = np.column_stack([ac[:, 1] * l1 - ab[:, 1] * l2, ab[:, 0] * l2 - ac[:, 0] * l1]) / d[:, None]
    return a + off, (off**2).sum(axis=1)


def interpolate(points: np.ndarray, z: np.ndarray, queries: np.ndarray, longest: float) -> np.ndarray:
    """Linear values at queries; NaN outside the hull or in triangles with an edge over longest."""
    out = np.full(len(queries), np.nan)
    unique, index = np.unique(points, axis=0, return_index=True)
    heights = z[index]
    for t in delaunay(unique):
        a, b, c = unique[t]
        if max(np.hypot(*(a - b)), np.hypot(*(b - c)), np.hypot(*(c - a))) > longest:
            continue
        d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        q = queries - a
        v = (q[:, 0] * (c[1] - a[1]) - q[:, 1] * (c[0] - a[0])) / d
        w = (q[:, 1] * (b[0] - a[0]) - q[:, 0] * (b[1] - a[1])) / d
        inside = (v >= -1e-9) & (w >= -1e-9) & (v + w <= 1 + 1e-9) & np.isnan(out)
        out[inside] = heights[t[0]] + v[inside] * (heights[t[1]] - heights[t[0]]) + w[inside] * (heights[t[2]] - heights[t[0]])
    return out


def interpolate_tiles(points: DataFrame, tile: str, side: int, res: float, longest: float) -> DataFrame:
    """Cells (tile, row, col, z) of side x side cells of each tile from its samples.

    points: tile, x, y (metres from the tile's lower corner, halo included), z. z is null
    where the terrain has no support.
    """

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        r, c = np.divmod(np.arange(side * side), side)
        centres = np.column_stack([(c + 0.5) * res, (r + 0.5) * res])
        z = interpolate(group[["x", "y"]].to_numpy(float), group["z"].to_numpy(float), centres, longest)
        return pd.DataFrame({tile: group[tile].iloc[0], "row": r.astype("int32"), "col": c.astype("int32"), "z": z})

    kind = points.schema[tile].dataType.simpleString()
    out = points.groupBy(tile).applyInPandas(kernel, f"{tile} {kind}, row int, col int, z double")
    from pyspark.sql import functions as F

    return out.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def interpolate_at(points: DataFrame, asked: DataFrame, tile: str, longest: float) -> DataFrame:
    """tile, probe, z of probes (tile, probe, x, y) by each tile's own samples (tile, x, y, z);
    z is null without support."""

    def kernel(samples: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(probes):
            return pd.DataFrame({tile: [], "probe": [], "z": []})
        z = interpolate(samples[["x", "y"]].to_numpy(float).reshape(-1, 2), samples["z"].to_numpy(float), probes[["x", "y"]].to_numpy(float), longest)
        return pd.DataFrame({tile: probes[tile].to_numpy(), "probe": probes["probe"].to_numpy(), "z": z})

    kind, probe = (points.schema[tile].dataType.simpleString(), asked.schema["probe"].dataType.simpleString())
    got = points.groupBy(tile).cogroup(asked.groupBy(tile)).applyInPandas(kernel, f"{tile} {kind}, probe {probe}, z double")
    from pyspark.sql import functions as F

    return got.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def seam_gaps(points: DataFrame, seams: DataFrame, tile: str, longest: float) -> DataFrame:
    """one, other, probes, supported, gap: how far neighbouring tiles differ at the same
    coordinates of their shared seam, each by its own samples. seams: one, other, probe, x, y."""
    from pyspark.sql import functions as F

    asked = seams.select(F.col("one").alias(tile), "probe", "x", "y").unionByName(seams.select(F.col("other").alias(tile), "probe", "x", "y")).distinct()
    z = interpolate_at(points, asked, tile, longest)
    side = lambda who, name: z.select(F.col(tile).alias(who), "probe", F.col("z").alias(name))
    both = seams.join(side("one", "here"), ["one", "probe"], "left").join(side("other", "there"), ["other", "probe"], "left")
    gap = F.abs(F.col("here") - F.col("there"))
    return both.groupBy("one", "other").agg(F.count(F.lit(1)).alias("probes"), F.count(gap).alias("supported"), F.max(gap).alias("gap"))

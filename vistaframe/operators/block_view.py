"""Dense viewsheds by one kernel, for windows of any size.

A ray from a target to a cell is cut into slabs, one for each cell along its longer axis.
In a slab a ray lies in one cell or crosses into the next; where it meets a grid corner it
touches further cells at a point. All rays of an octant are followed at once from the
observer towards the target, slab by slab, and a ray is let go as soon as its state is
sure: when it is blocked, or when it has risen above every cell that is nearer to the
target (an unknown cell beats both, so a ray is followed as long as one may come). The
ray's height over a cell is convex in its parameter, so its least value is at the turning
point clipped to the piece. The states are those of the relational form (`sight.viewshed`).

Cells travel in tiles, each once for every target or octant that looks over it; a group is
one target's window, or for windows beyond WHOLE cells one octant of it, whose size the
radius bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_DIAMETER_M
from ..session import ship
from . import sight

#: Half width, in cells, of the largest window that is one group.
WHOLE = 64
#: Rays that are followed at once.
BATCH = 1 << 15
#: Octants: signs of the longer and of the shorter axis, and whether rows are the longer one.
OCTANTS = tuple((a, b, r) for a in (1, -1) for b in (1, -1) for r in (0, 1))


def follow(s: np.ndarray, n: np.ndarray, m: np.ndarray, dz: np.ndarray, q: np.ndarray, tz: float) -> np.ndarray:
    """States of rays in one octant.

    s: surface by (longer, shorter) offset from the target, NaN where unknown, with a column
    more than rows; n > 0, 0 <= m <= n: offsets of each ray's end; dz: its height there less
    that of the target, tz; q: its sag.
    """
    known = np.where(np.isnan(s), -np.inf, s)
    tops = np.maximum.accumulate(known.max(axis=1))
    holes = np.logical_or.accumulate(np.isnan(s).any(axis=1))
    flat, width = s.ravel(), s.shape[1]
    out = np.full(len(n), sight.VISIBLE)
    order = np.argsort(n, kind="stable")
    for at in range(0, len(order), BATCH):
        i = order[at : at + BATCH]
        out[i] = _follow_batch(flat, width, tops, holes, n[i], m[i].astype(float), dz[i], q[i], tz)
    return out


def _follow_batch(flat, width, tops, holes, n, m, dz, q, tz) -> np.ndarray:
    state = np.full(len(n), sight.VISIBLE)
    live, k = np.arange(len(n)), n.copy()
    length = n.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(q > 0, (q - dz) / (2 * q), np.where(dz < 0, np.inf, -np.inf))

    def low(t1, t2, d, c, turning):
        """Least height of the ray between two parameters."""
        t = np.minimum(np.maximum(turning, t1), t2)
        return tz + t * (d - c * (1 - t))

    def check(rays, cell, t1, t2):
        top = flat[cell]
        least = low(t1, t2, dz[rays], q[rays], turn[rays]) - top
        return least < -sight.TOLERANCE, np.isnan(top)

    while len(live):
        ta, tb = np.maximum(0.0, (k - 0.5) / length), np.minimum(1.0, (k + 0.5) / length)
        va, vb = m * ta + 0.5, m * tb + 0.5
        ra, rb = np.floor(va + 1e-9).astype(np.int64), np.ceil(vb - 1e-9).astype(np.int64) - 1
        base = k * width
        split = np.flatnonzero(rb > ra)
        cross = tb.copy()
        cross[split] = (ra[split] + 0.5) / m[split]
        top = flat[base + ra]
        hit = low(ta, cross, dz, q, turn) - top < -sight.TOLERANCE
        hole = np.isnan(top)
        every = np.arange(len(live))
        for rays, cell, t1, t2 in (
            (split, base[split] + rb[split], cross[split], tb[split]),
            *((on, base[on] + row[on], t[on], t[on]) for on, row, t in ((every[(np.abs(va - np.rint(va)) <= 1e-9) & (ra > 0)], ra - 1, ta), (every[np.abs(vb - np.rint(vb)) <= 1e-9], rb + 1, tb))),
        ):
            if len(rays):
                more, empty = check(rays, cell, t1, t2)
                hit[rays] |= more
                hole[rays] |= empty
        state[live[hit & (state[live] != sight.UNKNOWN)]] = sight.BLOCKED
        state[live[hole]] = sight.UNKNOWN
        clear = low(0.0, ta, dz, q, turn) > tops[k]
        done = (k == 0) | hole | (~holes[k] & ((state[live] == sight.BLOCKED) | clear))
        if done.any():
            keep = ~done
            live, k, m, dz, q, turn, length = live[keep], k[keep], m[keep], dz[keep], q[keep], turn[keep], length[keep]
        k = k - 1
    return state


def octant_states(octant: tuple, dr: np.ndarray, dc: np.ndarray, asked: np.ndarray, surface: np.ndarray, z: np.ndarray, tz: float, half: int, res: float, curvature: float) -> np.ndarray:
    """States of the asked cells that the octant owns (-1 for the others).

    dr, dc: offsets of cells from the target; surface: NaN where unknown; z: eye heights.
    """
    sign_a, sign_b, by_row = octant
    a, b = (dr, dc) if by_row else (dc, dr)
    a, b = sign_a * a, sign_b * b
    s = np.full((half + 1, half + 3), -np.inf)
    near = (a >= 0) & (b >= 0) & (a <= half) & (b <= np.minimum(a + 1, half + 2))
    # a cell that the table lacks is unknown; the ones beyond the diagonal's neighbours are not met
    rows, cols = np.indices(s.shape)
    s[cols <= rows + 1] = np.nan
    s[a[near], b[near]] = surface[near]
    out = np.full(len(dr), -1)
    mine = asked & owned(octant, dr, dc)
    i = np.flatnonzero(mine)
    n, m = a[i], b[i]
    d2 = (n.astype(float) ** 2 + m.astype(float) ** 2) * res * res
    reach = int(n.max(initial=0))
    out[i] = follow(s[: reach + 1], n, m, z[i] - tz, curvature * d2 / EARTH_DIAMETER_M, tz) if len(i) else out[i]
    return out


def owned(octant: tuple, dr: np.ndarray, dc: np.ndarray) -> np.ndarray:
    """Cells whose rays the octant follows: each cell but the target's own has one octant."""
    sign_a, sign_b, by_row = octant
    longer = np.abs(dr) > np.abs(dc) if by_row else np.abs(dc) >= np.abs(dr)
    a, b = (dr, dc) if by_row else (dc, dr)
    return longer & (a * sign_a > 0) & ((b * sign_b > 0) | ((b == 0) & (sign_b > 0)))


def tiled(cells: DataFrame, tile: int) -> DataFrame:
    """tile_row, tile_col, cells: an array of the cells of each square tile."""
    key = lambda c: F.floor(F.col(c) / tile).cast("int")
    cell = F.struct("row", "col", "dtm", "surface", "occupancy", "quality", "out_mask")
    return cells.select(key("row").alias("tile_row"), key("col").alias("tile_col"), cell.alias("cell")).groupBy("tile_row", "tile_col").agg(F.collect_list("cell").alias("cells"))


def _kernel(half: int, radius: float, res: float, eye: float, curvature: float, counts: bool):
    def run(group: pa.Table) -> pa.Table:
        cells = pa.concat_arrays([c.flatten() for c in group.column("cells").chunks])
        get = lambda name, t: cells.field(name).to_numpy(zero_copy_only=False).astype(t)
        one = lambda name: group.column(name)[0].as_py()
        target, tz, sector = one("target_id"), float(one("tz")), int(one("sector"))
        row, col = get("row", np.int64), get("col", np.int64)
        dr, dc = row - int(one("trow")), col - int(one("tcol"))
        inside = (np.abs(dr) <= half) & (np.abs(dc) <= half)
        row, col, dr, dc = row[inside], col[inside], dr[inside], dc[inside]
        quality, top, dtm = get("quality", np.int64)[inside], get("surface", float)[inside], get("dtm", float)[inside]
        sound = ((quality & 3) == 3) & ((quality & 248) == 0)
        surface = np.where(sound, top, np.nan)
        d2 = (dr * dr + dc * dc) * res * res
        shown = (d2 <= radius * radius + 1e-9) & (get("occupancy", np.int64)[inside] == 0) & (get("out_mask", np.int64)[inside] != 0)
        known = sound & ~np.isnan(top)
        z, asked = dtm + eye, shown & known
        state = np.where(~shown, sight.EXCLUDED, np.where(~known, sight.UNKNOWN, -1))
        own = (dr == 0) & (dc == 0)
        state[own & asked] = np.where(np.minimum(tz, z[own & asked]) - top[own & asked] < -sight.TOLERANCE, sight.BLOCKED, sight.VISIBLE)
        mine = np.zeros(len(row), bool)
        for i, octant in enumerate(OCTANTS):
            if sector in (-1, i):
                mine |= owned(octant, dr, dc) | (own & (i == 0))
                got = octant_states(octant, dr, dc, asked & ~own, surface, z, tz, half, res, curvature)
                state = np.where(got >= 0, got, state)
        if counts:
            n = np.bincount(state[mine], minlength=4)
            return pa.table({"target_id": pa.array([target], group.schema.field("target_id").type), **{c: pa.array([int(n[s])], pa.int64()) for c, s in COUNTS}})
        size = int(mine.sum())
        return pa.table({"target_id": pa.array([target] * size, group.schema.field("target_id").type), "row": pa.array(row[mine], pa.int32()), "col": pa.array(col[mine], pa.int32()), "state": pa.array(state[mine], pa.int32())})

    return run


COUNTS = (("visible", sight.VISIBLE), ("blocked", sight.BLOCKED), ("excluded", sight.EXCLUDED), ("unknown", sight.UNKNOWN))


def _looked(cells: DataFrame, targets: DataFrame, half: int, rows: int | None, tiles: int | None) -> DataFrame:
    """Rows of a target (and octant, else -1) with the tiles that it looks over."""
    ship(cells.sparkSession)
    tile = tiles or max(8, min(256, half))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / tile).cast("int"), F.floor((F.col(c) + half) / tile).cast("int")))
    around = targets.select("target_id", "trow", "tcol", "tz").withColumn("tile_row", span("trow")).withColumn("tile_col", span("tcol"))
    if half <= WHOLE:
        around = around.withColumn("sector", F.lit(-1))
    else:
        around = around.withColumn("sector", F.explode(F.array(*[F.lit(i) for i in range(len(OCTANTS))]))).filter(_meets(tile))
    if not tiles:
        need = around.select("tile_row", "tile_col").distinct()
        box = need.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("tile_row", "tile_col")]).first()
        if box["low_tile_row"] is not None:  # a range filter that reaches the scan
            for c in ("row", "col"):
                cells = cells.filter(F.col(c).between(box[f"low_tile_{c}"] * tile, (box[f"high_tile_{c}"] + 1) * tile - 1))
    side = cells if tiles else tiled(cells, tile)
    return around.join(F.broadcast(side) if rows is not None and rows <= sight.SMALL_SURFACE else side, ["tile_row", "tile_col"])


def _meets(tile: int):
    """Whether a tile may hold cells that the rays of an octant touch."""
    out = F.lit(False)
    low_r, low_c = F.col("tile_row") * tile - F.col("trow"), F.col("tile_col") * tile - F.col("tcol")
    for i, (sign_a, sign_b, by_row) in enumerate(OCTANTS):
        a, b = (low_r, low_c) if by_row else (low_c, low_r)
        far = lambda v, sign: v + tile - 1 if sign > 0 else -v
        near = lambda v, sign: v if sign > 0 else -(v + tile - 1)
        out = F.when(F.col("sector") == i, (far(a, sign_a) >= 0) & (far(b, sign_b) >= 0) & (near(b, sign_b) <= far(a, sign_a) + 1)).otherwise(out)
    return out


def viewshed(cells: DataFrame, targets: DataFrame, radius: float, res: float, eye: float = 1.7, rows: int | None = None, curvature: float = 6 / 7, tiles: int | None = None) -> DataFrame:
    """target_id, row, col, state of every cell in a window around each target, as
    sight.viewshed.

    cells: a cell table, or with tiles (their side) what tiled() made of one; rows: its
    counted rows, for a broadcast within a bound.
    """
    half = int(radius // res) + 1
    kind = targets.schema["target_id"].dataType.simpleString()
    looked = _looked(cells, targets, half, rows, tiles)
    return looked.groupBy("target_id", "sector").applyInArrow(_kernel(half, radius, res, eye, curvature, False), f"target_id {kind}, row int, col int, state int")


def viewshed_counts(cells: DataFrame, targets: DataFrame, radius: float, res: float, eye: float = 1.7, rows: int | None = None, curvature: float = 6 / 7, tiles: int | None = None) -> DataFrame:
    """target_id, visible, blocked, excluded, unknown: counts of the states of viewshed(),
    which then never become rows."""
    half = int(radius // res) + 1
    kind = targets.schema["target_id"].dataType.simpleString()
    looked = _looked(cells, targets, half, rows, tiles)
    got = looked.groupBy("target_id", "sector").applyInArrow(_kernel(half, radius, res, eye, curvature, True), f"target_id {kind}, " + ", ".join(f"{c} long" for c, _ in COUNTS))
    return got.groupBy("target_id").agg(*[F.sum(c).alias(c) for c, _ in COUNTS])

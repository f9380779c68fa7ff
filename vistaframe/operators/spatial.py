"""Spatial joins as equi-joins on a grid of buckets, with the exact predicate behind.

A range join planned as it is written becomes a nested loop; here each side is placed
in the grid cells it covers, so the join shuffles on the cell and never compares a
point with a box that shares no cell. Pairs of boxes that share several cells are kept
in the one cell that holds the lower corner of their overlap, so no distinct is needed.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import shared_folder


def cells_of(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))


def covering(df: DataFrame, cell: float, box: tuple[str, str, str, str] = ("minx", "miny", "maxx", "maxy")) -> DataFrame:
    a, b, c, d = (F.col(x) for x in box)
    return df.withColumn("gx", F.explode(cells_of(a, c, cell))).withColumn("gy", F.explode(cells_of(b, d, cell)))


def point_in_box(points: DataFrame, boxes: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """points (x, y) joined to boxes (minx, miny, maxx, maxy) that hold them, edges included."""
    placed = points.withColumn("gx", F.floor(F.col("x") / cell).cast("long")).withColumn("gy", F.floor(F.col("y") / cell).cast("long"))
    wide = covering(boxes, cell).withColumnRenamed("gx", "bx").withColumnRenamed("gy", "by")
    inside = (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy"))
    out = placed.join(wide, (F.col("gx") == F.col("bx")) & (F.col("gy") == F.col("by")) & inside, how)
    return out.drop("gx", "gy", "bx", "by")


def overlaps(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, g: Column, h: Column) -> Column:
    """Boxes (a b c d) and (e f g h), as minx miny maxx maxy, meet."""
    return (a <= g) & (e <= c) & (b <= h) & (f <= d)


def box_overlap(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of meeting boxes; right's columns get the prefix o_."""
    right = right.select(*[F.col(c).alias(f"o_{c}") for c in right.columns])
    l_side = covering(left, cell)
    r_side = covering(right, cell, ("o_minx", "o_miny", "o_maxx", "o_maxy")).withColumnRenamed("gx", "hx").withColumnRenamed("gy", "hy")
    c = F.col
    meet = overlaps(c("minx"), c("miny"), c("maxx"), c("maxy"), c("o_minx"), c("o_miny"), c("o_maxx"), c("o_maxy"))
    first = (c("gx") == F.floor(F.greatest("minx", "o_minx") / cell)) & (c("gy") == F.floor(F.greatest("miny", "o_miny") / cell))
    return l_side.join(r_side, (c("gx") == c("hx")) & (c("gy") == c("hy")) & meet & first).drop("gx", "gy", "hx", "hy")


def iou() -> Column:
    """Intersection over union of a pair from box_overlap."""
    c = F.col
    w = F.least("maxx", "o_maxx") - F.greatest("minx", "o_minx")
    h = F.least("maxy", "o_maxy") - F.greatest("miny", "o_miny")
    both = w * h
    one = (c("maxx") - c("minx")) * (c("maxy") - c("miny"))
    two = (c("o_maxx") - c("o_minx")) * (c("o_maxy") - c("o_miny"))
    return both / (one + two - both)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring ARRAY<STRUCT<x,y>> (not closed); points on an edge as they fall."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, ((i + 1) % n).cast("int"))
        over = (a["y"] > y) != (b["y"] > y)
        return (over & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])).cast("int")

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


#: Regions of a cell, by their ids, that every point is compared with; the others only meet
#: points which none of these holds.
FIRST_REGIONS = 32


def assign_smallest(points: DataFrame, regions: DataFrame, cell: float, key: str, region: str) -> DataFrame:
    """Each point with the smallest id of the regions (box and ring) that hold it, or null.

    A place is looked up once, however many points stand there. A cell's regions come in the
    order of their ids, so where one of its first holds a place, the rest cannot hold a smaller.
    """
    places = points.select("x", "y").distinct()
    placed = places.withColumn("gx", F.floor(F.col("x") / cell).cast("long")).withColumn("gy", F.floor(F.col("y") / cell).cast("long"))
    turn = F.row_number().over(Window.partitionBy("gx", "gy").orderBy(region))
    wide = covering(regions.filter(F.col(region).isNotNull()), cell).select("gx", "gy", region, "minx", "miny", "maxx", "maxy", "ring", turn.alias("_turn"))
    inside = (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy"))

    def smallest(asked: DataFrame, among: DataFrame) -> DataFrame:
        held = asked.join(among, ["gx", "gy"]).filter(inside).filter(in_ring(F.col("x"), F.col("y"), F.col("ring")))
        return held.groupBy("x", "y").agg(F.min(region).alias(region))

    first = smallest(placed, wide.filter(F.col("_turn") <= FIRST_REGIONS))
    left = placed.join(first, ["x", "y"], "left_anti")
    found = first.unionByName(smallest(left, wide.filter(F.col("_turn") > FIRST_REGIONS)))
    best = points.select(key, "x", "y").join(found, ["x", "y"]).groupBy(key).agg(F.min(region).alias(region))
    return points.join(best, key, "left")


def nearest(origins: DataFrame, nodes: DataFrame, radius: float, origin: str, node: str) -> DataFrame:
    """The nearest node within radius of each origin, ties to the smaller id.

    Both sides have x and y; origins look into the buckets around them, whose side is
    the radius, so nothing farther is compared.
    """
    spread = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = origins.withColumn("gx", F.explode(F.transform(spread, lambda d: F.floor(F.col("x") / radius).cast("long") + d))).withColumn("gy", F.explode(F.transform(spread, lambda d: F.floor(F.col("y") / radius).cast("long") + d)))
    there = nodes.select(F.col(node), F.col("x").alias("nx"), F.col("y").alias("ny"), F.floor(F.col("x") / radius).cast("long").alias("gx"), F.floor(F.col("y") / radius).cast("long").alias("gy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))
    near = asked.join(there, ["gx", "gy"]).withColumn("metres", d).filter(F.col("metres") <= radius)
    return near.groupBy(origin).agg(F.min(F.struct("metres", node)).alias("best")).select(origin, f"best.{node}", "best.metres")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, key: str, at: str, other_at: str, other: str) -> DataFrame:
    """The row of right nearest in seconds to each row of left, within tolerance; ties to
    the earlier, then to the smaller id.

    One pass over both sides in order of time, cut into ranges of about equal size whatever
    the times are: the last one before and the first one after are the only candidates, and
    what lies beyond a range's edges is carried in from the other ranges, so no pairs are made.
    """
    from .ordered import in_ranges

    times = right.groupBy(F.col(other_at).alias("t")).agg(F.min(other).alias("hit"))
    kind = left.schema[key].dataType
    given = times.select("t", F.lit(0).alias("asks"), F.lit(None).cast(kind).alias(key), F.struct("t", "hit").alias("one"))
    asked = left.select(F.col(at).cast(times.schema["t"].dataType).alias("t"), F.lit(1).alias("asks"), key, F.lit(None).cast(given.schema["one"].dataType).alias("one"))
    rows = in_ranges(given.unionByName(asked), [F.col("t"), F.col("asks"), F.col(key)])
    edges = rows.groupBy("_range").agg(F.max("one").alias("last"), F.min("one").alias("first"))
    w = Window.orderBy("_range")
    edges = edges.select("_range", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("came"), F.min("first").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("comes"))
    # both look back, one against the order: a frame that looks ahead is worked out anew for each row
    order, against = Window.partitionBy("_range").orderBy("t", "asks"), Window.partitionBy("_range").orderBy(F.col("t").desc(), F.col("asks").desc())
    back, ahead = (F.last("one", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (order, against))
    seen = rows.withColumn("back", back).withColumn("ahead", ahead).filter("asks = 1").join(F.broadcast(edges), "_range")
    seen = seen.withColumn("back", F.coalesce("back", "came")).withColumn("ahead", F.coalesce("ahead", "comes"))
    before, after = F.col("t") - F.col("back.t"), F.col("ahead.t") - F.col("t")
    late = F.coalesce(after < before, F.col("back").isNull())
    best = seen.select(key, F.when(late, F.col("ahead.hit")).otherwise(F.col("back.hit")).alias(other), F.when(late, after).otherwise(before).alias("gap"))
    return best.filter(F.col("gap") <= tolerance)


def vetoed(rows: DataFrame, restricted: DataFrame) -> DataFrame:
    """Rows without a restricted record at the same place (to a millimetre)."""
    at = lambda df: [F.round(df["x"], 3).alias("vx"), F.round(df["y"], 3).alias("vy")]
    keyed = rows.select("*", *at(rows))
    return keyed.join(restricted.select(*at(restricted)).distinct(), ["vx", "vy"], "left_anti").drop("vx", "vy")


def box_gap() -> Column:
    """Distance of a point (x, y) from a box, 0 inside it."""
    gap = lambda a, v, b: F.greatest(F.col(a) - F.col(v), F.lit(0.0), F.col(v) - F.col(b))
    return F.sqrt(F.pow(gap("minx", "x", "maxx"), 2) + F.pow(gap("miny", "y", "maxy"), 2))


def within_of_box(points: DataFrame, boxes: DataFrame, radius: float, key: str, box: str) -> DataFrame:
    """key, box, metres of the nearest box within radius of each point, ties to the smaller id.

    Boxes grown by the radius stand in buckets as wide as it, so nothing farther is compared.
    """
    c = F.col
    grown = boxes.select(box, *[c(v).alias(f"o_{v}") for v in ("minx", "miny", "maxx", "maxy")], (c("minx") - radius).alias("minx"), (c("miny") - radius).alias("miny"), (c("maxx") + radius).alias("maxx"), (c("maxy") + radius).alias("maxy"))
    near = point_in_box(points.select(key, "x", "y"), grown, max(radius, 1e-9)).select(key, "x", "y", box, *[c(f"o_{v}").alias(v) for v in ("minx", "miny", "maxx", "maxy")])
    near = near.withColumn("metres", box_gap()).filter(c("metres") <= radius)
    return near.groupBy(key).agg(F.min(F.struct("metres", box)).alias("best")).select(key, f"best.{box}", "best.metres")


def nearest_box(points: DataFrame, boxes: DataFrame, radius: float, key: str, box: str, growth: float = 4.0) -> DataFrame:
    """key, box, metres of the nearest of all boxes to each point, however far.

    The radius grows until every point has found one; each round takes only the points that
    are left, and the answer within a radius is final. Without boxes there is no answer.
    """
    if not boxes.head(1):
        return points.select(key).join(boxes.select(box), F.lit(False)).withColumn("metres", F.lit(0.0))
    left, found = kept(points.select(key, "x", "y"), "points"), None
    while left.head(1):
        got = kept(within_of_box(left, boxes, radius, key, box), "nearest")
        found = got if found is None else found.unionByName(got)
        left = kept(left.join(got.select(key), key, "left_anti"), "points")
        radius *= growth
    return found if found is not None else within_of_box(left, boxes, radius, key, box)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the session's shared folder and read again: a cut lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_product(left: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """Every row of left with every row of few, which may hold at most `most` rows; more are an
    error. The few rows travel as literals of the plan."""
    rows = few.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to multiply with")
    kind = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), ArrayType(few.schema))
    return left.withColumn("_each", F.explode(kind)).select(*left.columns, "_each.*")


def with_extents(objects: DataFrame, extents: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """objects with the box of each (minx, miny, maxx, maxy); an object without one is an error,
    or with strict off a row with extent_missing."""
    lost = F.col("minx").isNull() | F.col("miny").isNull() | F.col("maxx").isNull() | F.col("maxy").isNull()
    both = objects.join(extents.select(key, "minx", "miny", "maxx", "maxy"), key, "left")
    if strict:
        return both.withColumn("minx", F.when(lost, F.raise_error(F.concat(F.lit("no extent of "), F.col(key).cast("string"))).cast("double")).otherwise(F.col("minx")))
    return both.withColumn("extent_missing", lost)


def buffered_extents(boxes: DataFrame, buffers: dict[str, float]) -> DataFrame:
    """name, minx, miny, maxx, maxy, area of the hull of all boxes grown by each buffer with
    round corners."""
    c = F.col
    hull = boxes.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    grown = hull.withColumn("b", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("d")) for n, v in buffers.items()])))
    d, w, h = c("b.d"), c("maxx") - c("minx"), c("maxy") - c("miny")
    area = w * h + 2 * d * (w + h) + F.lit(math.pi) * d * d
    return grown.select(c("b.name").alias("name"), (c("minx") - d).alias("minx"), (c("miny") - d).alias("miny"), (c("maxx") + d).alias("maxx"), (c("maxy") + d).alias("maxy"), area.alias("area"))

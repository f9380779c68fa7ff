"""Target inventories, name search, viewports and schematics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of the states, in the order blocked, visible, excluded, unknown.
COLOURS = ("#9e7061", "#225c48", "#8d9091", "#8d9091")


def inventory(targets: DataFrame, near: float, reach: float, per_quadrant: int, order: list[Column]) -> DataFrame:
    """targets with outer (beyond near) and quadrant (0 to 3, of the origin's north-east,
    south-east, south-west, north-west), the first per_quadrant of each category, band and
    quadrant in the given order. targets: category, dx, dy (metres from the origin)."""
    dist = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    quadrant = F.when(F.col("dy") >= 0, F.when(F.col("dx") >= 0, 0).otherwise(3)).otherwise(F.when(F.col("dx") >= 0, 1).otherwise(2))
    near_by = targets.withColumn("metres", dist).filter(F.col("metres") <= reach).withColumn("outer", F.col("metres") > near).withColumn("quadrant", quadrant)
    w = Window.partitionBy("category", "outer", "quadrant").orderBy(*order)
    return near_by.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= per_quadrant)


def like_pattern(text: str) -> str:
    """A LIKE pattern for names that hold the text as it is written."""
    text = text.strip()[:80]
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%" if text else ""


def places(layers: list[DataFrame], text: str, per_layer: int = 25, most: int = 20) -> DataFrame:
    """name, place of the first places whose names hold text: layers (id, name) in their
    order, at most per_layer of each by id, each name once, at most `most` in all. Case does
    not matter; an empty text finds nothing."""
    pattern = like_pattern(text)
    found = None
    for n, layer in enumerate(layers):
        hit = layer.filter(F.lit(bool(pattern)) & F.lower("name").like(pattern.lower())).orderBy("id").limit(per_layer)
        hit = hit.select(F.lit(n).alias("layer"), F.col("id").cast("long").alias("id"), "name")
        found = hit if found is None else found.unionByName(hit)
    once = found.groupBy("name").agg(F.min(F.struct("layer", "id")).alias("first"))
    w = Window.orderBy("first", "name")  # at most per_layer rows of each layer
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(F.substring("name", 1, 160).alias("name"), F.col("first.layer").alias("layer"), "place")


def viewport_error() -> Column:
    """Why a viewport (west, south, east, north, zoom) is refused, or null."""
    sides = ("west", "south", "east", "north")
    finite = F.lit(True)
    for s in sides:
        finite = finite & F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
    w, s, e, n = (F.col(x) for x in sides)
    inside = (w >= 124) & (w < e) & (e <= 130) & (s >= 32) & (s < n) & (n <= 40)
    return F.when(~F.coalesce(finite, F.lit(False)), "not finite").when(~inside, "outside the country").when((e - w > 3) | (n - s > 3), "too wide").when(~F.coalesce(F.col("zoom").between(8, 19), F.lit(False)), "zoom")


def geometry_contract() -> Column:
    """Why an interface geometry (crs, kind, ring of x and y) is refused, or null."""
    size = F.coalesce(F.size("ring"), F.lit(0))
    shut = F.get("ring", F.lit(0)) == F.get("ring", size - 1)
    fine = F.forall("ring", lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    wide = (F.array_min(x) < F.array_max(x)) & (F.array_min(y) < F.array_max(y))
    return (
        F.when(F.coalesce(F.col("crs"), F.lit("")) != "EPSG:4326", "crs")
        .when(~F.coalesce(F.col("kind"), F.lit("")).isin("Polygon", "MultiPolygon") | (size < 4) | ~shut, "polygon")
        .when(~F.coalesce(fine & wide, F.lit(False)), "coordinates")
    )


def schematic(samples: DataFrame, scene: str) -> DataFrame:
    """scene, svg: markers of a scene's samples, placed by bearing within its field of view.

    samples: scene, at (their order), bearing, elevation (degrees, null as level), state,
    centre and fov of the scene. A drawing of geometry, without any horizon that was not sampled.
    """
    c = F.col
    turn = F.pmod(c("bearing") - c("centre") + 180, F.lit(360.0)) - 180
    x = 320 + turn / c("fov") * 580
    y = F.greatest(F.lit(28.0), F.least(F.lit(192.0), 160 - F.coalesce(c("elevation"), F.lit(0.0)) * 4))
    colour = F.element_at(F.array(*[F.lit(v) for v in COLOURS]), c("state") + 1)
    mark = F.format_string('<path d="M%.1f 180V%.1f" stroke="%s" stroke-width="3"/><circle cx="%.1f" cy="%.1f" r="4" fill="%s"/>', x, y, colour, x, y, colour)
    marks = F.transform(F.array_sort(F.collect_list(F.struct(c("at"), mark.alias("mark")))), lambda m: m["mark"])
    head = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 230" role="img">'
    return samples.groupBy(scene).agg(F.concat(F.lit(head), F.array_join(marks, ""), F.lit("</svg>")).alias("svg"))

"""Map features from tables of nodes, ways and relations.

nodes: node, lon, lat, tags MAP; way_nodes: way, pos, node; ways: way, tags MAP;
members: rel, way, role; relations: rel, tags MAP. A feature stands in every layer that
its tags name; what cannot be built whole is an issue in the layer `quality`, never a
guessed shape. Coordinates stay longitude and latitude.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as rules
from ..session import ship

LEAST_RING = 4


def lines(nodes: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """way, line (array of node, lon, lat in order), missing (nodes without a place)."""
    placed = way_nodes.join(nodes.select("node", "lon", "lat"), "node", "left")
    vertex = F.struct("pos", "node", "lon", "lat")
    line = F.transform(F.array_sort(F.collect_list(vertex)), lambda v: F.struct(v["node"].alias("node"), v["lon"].alias("lon"), v["lat"].alias("lat")))
    return placed.groupBy("way").agg(line.alias("line"), F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("missing"))


def linear(tags: Column, layers: Column) -> Column:
    """Closed ways that stay lines unless they are tagged as areas."""
    return F.array_contains(layers, "paths") | rules.among(tags, "waterway", "river", "stream", "canal", "drain", "ditch") | rules.among(tags, "natural", "ridge", "cliff") | rules.has(tags, "barrier")


def _closed(line: Column) -> Column:
    return F.get(line, F.lit(0))["node"] == F.get(line, F.size(line) - 1)["node"]


def way_shapes(ways: DataFrame, drawn: DataFrame) -> DataFrame:
    """way, tags, layers, kind (line, area or issue), reason, line of ways with a layer."""
    known = ways.withColumn("layers", rules.categories(F.col("tags"))).filter(F.size("layers") > 0).join(drawn, "way", "left")
    size, area = F.coalesce(F.size("line"), F.lit(0)), rules.among(F.col("tags"), "area", "yes")
    as_line = ~_closed(F.col("line")) | (linear(F.col("tags"), F.col("layers")) & ~area)
    reason = F.when(F.col("line").isNull() | (F.col("missing") > 0), "a node is missing").when(size < 2, "fewer than two nodes").when(~as_line & (size < LEAST_RING), "a closed way was not assembled")
    return known.select("way", "tags", "layers", F.when(reason.isNotNull(), "issue").when(as_line, "line").otherwise("area").alias("kind"), reason.alias("reason"), "line")


def chained(ends: list[tuple[int, int]]) -> list[list[int]] | None:
    """Ways (by their end nodes) in closed rings, each way once; None if an end is open.

    A closed way is a ring of its own; of the others every end node joins exactly two.
    """
    rings = [[i] for i, (a, b) in enumerate(ends) if a == b]
    at = defaultdict(list)
    for i, (a, b) in enumerate(ends):
        if a != b:
            at[a].append(i)
            at[b].append(i)
    if any(len(v) != 2 for v in at.values()):
        return None
    left = {i for i, (a, b) in enumerate(ends) if a != b}
    while left:
        i = min(left)
        ring, (start, here) = [i], ends[i]
        left.remove(i)
        while here != start:
            i = next(j for j in at[here] if j in left)
            left.remove(i)
            ring.append(i)
            here = ends[i][1] if ends[i][0] == here else ends[i][0]
        rings.append(ring)
    return rings


def relation_shapes(relations: DataFrame, members: DataFrame, drawn: DataFrame) -> DataFrame:
    """rel, outer, inner (numbers of rings), points, complete: rings of area relations.

    A relation is one group, whose size its members bound.
    """
    ship(relations.sparkSession)
    areas = relations.filter(F.col("tags")["type"].isin("multipolygon", "boundary") & (F.size(rules.categories(F.col("tags"))) > 0))
    end = lambda i: F.get(F.col("line"), i)["node"]
    part = drawn.select("way", "missing", F.size("line").alias("size"), end(F.lit(0)).alias("first"), end(F.size("line") - 1).alias("last"))
    rows = areas.select("rel").join(members, "rel").join(part, "way", "left").select("rel", "way", "role", "missing", "size", "first", "last")

    def build(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whole = all(r["missing"] == 0 and r["size"] >= 2 for r in rows)
        found = {}
        for inner in (False, True):
            mine = [r for r in rows if (r["role"] == "inner") == inner]
            found[inner] = chained([(r["first"], r["last"]) for r in sorted(mine, key=lambda r: r["way"])]) if whole else None
        done = whole and found[False] is not None and found[True] is not None and bool(found[False])
        points = sum(r["size"] for r in rows if r["size"]) if done else None
        return pa.table({"rel": pa.array([rows[0]["rel"]], pa.int64()), "outer": pa.array([len(found[False]) if done else None], pa.int32()), "inner": pa.array([len(found[True]) if done else None], pa.int32()), "points": pa.array([points], pa.int64()), "complete": pa.array([bool(done)])})

    return rows.groupBy("rel").applyInArrow(build, "rel long, outer int, inner int, points long, complete boolean")


def features(nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """layer, source_id, kind (point, line, area, issue), points, reason."""
    drawn = lines(nodes, way_nodes)
    one = nodes.withColumn("layers", rules.categories(F.col("tags"))).filter((F.size("layers") > 0) & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    one = one.select("layers", F.concat(F.lit("node/"), "node").alias("source_id"), F.lit("point").alias("kind"), F.lit(1).cast("long").alias("points"), F.lit(None).cast("string").alias("reason"))
    two = way_shapes(ways, drawn).select("layers", F.concat(F.lit("way/"), "way").alias("source_id"), "kind", F.size("line").cast("long").alias("points"), "reason")
    built = relation_shapes(relations, members, drawn)
    three = relations.withColumn("layers", rules.categories(F.col("tags"))).join(built, "rel")
    three = three.select("layers", F.concat(F.lit("relation/"), "rel").alias("source_id"), F.when(F.col("complete"), "area").otherwise("issue").alias("kind"), "points", F.when(~F.col("complete"), "the rings of a relation are incomplete").alias("reason"))
    every = one.unionByName(two).unionByName(three)
    layers = F.when(F.col("kind") == "issue", F.array(F.lit("quality"))).otherwise(F.col("layers"))
    out = every.select(F.explode(layers).alias("layer"), "source_id", "kind", "points", "reason")
    return out.filter((F.col("layer") != "paths") | (F.col("kind") == "line"))


def relation_report(relations: DataFrame, built: DataFrame) -> DataFrame:
    """expected, assembled and whether all area relations were built."""
    return built.agg(F.count(F.lit(1)).alias("expected"), F.count_if("complete").alias("assembled"), F.coalesce(F.bool_and("complete"), F.lit(True)).alias("geometry_complete"))

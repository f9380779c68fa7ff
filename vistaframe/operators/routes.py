"""Walking routes: adjacency, shortest paths by frontier relaxation, back-trace."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

METRES_PER_MINUTE = 66.67


def adjacency(edges: DataFrame) -> DataFrame:
    """u, v, eid, length both ways unless foot traffic is one-way; -1 runs backwards.

    edges: eid, u, v, length, oneway_foot. A car's oneway does not matter on foot.
    """
    there = edges.select("eid", "u", "v", "length", "oneway_foot").filter("oneway_foot IS NULL OR oneway_foot <> '-1'").drop("oneway_foot")
    back = edges.filter("oneway_foot IS NULL OR oneway_foot IN ('no', '-1')").select("eid", F.col("v").alias("u"), F.col("u").alias("v"), "length")
    return there.unionByName(back)


def _kept(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder and read again: a cut lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/routes-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shortest(arcs: DataFrame, sources: DataFrame, limit: float | None = None, every: int = 4) -> DataFrame:
    """node, cost, parent, edge: least cost from the sources (node, cost) along arcs; of equal
    ways the least (parent, edge).

    arcs: u, v, eid, length > 0. Each round relaxes the arcs of the nodes that improved in
    the round before; a shuffle on the node joins and one takes the least. Lineage is cut
    every few rounds, and the loop ends when nothing improves.
    """
    best = sources.select("node", "cost", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("edge"))
    best = _kept(best.groupBy("node").agg(F.min(F.struct("cost", "parent", "edge")).alias("b")).select("node", "b.*"))
    front, n = best, 0
    while True:
        n += 1
        step = front.join(arcs, front["node"] == arcs["u"]).select(F.col("v").alias("node"), (F.col("cost") + F.col("length")).alias("cost"), F.col("u").alias("parent"), F.col("eid").alias("edge"))
        if limit is not None:
            step = step.filter(F.col("cost") <= limit)
        step = step.groupBy("node").agg(F.min(F.struct("cost", "parent", "edge")).alias("b")).select("node", "b.*")
        old = best.select("node", F.struct("cost", "parent", "edge").alias("old"))
        # a source has no parent, and a struct orders null first: it stays
        front = _kept(step.join(old, "node", "left").filter("old IS NULL OR struct(cost, parent, edge) < old").drop("old"))
        if not front.head(1):
            return best
        best = best.join(front.select("node"), "node", "left_anti").unionByName(front)
        if n % every == 0:
            best = _kept(best)


def back_trace(best: DataFrame, ends: DataFrame) -> DataFrame:
    """end, at (0 at the end), node, edge: the path of each end node to its source.

    Ancestors at twice the distance come from joining those at the distance with themselves,
    so a path of any length takes as many rounds as its length has bits.
    """
    jumps = [_kept(best.filter("parent IS NOT NULL").select("node", F.col("parent").alias("up")))]
    while True:
        last = jumps[-1]
        further = _kept(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", F.col("upper").alias("up")))
        if not further.head(1):
            break
        jumps.append(further)
    out = ends.select(F.col("node").alias("end"), F.lit(0).alias("at"), "node")
    for k in range(len(jumps) - 1, -1, -1):
        out = _kept(out.unionByName(out.join(jumps[k], "node").select("end", (F.col("at") + (1 << k)).alias("at"), F.col("up").alias("node"))))
    return out.join(best.select("node", "edge"), "node").select("end", "at", "node", "edge")


def described(path: DataFrame, best: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """end, metres, minutes, stairs, edges, unknown_access, geometry (points from the source on).

    path: of back_trace; nodes: node, lon, lat; edges: eid, steps, access_status.
    """
    facts = path.join(nodes, "node", "left").join(edges.select(F.col("eid").alias("edge"), "steps", "access_status"), "edge", "left")
    point = F.struct(F.col("at"), F.col("lon"), F.col("lat"))
    line = F.transform(F.reverse(F.array_sort(F.collect_list(point))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    real = F.col("edge").isNotNull()
    per = facts.groupBy("end").agg(
        F.coalesce(F.bool_or("steps"), F.lit(False)).alias("stairs"),
        F.count_if(real).alias("edges"),
        F.count_if(real & (F.coalesce(F.col("access_status"), F.lit("")) != "verified")).alias("unknown_access"),
        line.alias("geometry"),
    )
    cost = best.select(F.col("node").alias("end"), F.col("cost").alias("metres"))
    return per.join(cost, "end").withColumn("minutes", F.floor(minutes(F.col("metres")) * 10 + 0.5) / 10)


def minutes(metres):
    return metres / METRES_PER_MINUTE

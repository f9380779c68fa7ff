"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are numbered by their place in the scan, and these numbers are written once with
the narrow columns, so that every later step sees the same ones. The keys that deal and
permute are seeded hashes of the number too, so equal rows (any share of the table) are
as independent as others. Rows are dealt by hash to local partitions. The driver draws, from the partition
counts alone, how many rows each partition sends to each shard: the rows of a
matrix with fixed margins, drawn as a multivariate hypergeometric. Each partition
permutes its rows by a seeded key and cuts the permutation at those counts; each
shard permutes what it received once more, which gives the slots. Everything that
touches rows is a DataFrame expression; the driver sees only the matrix.

Defined cases: a null text has no bytes (size 1, crc32 of nothing, 0); a null id
hashes as the seed alone; equal rows are rows of their own; an empty table gives an
empty result; further columns are ignored, and with whole rows they may have any names.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, json_table, written

ROWS_PER_PARTITION = 100_000
#: Partitions of the matrix, whose rows the driver draws. Beyond 6.5e9 rows partitions grow
#: (their windows sort narrow rows and spill).
MOST_PARTITIONS = 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One draw by inversion that walks outwards from the mode; any size of urn."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    top = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    p = math.exp(log_choose(good, top) + log_choose(bad, draws - top) - log_choose(good + bad, draws))
    u = rng.random() - p
    up, p_up, down, p_down = top, p, top, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up <= 0 and p_down <= 0:
            break
    return top


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each partition to each shard; margins are counts and capacities."""
    rng = random.Random(seed)
    left, matrix = list(capacities), []
    for n in counts:
        row, rest, bad = [], n, sum(left)
        for j, capacity in enumerate(left):
            bad -= capacity
            x = rest if j == len(left) - 1 else hypergeometric(rng, capacity, bad, rest)
            row.append(x)
            rest -= x
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def assign(df: DataFrame, n_shards: int = 8, seed: int = 20_240_601, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a uniform shuffle, sizes at most one apart.

    whole: also row, a struct of all columns, which then travels with each exchange.
    """
    spark = df.sparkSession
    text = F.col("text").cast("string").cast("binary")
    base = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
        *([F.struct(*[df[c] for c in df.columns]).alias("row")] if whole else []),
    )
    base = written(base, "numbered")
    carried = ["row"] if whole else []
    key = lambda salt: F.xxhash64(F.lit(seed + salt), "doc_id", "text_crc32", "size", "at")
    total = base.count()
    parts = max(8, min(MOST_PARTITIONS, -(-total // ROWS_PER_PARTITION)))
    dealt = base.withColumn("part", F.pmod(key(0), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    capacities = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(parts)], capacities, seed)
    # of each partition the positions at which the next shard begins
    cut = F.broadcast(json_table(spark, [{"part": i, "ends": list(accumulate(row))} for i, row in enumerate(matrix)], "part int, ends array<long>"))
    local = Window.partitionBy("part").orderBy("key1", "at")
    placed = (
        dealt.withColumn("key1", key(1))
        .withColumn("position", F.row_number().over(local).cast("long") - 1)
        .join(cut, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("position"))))
        .withColumn("key2", key(2))
        .withColumn("block", F.floor((F.shiftrightunsigned("key2", 33)) * F.lit(parts) / F.lit(2.0**31)).cast("int"))
        .select("doc_id", "size", "text_crc32", "at", "shard", "key2", "block", *carried)
    )
    placed = written(placed, "placed")
    blocks = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    first = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("rows").over(first), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "block").orderBy("key2", "at")
    return (
        placed.withColumn("rank", F.row_number().over(inner).cast("long") - 1)
        .join(blocks, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"), *carried)
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 8, seed: int = 20_240_601, files: int = 1) -> None:
    """Write the shuffled rows as Parquet, a folder for each shard, in slot order within
    each of its files (files: how many a shard has, as ranges of slots). The folders are
    named after shard, with underscores behind it if df has a column of that name."""
    shard, slot = fresh(df, "shard"), fresh(df, "slot")
    rows = assign(df, n_shards, seed, whole=True).select(F.col("shard").alias(shard), F.col("slot").alias(slot), "row.*")
    rows.repartitionByRange(n_shards * files, shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

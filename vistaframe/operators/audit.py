"""Profiles, budgets and comparisons of prepared data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, missing, zero, low, high of numeric columns, in one pass."""
    aggs = []
    for f in fields:
        c = F.col(f).cast("double")
        bad = c.isNull() | F.isnan(c)
        ok = F.when(~bad, c)
        aggs += [F.count_if(bad).alias(f"{f}_m"), F.count_if(ok == 0).alias(f"{f}_z"), F.min(ok).alias(f"{f}_l"), F.max(ok).alias(f"{f}_h")]
    row = df.agg(*aggs)
    each = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_m").alias("missing"), F.col(f"{f}_z").alias("zero"), F.col(f"{f}_l").alias("low"), F.col(f"{f}_h").alias("high")) for f in fields]
    return row.select(F.explode(F.array(*each)).alias("v")).select("v.*")


def layer_budget(df: DataFrame, layer: str, key: str, size: str, cap: int) -> DataFrame:
    """Rows admitted layer by layer under one running budget: what overflows stops its
    layer, and later layers go on with the same total. A response of bounded size: one fold."""
    every = df.agg(F.array_sort(F.collect_list(F.struct(F.col(layer).cast("long").alias("l"), F.col(key).cast("long").alias("k"), F.col(size).cast("long").alias("s")))).alias("every"))
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("stopped"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        out = F.coalesce(acc["stopped"] == x["l"], F.lit(False)) | (acc["total"] + x["s"] > cap)
        return F.struct(
            F.when(out, acc["total"]).otherwise(acc["total"] + x["s"]).alias("total"),
            F.when(out, x["l"]).otherwise(acc["stopped"]).alias("stopped"),
            F.when(out, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["k"]))).alias("kept"),
        )

    return every.select(F.aggregate("every", none, step).alias("r")).select(F.explode("r.kept").alias(key))


def exceedance(diff: Column, limits: list[float]) -> list[Column]:
    return [F.count_if(F.abs(diff) > v).alias(f"over_{v:g}") for v in limits]


def disagreement(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Counts of states that two models give differently: visible (1) against blocked (0)."""
    both = a.select(*key, F.col("state").alias("one")).join(b.select(*key, F.col("state").alias("two")), key, "full")
    return both.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if((F.col("one") == 1) & (F.col("two") == 0)).alias("false_visible"),
        F.count_if((F.col("one") == 0) & (F.col("two") == 1)).alias("false_blocked"),
        F.count_if(F.col("one").isNull() | F.col("two").isNull()).alias("missing"),
    )


def ledger(calls: DataFrame, day: Column, limit: int, most_calls: int, most_images: int) -> DataFrame:
    """day, used, calls, images of admitted and refused calls, and what is over its cap.

    calls: micro_usd, is_image.
    """
    per = calls.groupBy(day.alias("day")).agg(F.sum("micro_usd").cast("long").alias("used"), F.count(F.lit(1)).alias("calls"), F.count_if("is_image").alias("images"))
    over = F.when(F.col("used") > limit, "daily_spending_exhausted").when((F.col("calls") > most_calls) | (F.col("images") > most_images), "daily_request_cap_exhausted")
    return per.withColumn("over", over)


def sampled_mismatches(source: DataFrame, stored: DataFrame, key: str, fields: list[str], rows: int = 64, seed: str = "m:") -> DataFrame:
    """key, problem (missing, changed) of a seeded sample of source rows against the stored ones."""
    mark = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    sample = source.orderBy(mark, key).limit(rows).select(key, F.struct(*fields).alias("want"))
    both = sample.join(stored.select(key, F.struct(*fields).alias("have"), F.lit(1).alias("hit")), key, "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"want.{f}").eqNullSafe(F.col(f"have.{f}"))
    return both.select(key, F.when(F.col("hit").isNull(), "missing").when(~same, "changed").alias("problem"))


def subset_changes(before: DataFrame, after: DataFrame, key: str, z: str, vertices: str) -> DataFrame:
    """Checks of a subset against the table it was cut from: rows, those not in the table,
    changed elevations, vertices lost, and the range of elevations."""
    was = before.select(key, F.col(z).alias("z0"), F.col(vertices).alias("v0"), F.lit(1).alias("hit"))
    both = after.join(was, key, "left")
    return both.agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if(F.col("hit").isNull()).alias("foreign"),
        F.count_if(F.col("hit").isNotNull() & ~F.col(z).eqNullSafe(F.col("z0"))).alias("changed"),
        F.coalesce(F.sum(F.col("v0") - F.col(vertices)), F.lit(0)).cast("long").alias("vertices_lost"),
        F.min(z).alias("low"),
        F.max(z).alias("high"),
    )


def overlap(products: DataFrame, tile: str, value: str, limits: list[float]) -> DataFrame:
    """one, other, shared, missing and exceedances of the differences between the tiles' own
    products where their halos overlap, of every ordered pair of tiles.

    products: tile, row, col, value; a cell stands once in every tile that made it.
    """
    a = products.select(F.col(tile).alias("one"), "row", "col", F.col(value).alias("a"))
    b = products.select(F.col(tile).alias("other"), "row", "col", F.col(value).alias("b"))
    both = a.join(b, ["row", "col"]).filter(F.col("one") != F.col("other"))
    diff = F.col("a") - F.col("b")
    return both.groupBy("one", "other").agg(F.count(F.lit(1)).alias("shared"), F.count_if(diff.isNull()).alias("missing"), *exceedance(diff, limits))

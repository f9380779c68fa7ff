"""Order-dependent operators: interval merging, running caps, sectors, resampling, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import kept

#: Rows of a range when a whole table is put in order.
RANGE_ROWS = 500_000


def merge_intervals(df: DataFrame, key: list[str], start: str, stop: str) -> DataFrame:
    """Union of intervals for each key; touching ones join (gaps and islands)."""
    order = Window.partitionBy(*key).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("fresh", F.when(F.col(start) <= before, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("island")


def round_robin(df: DataFrame, stratum: list[str], order: list, cap: int) -> DataFrame:
    """The first of every stratum, then the second of every one, up to cap rows."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)))
    return turn.orderBy("turn", *stratum).limit(cap)


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def running_admission(df: DataFrame, key: list[str], order: Column, amount: Column, cap) -> DataFrame:
    """Amounts of a key admitted in order while the running total stays within cap; what
    is rejected adds nothing. One fold over the ordered amounts of a key.

    Returns key, taken, admitted, rejected.
    """
    ordered = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), amount.cast("long").alias("v")))).alias("every"))
    zero = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("admitted"), F.lit(0).cast("long").alias("rejected"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["taken"] + x["v"] <= cap
        return F.struct(
            F.when(fits, acc["taken"] + x["v"]).otherwise(acc["taken"]).alias("taken"),
            (acc["admitted"] + fits.cast("long")).alias("admitted"),
            (acc["rejected"] + (~fits).cast("long")).alias("rejected"),
        )

    return ordered.select(*key, F.aggregate("every", zero, step).alias("r")).select(*key, "r.*")


def separated(values: Column, gap, least: float, most: int) -> Column:
    """Values of an ordered array that are farther than least from every kept one, up to most."""
    none = F.array().cast("array<double>")
    return F.aggregate(values, none, lambda kept, x: F.when((F.size(kept) < most) & ~F.exists(kept, lambda y: gap(x, y) <= least), F.concat(kept, F.array(x))).otherwise(kept))


def consecutive(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each vertex with the next one of its line (the last has none)."""
    w = Window.partitionBy(*key).orderBy(order)
    for c in columns:
        df = df.withColumn(f"next_{c}", F.lead(c).over(w))
    return df.filter(F.col(f"next_{columns[0]}").isNotNull())


def resample(df: DataFrame, key: list[str], order: str, spacing: float) -> DataFrame:
    """Points at whole multiples of spacing along each polyline, and its end: key, at, x, y."""
    seg = consecutive(df, key, order, ["x", "y"]).withColumn("len", F.sqrt(F.pow(F.col("next_x") - F.col("x"), 2) + F.pow(F.col("next_y") - F.col("y"), 2)))
    w = Window.partitionBy(*key).orderBy(order)
    seg = seg.filter("len > 0").withColumn("stop", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("len"))
    seg = seg.withColumn("total", F.max("stop").over(Window.partitionBy(*key)))
    low, high = F.ceil(F.col("start") / spacing).cast("long"), F.ceil(F.col("stop") / spacing).cast("long") - 1
    steps = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * F.lit(spacing))).otherwise(F.array().cast("array<double>"))
    ends = F.when(F.col("stop") == F.col("total"), F.array(F.col("stop"))).otherwise(F.array().cast("array<double>"))
    out = seg.withColumn("at", F.explode(F.concat(steps, ends)))
    t = (F.col("at") - F.col("start")) / F.col("len")
    return out.select(*key, "at", (F.col("x") + t * (F.col("next_x") - F.col("x"))).alias("px"), (F.col("y") + t * (F.col("next_y") - F.col("y"))).alias("py"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles rounded once, as a fused multiply-add does; the product is split
    into its rounded value and what rounding left, as is the sum."""

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    product = a * b
    left = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    part = total - product
    exact = total + (((product - (total - part)) + (c - part)) + left)
    return F.when(F.isnan(exact), total).otherwise(exact)


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key, n (rows) and a column for each share: the value at that share of the way through a
    key's values, between two of them low * (1 - d) + high * d with the last product and the
    sum rounded once, as DuckDB's quantile_cont computes it. Nulls are counted in n only.

    Values are counted before they are put in order, so a key's order holds distinct values.
    """
    c = F.col
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("_valued")).withColumnRenamed(key, "_key")
    each = df.filter(c(value).isNotNull()).groupBy(key, c(value).alias("_v")).agg(F.count(F.lit(1)).alias("_many"))
    upto = F.sum("_many").over(Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = sizes.join(each.withColumn("_upto", upto), c("_key").eqNullSafe(c(key)), "left")
    at = {name: (c("_valued") - 1) * F.lit(share) for name, share in shares.items()}
    held = lambda place: F.max(F.when((place < c("_upto")) & (place >= c("_upto") - c("_many")), c("_v")))
    ends = [held(g(a)).alias(f"_{side}_{name}") for name, a in at.items() for side, g in (("low", F.floor), ("high", F.ceil))]
    found = placed.groupBy("_key", "n", "_valued").agg(*ends)

    def between(name: str) -> Column:
        low, high, d = c(f"_low_{name}").cast("double"), c(f"_high_{name}").cast("double"), at[name] - F.floor(at[name])
        return F.when(d == 0, low).otherwise(fused(low, F.lit(1.0) - d, high * d))

    return found.select(c("_key").alias(key), "n", *[between(name).alias(name) for name in shares])


def in_ranges(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """df written as ranges of the order, with its range's number (_range, rising)."""
    ranges = ranges or max(1, -(-df.count() // RANGE_ROWS))
    return kept(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with the place (from 1) of each row in the order of the whole table.

    Ranges are numbered on their own after the rows before them are counted, so no task holds
    the table. The order must have no ties, or tied rows take either place.
    """
    rows = in_ranges(df, order, ranges)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")

"""Aggregates, windows, top-k and set operations of audits and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered
from ..sources import grids
from .base import frame, micro, micro_sql, query



def N():  # noqa: N802
    return F.count(F.lit(1))


LI = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus FROM {lineitem}"
DIFF = "SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 1000 AS base, l_extendedprice / 1000 + (l_orderkey % 7 - 3) * l_quantity / 50 AS other, l_suppkey % 5 AS region, l_returnflag AS flag FROM {lineitem}"
BLD = "SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS source, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS height, CAST(p_partkey % 1500 AS BIGINT) AS gid, CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS invalid, p_partkey % 4 AS region FROM {part}"


def G(spark):  # noqa: N802
    return grids.synthetic(spark)


@query("a02_validation_counts", f"WITH b AS ({BLD}) SELECT (SELECT count(*) FROM b) AS total, (SELECT count(*) FROM b WHERE height IS NULL) AS unresolved, (SELECT CAST(sum(invalid) AS BIGINT) FROM b) AS invalid, (SELECT count(*) FROM (SELECT gid FROM b GROUP BY gid HAVING count(*) > 1)) AS duplicated, (SELECT count(*) FROM b WHERE height <= 1 OR height > 45) AS bad_heights")
def a02(spark, d):
    b = frame(spark, d, BLD)
    per = b.groupBy("gid").agg(N().alias("n"), F.count_if(F.col("height").isNull()).alias("u"), F.sum("invalid").alias("i"), F.count_if((F.col("height") <= 1) | (F.col("height") > 45)).alias("bad"))
    return per.agg(F.sum("n").alias("total"), F.sum("u").alias("unresolved"), F.sum("i").alias("invalid"), F.count_if(F.col("n") > 1).alias("duplicated"), F.sum("bad").alias("bad_heights"))


@query("a03_field_profile", f"SELECT 'height' AS field, count(*) FILTER (height IS NULL) AS missing, count(*) FILTER (height = 0) AS zero, min(height) AS low, max(height) AS high FROM ({BLD}) UNION ALL SELECT 'gid', 0, count(*) FILTER (gid = 0), min(gid), max(gid) FROM ({BLD})")
def a03(spark, d):
    from ..operators.audit import profile

    return profile(frame(spark, d, BLD), ["height", "gid"])


@query("a04_raster_profile", f"WITH {grids.SYNTHETIC_SQL} SELECT count(surface) AS valid, count(*) - count(surface) AS missing, min(surface) AS low, max(surface) AS high FROM grid")
def a04(spark, d):
    s = F.col("surface")
    return G(spark).agg(F.count(s).alias("valid"), F.count_if(s.isNull()).alias("missing"), F.min(s).alias("low"), F.max(s).alias("high"))


@query("a05_quality_bits", f"WITH {grids.SYNTHETIC_SQL} SELECT CAST(bit AS INTEGER) AS bit, count(*) FILTER ((quality & bit) <> 0) AS cells FROM grid, (VALUES (1), (2), (4), (8), (16)) t(bit) GROUP BY bit")
def a05(spark, d):
    bits = [1, 2, 4, 8, 16]
    one = G(spark).agg(*[F.count_if(F.col("quality").bitwiseAND(b) != 0).alias(str(b)) for b in bits])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col(str(b)).alias("cells")) for b in bits])).alias("v")).select("v.*")


@query("a06_tile_counts", f"WITH {grids.SYNTHETIC_SQL} SELECT coalesce(CAST(row // 16 AS VARCHAR) || '_' || CAST(col // 16 AS VARCHAR), 'all') AS tile, count(*) AS cells, 25 * count(*) FILTER (surface IS NULL) AS missing_m2 FROM grid GROUP BY ROLLUP (CAST(row // 16 AS VARCHAR) || '_' || CAST(col // 16 AS VARCHAR))")
def a06(spark, d):
    tile = F.concat_ws("_", grids.tile_key(F.col("row"), 16), grids.tile_key(F.col("col"), 16))
    return G(spark).withColumn("tile", tile).rollup("tile").agg(N().alias("cells"), (25 * F.count_if(F.col("surface").isNull())).alias("missing_m2")).select(F.coalesce("tile", F.lit("all")).alias("tile"), "cells", "missing_m2")


GRIDPTS = "SELECT CAST(c_custkey * 137 % 2000 AS BIGINT) AS x, CAST(c_custkey * 211 % 1500 AS BIGINT) AS y, c_mktsegment AS layer, c_acctbal < 0 AS flagged FROM {customer}"


@query("a07_grid_counts_with_empty", f"SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, count(x) AS n FROM range(20) a(gx) CROSS JOIN range(20) b(gy) LEFT JOIN ({GRIDPTS}) ON x // 100 = gx AND y // 100 = gy GROUP BY 1, 2")
def a07(spark, d):
    dim = spark.range(20).select(F.col("id").alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    per = frame(spark, d, GRIDPTS).groupBy(F.floor(F.col("x") / 100).alias("gx"), F.floor(F.col("y") / 100).alias("gy")).agg(N().alias("n"))
    return dim.join(per, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("n", F.lit(0)).alias("n"))


@query("a08_counts_with_flags", f"SELECT x // 250 AS gx, count(*) AS n, count(*) FILTER (flagged) AS flagged FROM ({GRIDPTS}) GROUP BY 1")
def a08(spark, d):
    return frame(spark, d, GRIDPTS).groupBy(F.floor(F.col("x") / 250).alias("gx")).agg(N().alias("n"), F.count_if("flagged").alias("flagged"))


@query("a09_counts_by_cell_and_kind", f"SELECT x // 500 AS gx, coalesce(layer, 'any') AS kind, count(*) AS n FROM ({GRIDPTS}) GROUP BY GROUPING SETS ((x // 500, layer), (x // 500))")
def a09(spark, d):
    f = frame(spark, d, GRIDPTS).withColumn("gx", F.floor(F.col("x") / 500))
    return f.groupingSets([["gx", "layer"], ["gx"]], "gx", "layer").agg(N().alias("n")).select("gx", F.coalesce("layer", F.lit("any")).alias("kind"), "n")


@query("a11_latency_statistics", f"SELECT flag, {micro_sql('quantile_cont(base, 0.5)')} AS median_micro, {micro_sql('quantile_cont(base, 0.95)')} AS p95_micro, count(*) AS n FROM ({DIFF}) GROUP BY flag")
def a11(spark, d):
    """Interpolated as the SQL's engine does to the last bit: whole prices give ties of half a millionth."""
    per = ordered.quantiles(frame(spark, d, DIFF), "flag", "base", {"median": 0.5, "p95": 0.95})
    return per.select("flag", micro(F.col("median")).alias("median_micro"), micro(F.col("p95")).alias("p95_micro"), "n")


@query("a12_quantile_array", f"SELECT region, CAST(floor(q * 1000 + 0.5) AS BIGINT) AS permille, CAST(floor(v * 1000000 + 0.3) AS BIGINT) AS value_micro FROM (SELECT region, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q, unnest(quantile_cont(base, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM ({DIFF}) GROUP BY region)")
def a12(spark, d):
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    per = frame(spark, d, DIFF).groupBy("region").agg(F.percentile("base", qs).alias("v"))
    return per.select("region", F.posexplode("v").alias("i", "x")).select("region", F.element_at(F.array(*[F.lit(int(q * 1000)).cast("long") for q in qs]), F.col("i") + 1).alias("permille"), F.floor(F.col("x") * 1_000_000 + 0.3).cast("long").alias("value_micro"))


@query("a13_rmse_and_bias", f"SELECT region, {micro_sql('sqrt(avg((other - base) * (other - base)))')} AS rmse_micro, {micro_sql('avg(other - base)')} AS bias_micro FROM ({DIFF}) GROUP BY region")
def a13(spark, d):
    r = F.col("other") - F.col("base")
    return frame(spark, d, DIFF).groupBy("region").agg(micro(F.sqrt(F.avg(r * r))).alias("rmse_micro"), micro(F.avg(r)).alias("bias_micro"))


@query("a14_difference_statistics", f"SELECT region, {micro_sql('avg(other - base)')} AS mean_micro, {micro_sql('quantile_cont(abs(other - base), 0.5)')} AS median_abs_micro, {micro_sql('quantile_cont(abs(other - base), 0.95)')} AS p95_abs_micro FROM ({DIFF}) GROUP BY region")
def a14(spark, d):
    r = F.col("other") - F.col("base")
    return frame(spark, d, DIFF).groupBy("region").agg(micro(F.avg(r)).alias("mean_micro"), micro(F.percentile(F.abs(r), 0.5)).alias("median_abs_micro"), micro(F.percentile(F.abs(r), 0.95)).alias("p95_abs_micro"))


@query("a15_reservoir_sample", f"SELECT id FROM ({DIFF}) ORDER BY md5('r:' || id), id LIMIT 500")
def a15(spark, d):
    return frame(spark, d, DIFF).select("id").orderBy(F.md5(F.concat(F.lit("r:"), F.col("id").cast("string")).cast("binary")), "id").limit(500)


@query("a16_exceedance_counts", f"SELECT region, count(*) FILTER (abs(other - base) > 0) AS over_0, count(*) FILTER (abs(other - base) > 0.1) AS over_01, count(*) FILTER (abs(other - base) > 1) AS over_1, count(*) FILTER (abs(other - base) > 5) AS over_5 FROM ({DIFF}) GROUP BY region")
def a16(spark, d):
    r = F.abs(F.col("other") - F.col("base"))
    return frame(spark, d, DIFF).groupBy("region").agg(*[F.count_if(r > v).alias(n) for n, v in (("over_0", 0), ("over_01", 0.1), ("over_1", 1), ("over_5", 5))])


NODE = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey * 137 % 2000 AS BIGINT) AS x, CAST(c_custkey * 211 % 1500 AS BIGINT) AS y, c_custkey % 3 AS state FROM {customer}"
DIST2 = "((x - 900) * (x - 900) + (y - 700) * (y - 700))"


@query("a17_stratum_representative", f"SELECT x // 100 AS gx, y // 100 AS gy, state, arg_min(id, {DIST2} * 100000 + id) AS id FROM ({NODE}) GROUP BY 1, 2, 3")
def a17(spark, d):
    d2 = (F.col("x") - 900) * (F.col("x") - 900) + (F.col("y") - 700) * (F.col("y") - 700)
    return frame(spark, d, NODE).groupBy(F.floor(F.col("x") / 100).alias("gx"), F.floor(F.col("y") / 100).alias("gy"), "state").agg(F.min_by("id", F.struct(d2, "id")).alias("id"))


@query("a21_sample_coverage", "SELECT l_orderkey AS scene, count(*) AS intended, count(*) FILTER (l_returnflag = 'A') AS visible, count(*) FILTER (l_returnflag = 'R') AS blocked, count(*) FILTER (l_returnflag = 'N') AS unknown FROM {lineitem} GROUP BY 1")
def a21(spark, d):
    f = F.col("l_returnflag")
    return frame(spark, d, LI).groupBy(F.col("l_orderkey").alias("scene")).agg(N().alias("intended"), F.count_if(f == "A").alias("visible"), F.count_if(f == "R").alias("blocked"), F.count_if(f == "N").alias("unknown"))


@query("a22_angular_span", "SELECT l_orderkey AS scene, max(l_partkey % 70) - min(l_partkey % 70) AS span FROM {lineitem} GROUP BY 1")
def a22(spark, d):
    b = F.col("l_partkey") % 70
    return frame(spark, d, LI).groupBy(F.col("l_orderkey").alias("scene")).agg((F.max(b) - F.min(b)).alias("span"))


@query("a23_skyline_rule", "SELECT l_orderkey AS scene, count(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END) >= 2 AS skyline FROM {lineitem} GROUP BY 1")
def a23(spark, d):
    return frame(spark, d, LI).groupBy(F.col("l_orderkey").alias("scene")).agg((F.count_distinct(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey"))) >= 2).alias("skyline"))


@query("a24_distinct_positions", "SELECT l_orderkey AS scene, count(DISTINCT (l_partkey % 50, l_suppkey % 3)) >= 2 AS enough FROM {lineitem} GROUP BY 1")
def a24(spark, d):
    return frame(spark, d, LI).groupBy(F.col("l_orderkey").alias("scene")).agg((F.count_distinct(F.struct(F.col("l_partkey") % 50, F.col("l_suppkey") % 3)) >= 2).alias("enough"))


@query("a25_grouped_diagnostics", "SELECT l_partkey AS source, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS reasons FROM {lineitem} GROUP BY 1")
def a25(spark, d):
    r = F.concat("l_returnflag", "l_linestatus")
    return frame(spark, d, LI).groupBy(F.col("l_partkey").alias("source")).agg(F.array_join(F.array_sort(F.collect_set(r)), ",").alias("reasons"))


@query("a28_coverage_fraction", f"WITH {grids.SYNTHETIC_SQL} SELECT 25 * count(*) AS area_m2, 25 * count(surface) AS covered_m2, {micro_sql('count(surface) / count(*)')} AS fraction_micro FROM grid")
def a28(spark, d):
    c = F.count("surface")
    return G(spark).agg((25 * N()).alias("area_m2"), (25 * c).alias("covered_m2"), micro(c / N()).alias("fraction_micro"))


@query("a29_node_state_totals", f"SELECT state, count(*) AS nodes FROM ({NODE}) GROUP BY state")
def a29(spark, d):
    return frame(spark, d, NODE).groupBy("state").agg(N().alias("nodes"))


@query("a30_guarded_fraction", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_size % 5 > 0 AND p_size % 7 BETWEEN 0 AND p_size % 5 THEN CAST(1000000 * (p_size % 7) // (p_size % 5) AS BIGINT) END AS fraction_micro FROM {part}")
def a30(spark, d):
    a, b = F.col("p_size") % 7, F.col("p_size") % 5
    return frame(spark, d, "SELECT * FROM {part}").select(F.col("p_partkey").cast("long").alias("id"), F.when((b > 0) & a.between(0, b), F.floor(F.try_divide(1_000_000 * a, b))).cast("long").alias("fraction_micro"))


@query("a31_exact_duplicate_groups", f"SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS excess FROM (SELECT gid, count(*) AS n FROM ({BLD}) GROUP BY gid HAVING count(*) > 1)")
def a31(spark, d):
    return frame(spark, d, BLD).groupBy("gid").agg(N().alias("n")).filter("n > 1").agg(N().alias("groups"), F.sum(F.col("n") - 1).cast("long").alias("excess"))


@query("a32_source_audit_by_region", f"SELECT region, count(*) AS n, count(*) FILTER (invalid = 1) AS invalid, count(*) FILTER (height IS NULL) AS unresolved, {micro_sql('quantile_cont(height, 0.5)')} AS median_micro FROM ({BLD}) GROUP BY region")
def a32(spark, d):
    return frame(spark, d, BLD).groupBy("region").agg(N().alias("n"), F.count_if(F.col("invalid") == 1).alias("invalid"), F.count_if(F.col("height").isNull()).alias("unresolved"), micro(F.percentile("height", 0.5)).alias("median_micro"))


@query("a35_window_coverage", f"WITH {grids.SYNTHETIC_SQL} SELECT count(*) AS cells, count(*) FILTER (surface IS NULL OR (quality & 248) <> 0) AS unsupported FROM grid WHERE row BETWEEN 40 AND 60 AND col BETWEEN 35 AND 59")
def a35(spark, d):
    return grids.window(G(spark), 40, 35, 21, 25).agg(N().alias("cells"), F.count_if(~grids.cell_valid()).alias("unsupported"))


@query("a36_preflight_counts", "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_tag FROM {events} GROUP BY 1")
def a36(spark, d):
    return frame(spark, d, "SELECT * FROM {events}").groupBy(F.col("event_type").alias("kind")).agg(N().alias("n"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("with_tag"))


# -- windows and ordered analytics ------------------------------------------------------


@query("w01_rank_numbers", f"SELECT id, CAST(row_number() OVER (PARTITION BY region ORDER BY height DESC NULLS LAST, id) AS INTEGER) AS place FROM ({BLD})")
def w01(spark, d):
    return frame(spark, d, BLD).select("id", F.row_number().over(Window.partitionBy("region").orderBy(F.col("height").desc_nulls_last(), "id")).alias("place"))


@query("w02_round_robin", f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY region, source ORDER BY height NULLS LAST, id) AS turn FROM ({BLD})) ORDER BY turn, region, source LIMIT 160")
def w02(spark, d):
    return ordered.round_robin(frame(spark, d, BLD), ["region", "source"], [F.col("height").asc_nulls_last(), F.col("id")], 160).select("id")


LINES = "SELECT l_orderkey AS line, l_linenumber AS n, CAST(min(l_partkey % 400) AS DOUBLE) AS x, CAST(min(l_suppkey * 7 % 300) AS DOUBLE) AS y FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query("w04_consecutive_pairs", f"SELECT line, n, {micro_sql('sqrt(pow(nx - x, 2) + pow(ny - y, 2))')} AS length_micro FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ({LINES}) WINDOW w AS (PARTITION BY line ORDER BY n)) WHERE nx IS NOT NULL")
def w04(spark, d):
    p = ordered.consecutive(frame(spark, d, LINES), ["line"], "n", ["x", "y"])
    return p.select("line", "n", micro(F.sqrt(F.pow(F.col("next_x") - F.col("x"), 2) + F.pow(F.col("next_y") - F.col("y"), 2))).alias("length_micro"))


@query("w05_layer_byte_budget", "WITH RECURSIVE p AS (SELECT page_id AS id, page_id % 4 AS layer, octet_length(encode(url)) AS size, row_number() OVER (ORDER BY page_id % 4, page_id) AS i FROM {pages}), f AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS total, CAST(-1 AS BIGINT) AS stopped, CAST(NULL AS BIGINT) AS id UNION ALL SELECT f.i + 1, CASE WHEN p.layer = stopped OR total + size > 3000 THEN total ELSE total + size END, CASE WHEN p.layer = stopped OR total + size > 3000 THEN p.layer ELSE stopped END, CASE WHEN p.layer = stopped OR total + size > 3000 THEN NULL ELSE p.id END FROM f JOIN p ON p.i = f.i + 1) SELECT id FROM f WHERE id IS NOT NULL")
def w05(spark, d):
    from ..operators.audit import layer_budget

    pages = frame(spark, d, "SELECT page_id AS id, page_id % 4 AS layer, octet_length(url) AS size FROM {pages}")
    return layer_budget(pages, "layer", "id", "size", 3000)


SPEND = "SELECT o_custkey AS account, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS cost FROM {orders}"


@query("w06_running_cap", f"WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY id) AS i FROM ({SPEND})), f AS (SELECT DISTINCT account, 0 AS i, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS admitted, CAST(0 AS BIGINT) AS rejected FROM s UNION ALL SELECT s.account, s.i, CASE WHEN taken + cost <= 400000 THEN taken + cost ELSE taken END, admitted + CASE WHEN taken + cost <= 400000 THEN 1 ELSE 0 END, rejected + CASE WHEN taken + cost <= 400000 THEN 0 ELSE 1 END FROM f JOIN s ON s.account = f.account AND s.i = f.i + 1) SELECT account, max(taken) AS taken, max(admitted) AS admitted, max(rejected) AS rejected FROM f GROUP BY account")
def w06(spark, d):
    return ordered.running_admission(frame(spark, d, SPEND), ["account"], F.col("id"), F.col("cost"), 400_000)


@query("w07_first_per_sector", f"SELECT region, gid % 4 AS sector, id FROM (SELECT *, row_number() OVER (PARTITION BY region, gid % 4 ORDER BY height DESC NULLS LAST, id) AS r FROM ({BLD})) WHERE r = 1")
def w07(spark, d):
    f = frame(spark, d, BLD).withColumn("sector", F.col("gid") % 4)
    return ordered.first_of(f, ["region", "sector"], [F.col("height").desc_nulls_last(), F.col("id")]).select("region", "sector", "id")


@query("w08_every_fifth_holdout", f"SELECT id, row_number() OVER (PARTITION BY region ORDER BY id) % 5 = 0 AS holdout FROM ({BLD})")
def w08(spark, d):
    return frame(spark, d, BLD).select("id", (F.row_number().over(Window.partitionBy("region").orderBy("id")) % 5 == 0).alias("holdout"))


SAMPLES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 200 AS x, l_suppkey % 50 AS y, l_quantity AS z FROM {lineitem}"


@query("w09_dedup_with_conflict", f"SELECT x, y, arg_min(z, id * 100 + z) AS z, max(z) - min(z) > 10 AS conflict FROM ({SAMPLES}) GROUP BY x, y")
def w09(spark, d):
    return frame(spark, d, SAMPLES).groupBy("x", "y").agg(F.min_by("z", F.struct("id", "z")).alias("z"), ((F.max("z") - F.min("z")) > 10).alias("conflict"))


SEGS = f"seg AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ({LINES}) WINDOW w AS (PARTITION BY line ORDER BY n)) WHERE nx IS NOT NULL), cum AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY n) AS stop FROM seg WHERE len > 0), span AS (SELECT *, stop - len AS start, max(stop) OVER (PARTITION BY line) AS total FROM cum), pts AS (SELECT *, unnest(list_concat(list_transform(range(CAST(ceil(start / 50) AS BIGINT), CAST(ceil(stop / 50) AS BIGINT)), lambda i: i * 50e0), CASE WHEN stop = total THEN [stop] ELSE [] END)) AS vt FROM span)"


@query("w10_arclength_resampling", f"WITH {SEGS} SELECT line, {micro_sql('vt')} AS at_micro, {micro_sql('x + (vt - start) / len * (nx - x)')} AS px_micro, {micro_sql('y + (vt - start) / len * (ny - y)')} AS py_micro FROM pts")
def w10(spark, d):
    p = ordered.resample(frame(spark, d, LINES), ["line"], "n", 50.0)
    return p.select("line", micro(F.col("at")).alias("at_micro"), micro(F.col("px")).alias("px_micro"), micro(F.col("py")).alias("py_micro"))


@query("w13_separated_bearings", "WITH RECURSIVE b AS (SELECT l_orderkey AS scene, CAST(l_partkey * 13 % 360 AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 13 % 360, l_linenumber) AS i FROM {lineitem}), f AS (SELECT DISTINCT scene, 0 AS i, CAST([] AS DOUBLE[]) AS kept FROM b UNION ALL SELECT b.scene, b.i, CASE WHEN len(kept) >= 2 OR len(list_filter(kept, lambda y: abs((b.v - y + 180) - 360 * floor((b.v - y + 180) / 360) - 180) <= 50)) > 0 THEN kept ELSE list_append(kept, b.v) END FROM f JOIN b ON b.scene = f.scene AND b.i = f.i + 1), l AS (SELECT scene, arg_max(kept, i) AS kept FROM f GROUP BY scene) SELECT scene, CAST(kept[1] AS BIGINT) AS first, CAST(kept[2] AS BIGINT) AS second FROM l")
def w13(spark, d):
    from ..functions.geo import angle_gap

    b = (F.col("l_partkey") * 13 % 360).cast("double")
    per = frame(spark, d, LI).groupBy(F.col("l_orderkey").alias("scene")).agg(F.array_sort(F.collect_list(b)).alias("v"))
    kept = per.select("scene", ordered.separated(F.col("v"), angle_gap, 50, 2).alias("k"))
    return kept.select("scene", F.get("k", 0).cast("long").alias("first"), F.get("k", 1).cast("long").alias("second"))


@query("w15_sliding_rate", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM {events})")
def w15(spark, d):
    s = frame(spark, d, "SELECT event_id, user_id, unix_timestamp(ts) AS s FROM {events}")
    return s.select(F.col("event_id").alias("id"), N().over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)).alias("in_window"))


# -- top-k -----------------------------------------------------------------------------


@query("o03_closest_120", f"SELECT id FROM ({NODE}) ORDER BY {DIST2}, id LIMIT 120")
def o03(spark, d):
    d2 = (F.col("x") - 900) * (F.col("x") - 900) + (F.col("y") - 700) * (F.col("y") - 700)
    return frame(spark, d, NODE).orderBy(d2, "id").limit(120).select("id")


@query("o04_named_orders", f"SELECT id FROM ({BLD}) ORDER BY CASE source WHEN 'Brand#11' THEN 0 WHEN 'Brand#22' THEN 1 ELSE 2 END, height DESC NULLS LAST, id LIMIT 50")
def o04(spark, d):
    rank = F.when(F.col("source") == "Brand#11", 0).when(F.col("source") == "Brand#22", 1).otherwise(2)
    return frame(spark, d, BLD).orderBy(rank, F.col("height").desc_nulls_last(), "id").limit(50).select("id")


@query("o05_stable_hash_order", f"SELECT id FROM ({BLD}) ORDER BY sha256(CAST(id AS VARCHAR)) LIMIT 100")
def o05(spark, d):
    return frame(spark, d, BLD).orderBy(F.sha2(F.col("id").cast("string"), 256)).limit(100).select("id")


@query("o09_preference_group_order", f"SELECT source, CAST(row_number() OVER (ORDER BY min(region) > 0, max(height) DESC NULLS LAST, source) AS INTEGER) AS place FROM ({BLD}) GROUP BY source")
def o09(spark, d):
    per = frame(spark, d, BLD).groupBy("source").agg(F.min("region").alias("r"), F.max("height").alias("h"))
    return per.select("source", F.row_number().over(Window.orderBy(F.col("r") > 0, F.col("h").desc_nulls_last(), "source")).alias("place"))


@query("o10_tallest_four", f"SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY height DESC NULLS LAST, id) AS r FROM ({BLD})) WHERE r <= 4")
def o10(spark, d):
    w = Window.partitionBy("source").orderBy(F.col("height").desc_nulls_last(), "id")
    return frame(spark, d, BLD).withColumn("r", F.row_number().over(w)).filter("r <= 4").select("source", "id")


@query("o11_seeded_cells", f"WITH {grids.SYNTHETIC_SQL} SELECT row, col FROM grid WHERE occupancy = 0 ORDER BY md5('7:' || row || ':' || col) LIMIT 200")
def o11(spark, d):
    mark = F.md5(F.concat_ws(":", F.lit("7"), "row", "col").cast("binary"))
    return G(spark).filter("occupancy = 0").orderBy(mark).limit(200).select("row", "col")


@query("o12_balanced_states", f"SELECT id, state FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5('b:' || id)) AS r FROM ({NODE})) WHERE r <= 33")
def o12(spark, d):
    w = Window.partitionBy("state").orderBy(F.md5(F.concat(F.lit("b:"), F.col("id").cast("string")).cast("binary")))
    return frame(spark, d, NODE).withColumn("r", F.row_number().over(w)).filter("r <= 33").select("id", "state")


@query("o13_strata_then_reservoir", f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY x // 250, y // 250 ORDER BY md5('s:' || id)) = 1 AS first FROM ({NODE})) SELECT id FROM s ORDER BY NOT first, md5('s:' || id) LIMIT 120")
def o13(spark, d):
    mark = F.md5(F.concat(F.lit("s:"), F.col("id").cast("string")).cast("binary"))
    w = Window.partitionBy(F.floor(F.col("x") / 250), F.floor(F.col("y") / 250)).orderBy(mark)
    return frame(spark, d, NODE).withColumn("first", F.row_number().over(w) == 1).orderBy(~F.col("first"), mark).limit(120).select("id")


# -- sets ------------------------------------------------------------------------------


@query("u03_concatenated_layers", "SELECT 'customer' AS layer, c_name AS name FROM {customer} UNION ALL SELECT 'supplier', s_name FROM {supplier}")
def u03(spark, d):
    a = frame(spark, d, "SELECT 'customer' AS layer, c_name AS name FROM {customer}")
    return a.unionByName(frame(spark, d, "SELECT 'supplier' AS layer, s_name AS name FROM {supplier}"))


@query("u04_expected_minus_assembled", "SELECT p_partkey AS id FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 10")
def u04(spark, d):
    return frame(spark, d, "SELECT p_partkey AS id FROM {part}").exceptAll(frame(spark, d, "SELECT DISTINCT l_partkey AS id FROM {lineitem} WHERE l_quantity > 10"))


@query("u05_missing_members", "SELECT DISTINCT l_suppkey * 2 AS id FROM {lineitem} WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM {supplier})")
def u05(spark, d):
    return frame(spark, d, "SELECT DISTINCT l_suppkey * 2 AS id FROM {lineitem}").join(frame(spark, d, "SELECT s_suppkey AS id FROM {supplier}"), "id", "left_anti")


@query("u06_unknown_fields", "SELECT event_id AS id, len(list_filter(json_keys(props), lambda k: k NOT IN ('k', 'page'))) AS extra FROM {events}")
def u06(spark, d):
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return frame(spark, d, "SELECT * FROM {events}").select(F.col("event_id").alias("id"), F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("page")))).cast("long").alias("extra"))


@query("u07_cell_set_algebra", f"WITH {grids.SYNTHETIC_SQL}, a AS (SELECT row, col FROM grid WHERE occupancy = 1), b AS (SELECT row, col FROM grid WHERE out_mask = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS joined, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS rest")
def u07(spark, d):
    a, b = G(spark).filter("occupancy = 1").select("row", "col"), G(spark).filter("out_mask = 1").select("row", "col")
    one = a.union(b).distinct().agg(N().alias("joined"))
    two = a.intersect(b).agg(N().alias("shared"))
    three = b.subtract(a).agg(N().alias("rest"))
    return one.crossJoin(two).crossJoin(three)


@query("u08_unique_footprints", f"SELECT min(id) AS id FROM ({BLD}) GROUP BY sha256(gid || ':' || coalesce(CAST(CAST(height AS INTEGER) AS VARCHAR), '-'))")
def u08(spark, d):
    sig = F.sha2(F.concat_ws(":", "gid", F.coalesce(F.col("height").cast("int").cast("string"), F.lit("-"))), 256)
    return frame(spark, d, BLD).groupBy(sig.alias("sig")).agg(F.min("id").alias("id")).select("id")

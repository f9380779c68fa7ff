"""Contexts, forecasts, polygons, geometry blobs and file audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT = (
    "schema_version int, nodes array<struct<id:string,lon:double,lat:double,tags:map<string,string>>>, "
    "edges array<struct<u:string,v:string,length_m:double,directed:boolean,tags:map<string,string>,access_status:string,steps:boolean>>"
)
FORECAST = "hourly struct<time:array<string>,precipitation:array<double>,cloud_cover:array<double>,visibility:array<double>,wind_speed_10m:array<double>>, daily struct<sunrise:array<string>,sunset:array<string>>"


def read_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of walking contexts; version 1 with nodes, or an error."""
    raw = spark.read.schema(CONTEXT).option("multiLine", True).json(path)
    return split_context(raw)


def split_context(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    fine = (F.col("schema_version") == 1) & (F.size("nodes") > 0)
    raw = raw.withColumn("nodes", F.when(fine, F.col("nodes")).otherwise(F.raise_error(F.lit("a context needs schema_version 1 and nodes")).cast(raw.schema["nodes"].dataType)))
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("edges").alias("e")).select("e.*")


def hours(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """One row an hour of forecast payloads (JSON): key, vt, rain, cloud, sight, wind; nulls stay null."""
    h = F.from_json(F.col(body), FORECAST)["hourly"]
    each = payloads.select(key, F.explode(F.arrays_zip(h["time"].alias("time"), h["precipitation"].alias("rain"), h["cloud_cover"].alias("cloud"), h["visibility"].alias("sight"), h["wind_speed_10m"].alias("wind"))).alias("h"))
    return each.select(key, F.unix_timestamp(F.to_timestamp("h.time", "yyyy-MM-dd'T'HH:mm")).alias("vt"), "h.rain", "h.cloud", "h.sight", "h.wind")


def geometry_body(blob: Column) -> Column:
    """The WKB of a geometry blob with a GP header; null for another header."""
    code = F.shiftright(F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int"), 1).bitwiseAND(7)
    skip = F.element_at(F.array(*[F.lit(x) for x in (8, 40, 56, 56, 72)]), F.least(code, F.lit(4)) + 1)
    return F.when((F.substring(blob, 1, 2) == F.lit(b"GP")) & (code <= 4), F.substring(blob, skip + 1, F.length(blob)))


def wkb_point(body: Column) -> Column:
    """struct(little_endian, kind) of a WKB header."""
    hexed = F.hex(F.substring(body, 2, 1))
    return F.struct((F.hex(F.substring(body, 1, 1)) == "01").alias("little_endian"), F.conv(hexed, 16, 10).cast("int").alias("kind"))


def polygons(lines: DataFrame) -> DataFrame:
    """section, hole, n, x, y of an extraction polygon (lines n, value): the file's name, then
    sections that begin with a name (! for a hole) and end with END."""
    from pyspark.sql import Window

    w = Window.orderBy("n")
    body = lines.withColumn("v", F.trim("value")).filter("v <> ''").withColumn("before", F.lag("v").over(w)).withColumn("first", F.min("n").over(Window.partitionBy()))
    starts = (F.col("before") == "END") | (F.lag("n").over(w) == F.col("first"))
    body = body.withColumn("is_name", F.coalesce(starts, F.lit(True)) & (F.col("v") != "END") | (F.col("n") == F.col("first")))
    body = body.withColumn("section", F.last(F.when(F.col("is_name") & (F.col("n") != F.col("first")), F.col("v")), True).over(w))
    xy = F.split("v", r"\s+")
    return body.filter(~F.col("is_name") & (F.col("v") != "END") & F.col("section").isNotNull()).select("section", F.col("section").startswith("!").alias("hole"), "n", F.get(xy, 0).cast("double").alias("x"), F.get(xy, 1).cast("double").alias("y"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def compare_package(have: DataFrame, want: DataFrame) -> DataFrame:
    """name and problem (missing, unexpected, changed) of files against a manifest (name, length, sha256)."""
    h = have.select("name", F.col("length").alias("hl"), F.col("sha256").alias("hs"))
    both = want.join(h, "name", "full")
    problem = F.when(F.col("hs").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("hl") != F.col("length")) | (F.col("hs") != F.col("sha256")), "changed")
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def write_once(df: DataFrame, path: str, partition: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write a result exclusively: an existing path is an error, a failed write leaves none committed."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition) if partition else w).format(fmt).save(path)


def features_json(df: DataFrame, limit: int, most_bytes: int) -> DataFrame:
    """GeoJSON-like features under a size limit each, at most limit of them by id: id, body."""
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct("name").alias("properties")))
    return df.select("id", body.alias("body")).filter(F.octet_length("body") <= most_bytes).orderBy("id").limit(limit)

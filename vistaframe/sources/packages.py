"""Packages of artifacts with checksums, and reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contexts import write_once


def manifest(artifacts: DataFrame) -> DataFrame:
    """name, bytes, sha256 of artifacts (name, body BINARY)."""
    return artifacts.select("name", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))


def package_id(files: DataFrame, version: str) -> DataFrame:
    """package_id, files, bytes: an id that follows from the names and checksums alone."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda f: F.concat_ws(" ", f["name"], f["sha256"]))
    digest = F.sha2(F.array_join(lines, "\n"), 256)
    return files.agg(F.concat(F.lit(f"{version}-"), F.substring(digest, 1, 12)).alias("package_id"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def refused() -> Column:
    """Why an artifact must not be published, or null (its receipt's checksum joined in)."""
    return F.when(F.col("receipt").isNull(), "no receipt").when(F.col("receipt") != F.col("sha256"), "checksum mismatch").when(F.col("copies") > 1, "names collide")


def checked(artifacts: DataFrame, receipts: DataFrame) -> DataFrame:
    """name, bytes, sha256, problem. receipts: name, receipt (the checksum when it was made)."""
    found = manifest(artifacts)
    copies = found.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    return found.join(copies, "name").join(receipts, "name", "left").select("name", "bytes", "sha256", refused().alias("problem"))


def publish(artifacts: DataFrame, receipts: DataFrame, version: str, folder: str) -> str:
    """Write artifacts and their manifest below folder, in a path of the package's own id; the
    path. Any problem refuses the whole package; a path that exists is an error."""
    state = checked(artifacts, receipts)
    bad = state.filter("problem IS NOT NULL").orderBy("name").first()
    if bad:
        raise ValueError(f"{bad['name']}: {bad['problem']}; publication refused")
    files = state.drop("problem")
    path = f"{folder.rstrip('/')}/{package_id(files, version).first()['package_id']}"
    write_once(files, f"{path}/manifest", fmt="json")
    write_once(artifacts, f"{path}/artifacts")
    return path


def validated(spark: SparkSession, path: str) -> DataFrame:
    """name, problem (missing, unexpected, changed) of a published package; none if it is whole."""
    want = spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/manifest")
    have = manifest(spark.read.parquet(f"{path}/artifacts")).select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    both = want.join(have, "name", "full")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("b") != F.col("bytes")) | (F.col("s") != F.col("sha256")), "changed")
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def run_report(runs: DataFrame, key: list[str], value: str, folder: str) -> DataFrame:
    """key, runs, low, median, p95, high of timed runs, read back from what was written: every
    run as CSV, and the report as JSON (folder/runs, folder/report)."""
    write_once(runs.select(*key, value), f"{folder}/runs", fmt="csv")
    kept = runs.sparkSession.read.schema(runs.select(*key, value).schema).csv(f"{folder}/runs")
    report = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("runs"), F.min(value).alias("low"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("high"))
    write_once(report, f"{folder}/report", fmt="json")
    return runs.sparkSession.read.schema(report.schema).json(f"{folder}/report")

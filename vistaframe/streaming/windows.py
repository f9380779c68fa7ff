"""Streaming windows over observations and calls. Columns: ts TIMESTAMP, key and value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

LATE = "2 hours"


def sliding_rate(events: DataFrame, key: str, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Calls of a key in sliding windows; late rows beyond the watermark are dropped."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, step).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("start"), key, "calls")


def slid(steps: DataFrame, key: str, width: int = 60, step: int = 10) -> DataFrame:
    """Sliding windows (in seconds, width a multiple of step) from the drained rates of single
    steps, so that a stream keeps one count of a step, not one of each window over it."""
    starts = F.sequence(F.col("start") - F.make_dt_interval(secs=F.lit(width - step)), F.col("start"), F.make_dt_interval(secs=F.lit(step)))
    return steps.select(F.explode(starts).alias("start"), key, "calls").groupBy("start", key).agg(F.sum("calls").alias("calls"))


def sessions(events: DataFrame, key: str, gap: str = "3600 seconds") -> DataFrame:
    """Sessions of a key that end after a silent gap."""
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("views")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "views")


def daily_spend(events: DataFrame, value: str, cap: float) -> DataFrame:
    """Spend of each day and whether it is over the cap."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"))
    total = F.sum(value)
    return w.agg(total.alias("spent"), F.count(F.lit(1)).alias("calls")).select(F.col("w.start").alias("day"), "spent", "calls", (F.col("spent") > cap).alias("over"))


def current_observations(stream: DataFrame, visits: DataFrame, key: str, at: str = "visit_at") -> DataFrame:
    """Observations joined to visits they still hold for: at most two hours old, none from after."""
    joined = stream.withWatermark("ts", LATE).join(visits, key)
    return joined.filter((F.col("ts") <= F.col(at)) & (F.col("ts") >= F.col(at) - F.expr("interval 2 hours")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """events (a Parquet file or a folder of them) as a stream, with ts as an instant.

    The path goes in as a pattern of itself: a stream takes one file only that way.
    """
    path = path.rstrip("/")
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


#: State of a drained stream: on the executors' disks.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its rows (for batch callers and tests).

    Batches are written to the shared folder, so no row passes through the driver: of a
    complete result the last batch holds, else all of them together.
    """
    spark = result.sparkSession
    folder, written = f"{shared_folder(spark)}/s{uuid.uuid4().hex}", []

    def keep(rows: DataFrame, batch: int) -> None:
        path = f"{folder}/rows-{batch}"
        rows.write.mode("overwrite").parquet(path)
        written.append(path)

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        run = result.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/run").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    run.awaitTermination()
    paths = sorted(set(written)) if mode != "complete" else written[-1:]
    return spark.read.schema(result.schema).parquet(*paths) if paths else spark.createDataFrame([], result.schema)

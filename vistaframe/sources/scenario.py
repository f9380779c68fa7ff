"""The fictional scenario's landmarks, as offsets in metres from its centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CENTRE = (126.978, 37.571)
#: Id, east and north offset.
LANDMARKS = (("river", 1300, 150), ("ridge", -1100, 1400), ("garden", -900, -1000), ("tower", 1800, 1000), ("bridge", 1100, -300))


def landmarks(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("id"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for a, x, y in LANDMARKS])
    at = spark.range(1).select(F.explode(rows).alias("v")).select("v.*")
    lon = CENTRE[0] + F.col("dx") / (111_320 * F.cos(F.radians(F.lit(CENTRE[1]))))
    return at.withColumn("lon", lon).withColumn("lat", CENTRE[1] + F.col("dy") / 111_320)

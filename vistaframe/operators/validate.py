"""Checks of requests and timestamps that give reasons instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(name: str, low: float, high: float) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c.cast("double")) & c.between(low, high)


def one_of(name: str, *values: str) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def strict_boolean(name: str, df: DataFrame) -> Column:
    """Only a real boolean passes: the text "false" is an error."""
    return F.lit(dict(df.dtypes)[name] == "boolean") & F.col(name).isNotNull()


def errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def closed(body: Column, allowed: list[str]) -> Column:
    """A JSON object has no key but the allowed ones."""
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    return F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) == 0


def local_time(raw: Column, zone: str) -> Column:
    """ok, unreadable, nonexistent (in a gap) or ambiguous (in a fold) of a naive local time."""
    naive = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss"))
    utc = F.to_utc_timestamp(naive, zone)
    back = F.from_utc_timestamp(utc, zone)
    hour = F.expr("interval 1 hour")
    twin = (F.from_utc_timestamp(utc + hour, zone) == naive) | (F.from_utc_timestamp(utc - hour, zone) == naive)
    return F.when(naive.isNull(), "unreadable").when(back != naive, "nonexistent").when(twin, "ambiguous").otherwise("ok")


def suggestions(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """field, kind of columns whose lower-cased names fit a pattern."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("field"))
    kind = F.coalesce(*[F.when(F.lower("field").rlike(p), F.lit(k)) for k, p in patterns.items()])
    return names.select("field", kind.alias("kind")).filter("kind IS NOT NULL")

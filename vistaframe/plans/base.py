"""Registration of queries with their SQL, and the inputs that both state the same way."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, the SQL of the same rows."""

    def wrap(run):
        ENTRIES[name] = (run, plain(sql) if sql else None)
        return run

    return wrap


def plain(text: str) -> str:
    """Inputs written as {table} become names of views."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A frame of SQL over driver tables written as {table}."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names}) if names else spark.sql(text)


def micro(c: Column) -> Column:
    """Whole millionths, so that two engines agree on a float result."""
    return F.floor(c * 1_000_000 + F.lit(0.5)).cast("long")


def micro_sql(text: str) -> str:
    return f"CAST(floor(({text}) * 1000000 + 0.5) AS BIGINT)"

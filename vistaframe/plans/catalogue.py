"""The registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .base import ENTRIES

for _name in ("sight_queries", "scalar_queries", "rank_queries", "spatial_queries", "audit_queries", "prepare_queries", "scene_queries", "scan_queries", "source_queries"):
    import_module(f".{_name}", __package__)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES["g04_sparse_sight_lines"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}

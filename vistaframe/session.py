"""Session and table helpers shared by every layer."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the environment does not provide it.

    The workers find it on PYTHONPATH or in the working folder; elsewhere Spark sends
    them a zip of the sources, once for a session.
    """
    context = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(context, "_vistaframe_shipped", False) or str(_ROOT) in map(os.path.abspath, filter(None, known)):
        return
    path = os.path.join(tempfile.mkdtemp(), "vistaframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "vistaframe").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(path)
    context._vistaframe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for scratch tables: spark.checkpoint.dir.

    A session on one machine that names none (a test) gets a folder of its own, set as its
    checkpoint folder; on a cluster the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = context.getCheckpointDir()
        if not root:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="vistaframe-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vistaframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

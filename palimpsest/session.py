"""Session helpers: builder defaults for local runs and worker import path."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution; a cluster session needs no helper."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return workers_can_import(spark)


def workers_can_import(spark: SparkSession) -> SparkSession:
    """Put the repository on the Python workers' path (on a cluster ship the package with --py-files)."""
    env = spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark

"""SparkSession factory with the settings the engine is designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "questlake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution.

    Without ``master`` the cluster's own setting holds; shuffle partitions are left
    to the cluster too unless given in ``extra`` (dots written as ``__``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "questlake", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = cpus or os.cpu_count() or 4
    conf = {"spark__sql__shuffle__partitions": str(n), "spark__driver__memory": "8g"} | extra
    return get_session(app, f"local[{n}]", **conf)

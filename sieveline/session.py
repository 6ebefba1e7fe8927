"""Session factory used by the tests, the bench and interactive work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "sieveline", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session with adaptive execution on and UTC time; a cluster session is left to the caller."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

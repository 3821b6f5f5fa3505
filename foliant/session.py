"""One place that builds a session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "foliant", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FOLIANT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Sessions for running on one machine; on a cluster the caller brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "snapledger") -> SparkSession:
    partitions = str(cores) if str(cores).isdigit() else str(os.cpu_count() or 8)
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", partitions)
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("SNAPLEDGER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .getOrCreate())

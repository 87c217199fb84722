"""Session defaults for local runs; on a cluster the session is the caller's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(threads: int | str = "*", memory: str = "4g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("veridoc")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

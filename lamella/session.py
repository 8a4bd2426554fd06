"""Session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "12g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use. On a cluster, make the session there instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lamella")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )

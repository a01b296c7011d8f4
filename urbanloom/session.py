"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "urbanloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster pass a ready session to the operators instead."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

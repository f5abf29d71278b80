"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "larkspur", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are written for (AQE on, UTC, Arrow on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """The Parquet table `name` of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""The session that tests, the bench and notebooks use; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, name: str = "lanescope") -> SparkSession:
    """A local session with the settings every job here assumes: UTC, adaptive plans, Arrow."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LANESCOPE_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have, for joins whose pairs are far more than their rows: adaptive plans
    go by the rows and would merge those tasks to a few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialised(df: DataFrame) -> DataFrame:
    """The rows of df, computed now, so that what fails in a task fails here: in the checkpoint folder where the session has
    one, which lost executors don't take with them, else in executors' storage."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df

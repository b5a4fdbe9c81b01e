"""Session defaults for tests, the bench and notebooks; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on: UTC, Arrow and adaptive execution."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kgspark")
        .config("spark.driver.memory", os.environ.get("KGSPARK_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

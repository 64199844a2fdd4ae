"""A session with the defaults the plans were written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | None = None, memory: str = "8g", **more: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used as it is."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tarnhelm").config("spark.driver.memory", memory)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus)} | {k.replace("__", "."): v for k, v in more.items()}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

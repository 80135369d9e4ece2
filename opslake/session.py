"""Session settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Valid on a laptop and on a cluster alike; sizes such as shuffle.partitions
# and executor memory belong to the deployment, so they are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "opslake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "opslake-local", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 4
    local = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.driver.extraJavaOptions": "-Duser.timezone=UTC",
    }
    spark = build_session(app, f"local[{cpus}]", **{**local, **extra})
    spark.sparkContext.setLogLevel("ERROR")
    return spark

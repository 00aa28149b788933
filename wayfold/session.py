"""Session settings that the library expects; used by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "wayfold", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session with adaptive execution and UTC; a cluster's own session serves as well."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WAYFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )

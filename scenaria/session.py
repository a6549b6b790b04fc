"""Session helper for local runs, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "scenaria", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster use the session the platform gives you; nothing in the
    library depends on the values below.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCENARIA_DRIVER_MEMORY", "8g"))
    )
    return builder.getOrCreate()

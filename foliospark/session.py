"""Session construction with the settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "foliospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on.

    ``conf`` keys use ``__`` for dots (``spark__sql__shuffle__partitions="8"``).
    On a cluster, leave ``master`` unset and let spark-submit decide.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master or "MASTER" in os.environ:
        builder = builder.master(master or os.environ["MASTER"])
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

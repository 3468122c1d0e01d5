"""Parquet table access by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``<root>/<name>.parquet``, a file or a directory of files."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")

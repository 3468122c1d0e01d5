"""Writers: tables, append logs, partitioned exports, upserts by batch, prompt batches (O-030..O-041, O-277, O-278)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.plans.scale import numbered


def write_catalog(df: DataFrame, root: str) -> None:
    """Parquet as it is, CSV with arrays as text, JSON lines."""
    df.write.mode("overwrite").parquet(f"{root}/catalog.parquet")
    flat = df.select(*(F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).csv(f"{root}/catalog.csv")
    df.write.mode("overwrite").json(f"{root}/corpus.jsonl")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """JSON lines in one folder per value of the columns."""
    df.write.mode("overwrite").partitionBy(*columns).json(path)


def upsert_batches(old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """Rows of ``old`` whose batch isn't in ``new``, and all of ``new``."""
    return old.join(new.select(batch).distinct(), batch, "left_anti").unionByName(new, allowMissingColumns=True)


def prompt_batches(items: DataFrame, key: str, text: str, size: int = 5, start: int = 1) -> DataFrame:
    """(batch, n, body): items in key order, ``size`` to a batch.

    Positions come from the counts of ranges, so no window sees all rows.
    """
    no = numbered(items.select(F.col(key).alias("k"), F.col(text).alias("t")), "i", "k")
    per = no.withColumn("batch", (F.floor((F.col("i") - 1) / size) + start).cast("bigint"))
    return per.groupBy("batch").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), "\n\n---\n\n").alias("body"))


def new_ids(common: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return common.join(used.select(key).distinct(), key, "left_anti")

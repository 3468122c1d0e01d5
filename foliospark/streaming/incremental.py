"""Structured Streaming: append logs with resume, de-duplication, windows, live ELO (O-240..O-246)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.pairwise import elo
from foliospark.plans.scale import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet file or folder ``path``, with its schema."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    is_file = name.endswith(".parquet") and not _is_dir(spark, path)
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def run_available(stream: DataFrame, where: str | None = None, mode: str = "append") -> DataFrame:
    """Everything there is now through a stream to Parquet, and the result; offsets are kept, so a second run adds only what is new."""
    spark = stream.sparkSession
    root = where or scratch(spark)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def _closed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", delay)


def final_batch(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The state of an aggregation after everything available.

    With ``keys`` in update mode: each batch writes only rows that changed, state
    behind the watermark is dropped, and the last row of a key counts. Without
    (session windows can't be updated) in complete mode, the last batch counts.
    """
    spark = stream.sparkSession
    root = scratch(spark)
    keep = root + "/data"

    def save(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(keep)

    q = stream.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", root + "/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(keep)
    if keys:
        return got.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("r")).select("r.*")
    return got.where(F.col("epoch") == got.agg(F.max("epoch")).scalar()).drop("epoch")


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) per window and key."""
    e = _closed(events, ts, "1 day")
    return e.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def sliding(events: DataFrame, ts: str, key: str, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    e = _closed(events, ts, "1 day")
    return e.groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, n): runs of events with no pause of the gap or more."""
    e = _closed(events, ts, "1 day")
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def first_seen(events: DataFrame, ts: str, key: str, delay: str = "45 days") -> DataFrame:
    """One event per key, whichever comes first; duplicates within the delay are dropped."""
    return _closed(events, ts, delay).dropDuplicatesWithinWatermark([key])


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet: an anti join with the sink in place of a state file."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def live_elo(games: DataFrame, k: float = 32.0, initial: float = 1500.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps ratings in the folder of :func:`scratch`; its ``ratings`` attribute reads them.

    Ratings are one row per model; each batch's games are folded in order on
    top of those that the batch before left.
    """
    spark = games.sparkSession
    root = scratch(spark)

    def fold(df: DataFrame, epoch: int) -> None:
        before = {r["model"]: r["rating"] for r in spark.read.parquet(f"{root}/{epoch - 1}").collect()} if epoch else {}  # one row per model
        now = elo(df, k=k, initial=initial, start=before).select("model", "rating")
        kept = spark.createDataFrame(sorted(before.items()), "model string, rating double").join(now.select("model"), "model", "left_anti")
        now.unionByName(kept).coalesce(1).write.mode("overwrite").parquet(f"{root}/{epoch}")
        fold.epoch = epoch  # type: ignore[attr-defined]

    fold.ratings = lambda: spark.read.parquet(f"{root}/{fold.epoch}")  # type: ignore[attr-defined]
    return fold

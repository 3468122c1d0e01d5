"""Building blocks that keep plans safe at cluster scale."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it holds more than one row in HOT_SHARE; so at most HOT_SHARE keys are hot.
HOT_SHARE = 256
#: A hot key is spread over at most so many salts.
MAX_SALTS = 64
#: A written table of so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
#: A range of a running sum should hold about so many rows.
BUCKET_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="foliospark-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame, *done: DataFrame, loop: bool = False) -> DataFrame:
    """The same rows with their lineage written to the shared checkpoint folder.

    Reliable: the files outlive the executors that wrote them. ``done`` are
    earlier cuts that nothing needs any longer; their files are deleted. In a
    ``loop`` the estimated size is forgotten too: estimates of joins multiply, so
    from step to step they would grow beyond what the optimizer can handle. There
    the size of the files decides whether joins may broadcast the rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    if loop:
        spark = df.sparkSession
        rdd = out._jdf.queryExecution().logical().rdd()
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, out._jdf.schema(), False), spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= BROADCAST_BYTES:
            out = out.hint("broadcast")
    release(*done)
    return out


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here are deleted as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The same rows, written compressed to the shared checkpoint folder; :func:`cut` writes them as they lie in memory.

    For steps between, which are large: their files stay until :func:`release`
    gets the result itself. ``done`` are earlier results that nothing needs any longer.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/packed-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._packed = path
    release(*done)
    return out


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` is a cut of a loop that was found small enough to broadcast."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() in ("UnresolvedHint", "ResolvedHint")


def release(*cuts: DataFrame) -> None:
    """Delete the files of results of :func:`cut` and :func:`packed`; other data frames are left alone."""
    for df in cuts:
        if path := getattr(df, "_packed", None):
            sc = df.sparkSession.sparkContext
            file = sc._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(sc._jsc.hadoopConfiguration()).delete(file, True)
            continue
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() in ("UnresolvedHint", "ResolvedHint"):
            plan = plan.child()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, out: str, *order: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... in the order of columns that tell all rows apart.

    Rows are range-partitioned and written once, so that both the counts and the
    rows see the same partitions; no window sees more than one of them.
    """
    from pyspark.sql import Window as W

    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    bases = ranged.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__b", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return ranged.join(F.broadcast(bases), "__p").withColumn(out, F.col("__b") + F.row_number().over(W.partitionBy("__p").orderBy(*order))).drop("__p", "__b")


def hash_sample(df: DataFrame, rows: int, *keys: str, salt: int = 5) -> DataFrame:
    """About ``rows`` rows, at most twice as many, chosen by the hash of ``keys``; all rows if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * rows / n)).limit(2 * rows)


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``lookup`` on ``key`` without a hot task.

    ``lookup[count]`` holds the number of rows of each key, the same in all its lookup rows. Keys with more than
    1/HOT_SHARE of all rows - at most HOT_SHARE of them, so broadcasting these is
    bounded - are spread over salts by ``spread``; all others use salt 0.
    ``count`` is dropped from the result. Null keys of ``rows`` match nothing.
    """
    hot = (
        lookup.select(key, count).distinct()
        .withColumn("__total", lookup.select(key, count).distinct().agg(F.sum(count)).scalar())
        .where(F.col(count) * HOT_SHARE > F.col("__total"))
        .select(F.col(key).alias("__hot"), F.least(F.ceil(F.col(count) * HOT_SHARE / F.col("__total")), F.lit(MAX_SALTS)).cast("int").alias("__salts"))
    )
    hot = F.broadcast(hot)
    left = (
        rows.join(hot, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__salts").cast("long")).cast("int")))
        .drop("__hot", "__salts")
    )
    right = (
        lookup.drop(count)
        .join(hot, F.col(key) == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
        .drop("__hot", "__salts")
    )
    return left.join(right, [key, "__salt"], how).drop("__salt")


def skew_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` to ``lookup``, whose keys may repeat on both sides, without a hot task.

    Keys of more than 1/HOT_SHARE of ``rows`` (at most HOT_SHARE of them, so
    broadcasting these is bounded) are spread over salts by the column ``spread``.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*")).scalar()
    hot = counts.where(F.col("__n") * HOT_SHARE > total).withColumn("__salts", F.least(F.ceil(F.col("__n") * HOT_SHARE / total), F.lit(MAX_SALTS)).cast("int")).drop("__n")
    hot = F.broadcast(hot)
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1)).cast("long")).cast("int")).drop("__salts")
    right = lookup.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def prefix_sum(df: DataFrame, groups: list[str], position: str, size: str, out: str, buckets: int | Column = 1024, tie: str | None = None) -> DataFrame:
    """Exclusive running sum of ``size`` by ``position`` within ``groups``.

    ``position`` is a double in [0, 1). Each group is cut into ``buckets`` ranges
    of position, a number or a column that is the same within a group, such as
    one range per BUCKET_ROWS rows; only the bucket totals meet in one window, the
    rows themselves are summed bucket by bucket.
    """
    from pyspark.sql import Window as W

    n = F.lit(buckets) if isinstance(buckets, int) else buckets
    b = df.withColumn("__b", F.least(F.floor(F.col(position) * n), n - 1).cast("bigint"))
    totals = b.groupBy(*groups, "__b").agg(F.sum(size).alias("__t"))
    w = W.partitionBy(*groups).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("__o", F.coalesce(F.sum("__t").over(w), F.lit(0))).drop("__t")
    inner = W.partitionBy(*groups, "__b").orderBy(position, *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, -1)
    return (
        b.withColumn("__r", F.coalesce(F.sum(size).over(inner), F.lit(0)))
        .join(offsets, [*groups, "__b"])
        .withColumn(out, F.col("__o") + F.col("__r"))
        .drop("__b", "__o", "__r")
    )

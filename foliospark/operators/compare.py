"""Statistics of comparisons and checks across runs (O-155, O-156, O-206..O-216, O-221..O-225)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.plans.scale import cut


def sign_test_p(wins_a: int, wins_b: int) -> float:
    """Two-sided sign test: exact under 20 decided cases, normal with continuity correction from there on, at most 1."""
    n, k = wins_a + wins_b, min(wins_a, wins_b)
    if n == 0:
        return 1.0
    if n < 20:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    z = (k + 0.5 - n / 2) / math.sqrt(n / 4)
    return min(1.0, 1 + math.erf(z / math.sqrt(2)))


def sign_test_exact(wins_a: Column, wins_b: Column) -> Column:
    """The exact two-sided p as a column, by the recurrence of binomial coefficients."""
    n, k = wins_a + wins_b, F.least(wins_a, wins_b)
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")),
        F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["c"] * (n - i) / (i + 1)).alias("c"), (a["s"] + a["c"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms / F.pow(F.lit(2.0), n)))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; 0 and 0 without cases."""
    p, zz = wins / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def cohens_d(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(mean_a, mean_b, d): difference of means over the root of the mean of the sample variances; 0 where that is 0."""
    in_a, in_b = F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))
    s = df.agg(F.avg(in_a).alias("mean_a"), F.avg(in_b).alias("mean_b"), F.var_samp(in_a).alias("va"), F.var_samp(in_b).alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return s.select(F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round(F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled).otherwise(0.0), 6).alias("d"))


def welch_t(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(t, df): statistic of two independent samples and its degrees of freedom."""
    in_a, in_b = F.when(F.col(group) == a, F.col(value)), F.when(F.col(group) == b, F.col(value))
    s = df.agg(F.avg(in_a).alias("ma"), F.avg(in_b).alias("mb"), (F.var_samp(in_a) / F.count(in_a)).alias("sa"), (F.var_samp(in_b) / F.count(in_b)).alias("sb"), F.count(in_a).alias("na"), F.count(in_b).alias("nb"))
    return s.select(F.round((F.col("ma") - F.col("mb")) / F.sqrt(F.col("sa") + F.col("sb")), 6).alias("t"), F.round(F.pow(F.col("sa") + F.col("sb"), 2) / (F.pow("sa", 2) / (F.col("na") - 1) + F.pow("sb", 2) / (F.col("nb") - 1)), 4).alias("df"))


def mann_whitney_u(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """(u, n_a, n_b) from average ranks.

    Values are first counted per distinct value; ranks are running counts over
    those, so tied rows never meet in one task.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    per = rows.groupBy(value).agg(F.count("*").alias("n"), F.count_if(F.col(group) == a).alias("k"))
    ranged = cut(per.repartitionByRange(value).withColumn("part", F.spark_partition_id()))  # both uses see the same ranges
    totals = ranged.groupBy("part").agg(F.sum("n").alias("t"))
    bases = totals.withColumn("base", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranks = ranged.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    s = ranks.agg(F.sum(F.col("rank") * F.col("k")).alias("r"), F.sum("k").alias("n_a"), F.sum(F.col("n") - F.col("k")).alias("n_b"))
    return s.select(F.round(F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2, 1).alias("u"), "n_a", "n_b")


def kappa(pairs: DataFrame, r1: str, r2: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters; 1 where chance agreement is complete."""
    cells = pairs.where(F.col(r1).isNotNull() & F.col(r2).isNotNull()).groupBy(F.col(r1).alias("x"), F.col(r2).alias("y")).agg(F.count("*").alias("n"))
    flat = cells.select("n", F.explode(F.array(F.struct("x", F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")), F.struct(F.col("y").alias("x"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")))).alias("m")).select("m.*")
    margins = flat.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same")).withColumn("ab", margins.scalar())
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return total.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def fleiss(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """(n_items, kappa) over items with at least two ratings; each item counts with its own number of ratings."""
    per = ratings.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("c"))
    items = per.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s")).where("n >= 2")
    p = items.agg(F.count("*").alias("n_items"), F.avg(F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("po"))
    kept = per.join(items.select(item), item, "left_semi")
    shares = kept.groupBy(label).agg(F.sum("c").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), 2)).alias("pe"))
    both = p.withColumn("pe", shares.scalar())
    return both.select("n_items", F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def confusion(pairs: DataFrame, r1: str, r2: str) -> DataFrame:
    return pairs.groupBy(F.col(r1).alias("label_1"), F.col(r2).alias("label_2")).agg(F.count("*").alias("n"))


def condition_pairs(metrics: DataFrame, condition: str, metric: str, value: str, margin: float = 0.1) -> DataFrame:
    """(metric, condition_a, condition_b, diff, winner) for all pairs of conditions that share a metric."""
    a = metrics.select(F.col(metric).alias("metric"), F.col(condition).alias("condition_a"), F.col(value).alias("x"))
    b = metrics.select(F.col(metric).alias("metric"), F.col(condition).alias("condition_b"), F.col(value).alias("y"))
    d = F.round(F.col("x") - F.col("y"), 6)
    return a.join(b, "metric").where("condition_a < condition_b").select("metric", "condition_a", "condition_b", d.alias("diff"), F.when(d > margin, F.col("condition_a")).when(d < -margin, F.col("condition_b")).otherwise("tie").alias("winner"))


def run_mismatch(runs: DataFrame, run: str, key: str, baseline: str) -> DataFrame:
    """(run, missing, extra): keys that a run lacks of the baseline's, and those it has besides."""
    k = runs.select(F.col(run).alias("run"), F.col(key).alias("k")).distinct()
    base = k.where(F.col("run") == baseline).select("k")
    n_base = base.agg(F.count("*")).scalar()
    hit = k.where(F.col("run") != baseline).join(base.withColumn("in_base", F.lit(1)), "k", "left")
    return hit.groupBy("run").agg((n_base - F.count("in_base")).alias("missing"), (F.count("*") - F.count("in_base")).alias("extra"))


def versions(records: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, digests): data sets that occur with more than one hash."""
    return records.groupBy(name).agg(F.array_sort(F.collect_set(digest)).alias("digests")).where(F.size("digests") > 1)


def sanity(metrics: DataFrame, label: str, examples: str, errors: str, minimum: int, max_rate: float) -> DataFrame:
    """(label, kind): runs that are empty, too small, or fail too often."""
    kinds = F.array_compact(F.array(F.when(F.col(examples) == 0, "empty"), F.when((F.col(examples) > 0) & (F.col(examples) < minimum), "too_few_examples"), F.when((F.col(examples) > 0) & (F.col(errors) / F.col(examples) > max_rate), "high_error_rate")))
    return metrics.select(F.col(label).alias("label"), F.explode(kinds).alias("kind"))

"""Joins of answers with references, BLEU, score roll-ups and summaries (O-092, O-144, O-145, O-160..O-176, O-181)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the judges' scores by mode.
RAG_WEIGHTS = {"factuality": 0.4, "grounding": 0.3, "completeness": 0.2, "communication": 0.1}
INSTRUCTION_WEIGHTS = {"factuality": 0.5, "completeness": 0.3, "communication": 0.2}
PASS_SCORE, PASS_EACH = 0.65, 0.4


def overall(scores: Column, weights: dict[str, float]) -> Column:
    return sum((F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))


def passed(scores: Column, weights: dict[str, float]) -> Column:
    each = F.least(*(F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) for k in weights), F.lit(1.0))
    return (overall(scores, weights) >= PASS_SCORE) & (each >= PASS_EACH)


def verdict_passed(answerability: Column, correctness: Column, clarity: Column, coverage: Column, judged: Column) -> Column:
    """The judge's own verdict, else: every score at least 0.6, and answerability and correctness together at least 1.4."""
    rule = (F.least(answerability, correctness, clarity, coverage) >= 0.6) & (answerability + correctness >= 1.4)
    return F.coalesce(judged, rule)


def join_predictions(dataset: DataFrame, predictions: DataFrame, key: str, reference: str, prediction: str) -> DataFrame:
    """Every example with a status: skipped (no reference), missing (no prediction) or scored."""
    p = predictions.where(F.trim(prediction) != "").select(key, F.col(prediction).alias("prediction"))
    status = F.when(F.coalesce(F.trim(reference), F.lit("")) == "", "skipped").when(F.col("prediction").isNull(), "missing").otherwise("scored")
    return dataset.join(p, key, "left").withColumn("status", status)


def merge_metrics(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, generation, retrieval, sides): full outer join of two metric tables."""
    a, b = left.select(key, F.col(value).alias("generation")), right.select(key, F.col(value).alias("retrieval"))
    side = F.when(F.col("generation").isNull(), "right").when(F.col("retrieval").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").withColumn("sides", side)


def _overlap_counts(prediction: list[str], reference: list[str]) -> list[int]:
    """Clipped matches for n = 1..4, n-gram totals for n = 1..4, and the two lengths."""
    matches, totals = [], []
    for n in range(1, 5):
        p = Counter(zip(*(prediction[i:] for i in range(n)), strict=False))
        r = Counter(zip(*(reference[i:] for i in range(n)), strict=False))
        matches.append(sum((p & r).values()))
        totals.append(max(0, len(prediction) - n + 1))
    return [*matches, *totals, len(prediction), len(reference)]


def bleu4(pairs: DataFrame, prediction: str, reference: str) -> DataFrame:
    """One row with the corpus BLEU-4 of lower-case word tokens, no smoothing.

    Clipped n-gram matches and totals are counted batch by batch in linear time
    (nested array functions would compare every n-gram with every other) and
    only their sums are shuffled.
    """
    names = [*(f"m{n}" for n in range(1, 5)), *(f"t{n}" for n in range(1, 5)), "lp", "lr"]
    toks = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [_overlap_counts(list(p), list(r)) for p, r in zip(pdf["p"], pdf["r"], strict=True)]
            yield pd.DataFrame([[sum(c) for c in zip(*rows, strict=True)]] if rows else [], columns=names)

    sums = pairs.select(toks(prediction).alias("p"), toks(reference).alias("r")).mapInPandas(count, ", ".join(f"{n} bigint" for n in names))
    agg = sums.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    ok = F.least(*(F.col(f"m{n}") for n in range(1, 5))) > 0
    mean = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, 5)), F.lit(0.0)) / 4
    penalty = F.when(F.col("lp") >= F.col("lr"), 1.0).otherwise(F.exp(1 - F.col("lr") / F.col("lp")))
    return agg.select(F.round(F.when(ok, penalty * F.exp(mean)).otherwise(0.0), 6).alias("bleu"), F.col("lp").alias("prediction_tokens"), F.col("lr").alias("reference_tokens"))


def distribution(df: DataFrame, col: Column, name: str = "value") -> DataFrame:
    """(name, n, share): frequencies and their share of all rows; null counts as 'unknown'."""
    from pyspark.sql import Window as W

    counts = df.groupBy(F.coalesce(col, F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))  # one row per value


def distribution_issues(df: DataFrame, col: str, expected: list[str], minimum: int) -> DataFrame:
    """(value, n, kind): expected values that are missing or under the minimum, and unexpected ones."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    want = df.sparkSession.createDataFrame([(x,) for x in expected], "value string")
    a = want.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(F.col("n") < minimum, "below_minimum").alias("kind")).where("kind is not null")
    return a.unionByName(counts.join(F.broadcast(want), "value", "left_anti").withColumn("kind", F.lit("unexpected")))


def exclusive_quantile(values: Column, q: float) -> Column:
    """Quantile by position (n + 1) q of a sorted array of doubles, kept within it."""
    n = F.size(values)
    h = F.least(F.greatest((n + 1) * F.lit(q), F.lit(1.0)), n.cast("double"))
    lo = F.floor(h).cast("int")
    return F.element_at(values, lo) + (h - lo) * (F.element_at(values, F.least(lo + 1, n)) - F.element_at(values, lo))


def describe(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear percentiles per group."""
    v = df.select(F.coalesce(F.col(group), F.lit("unknown")).alias(group), value.cast("double").alias("v")).where("v is not null")
    return v.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg("v"), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"),
        F.min("v").alias("least"),
        F.round(F.percentile("v", F.lit(0.05)), 6).alias("p05"),
        F.round(F.median("v"), 6).alias("p50"),
        F.round(F.percentile("v", F.lit(0.95)), 6).alias("p95"),
        F.max("v").alias("most"),
    )


def grouped_means(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Means over everything and per group, by grouping sets; scope tells which."""
    return (
        df.groupingSets([[], [F.col(group)]], F.col(group))
        .agg(F.grouping(group).alias("g"), F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(f"avg_{m}") for m in metrics))
        .select(F.when(F.col("g") == 1, "overall").otherwise("group").alias("scope"), group, "n", *(f"avg_{m}" for m in metrics))
    )


def score_rollup(df: DataFrame, label: str, scores: str) -> DataFrame:
    """(label, metric, n, mean, std, least, most) of a map of scores, one row per key."""
    rows = df.select(label, F.explode(scores).alias("metric", "v")).where("v is not null and not isnan(v)")
    return rows.groupBy(label, "metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def timing(df: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, mean, least, most, total) of columns of seconds."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("v")) for s in stages))).alias("x")).select("x.*").where("v is not null")
    return long.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.sum("v"), 3).alias("total"))


def histogram(df: DataFrame, value: Column, buckets: int = 5) -> DataFrame:
    """(bucket, n) of scores in [0, 1]; the last bucket is closed above."""
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(value * buckets))).cast("int")
    return df.where(value.isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def weighted_consensus(judgments: DataFrame, item: str, verdict: Column, weight: Column, order: list[str]) -> DataFrame:
    """(item, verdict, agreement, n): verdict with the largest weight, ties to the first in order; agreement is its share of votes."""
    v = judgments.select(F.col(item).alias("item"), verdict.alias("v"), weight.alias("w"), F.struct(*order).alias("o")).where("v is not null")
    per = v.groupBy("item", "v").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("o").alias("o"))
    best = per.groupBy("item").agg(F.max("w").alias("top"), F.sum("n").alias("total"))
    win = per.join(best, "item").where("w = top").groupBy("item").agg(F.min_by(F.struct("v", "n"), "o").alias("x"), F.first("total").alias("total"))
    return win.select(F.col("item").alias(item), F.col("x.v").alias("verdict"), F.round(F.col("x.n") / F.col("total"), 6).alias("agreement"), F.col("total").alias("n_votes"))

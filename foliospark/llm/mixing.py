"""Problem 9: documents mixed so that each source has its share of all tokens.

Time-varying curriculum: each source's weight changes linearly over training and
averages its target share; weights add up to 1 at any time. The weight schedule
is integrated to the source's cumulative token demand, the demand is inverted at
each document's place in its source's token order, and documents are range-sorted
by the resulting position.

The mixture is as large as the scarcest source allows under its cap on repeats,
unless ``total_tokens`` asks for less. A source is used in whole passes and one
partial pass over its documents in hash order, ended where its demand is met.

Scale: running token sums are built from totals of ranges of BUCKET_ROWS documents,
so no source, however large, meets in one task; the final order is a range sort.

Defined results: spellings of a source are merged; documents of unknown or null
source, without tokens or without id are not drawn; a target source without any
tokens is left out and the other shares are scaled up; null shares and caps under
one mean no use; equal positions are ordered by id and copy; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.token_sizes import DEFAULT_TOKENIZER, sizes
from foliospark.plans.scale import BUCKET_ROWS, cut, prefix_sum

STEEPEST = 0.6


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def default_slopes(shares: dict[str, float]) -> dict[str, float]:
    """Slopes from falling (largest source) to rising (smallest), with share-weighted mean zero."""
    order = sorted(shares, key=lambda s: (-shares[s], s))
    raw = {s: (2 * i / max(1, len(order) - 1) - 1) * STEEPEST for i, s in enumerate(order)}
    if len(order) < 2:
        return dict.fromkeys(order, 0.0)
    mean = sum(raw[s] * shares[s] for s in order) / sum(shares.values())
    slopes = {s: raw[s] - mean for s in order}
    top = max(1.0, max(abs(x) for x in slopes.values()) / 0.95)  # weights stay positive
    return {s: x / top for s, x in slopes.items()}


def mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = DEFAULT_TOKENIZER, total_tokens: float | None = None, slopes: dict[str, float] | None = None) -> DataFrame:
    """(position, doc_id, copy, source, tokens): the drawn documents in training order."""
    spark = docs.sparkSession
    sized = cut(sizes(docs.withColumn("__source", source_key(F.col(source_col))), id_col, text_col, ("__source",), tokenizer).select(F.col(id_col).alias("doc_id"), F.col("__source").alias("source"), "tokens").where("tokens > 0 and source is not null"))
    goal = {r["s"]: (float(r["share"]), int(r["cap"])) for r in targets.select(source_key(F.col("source")).alias("s"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("s is not null and share > 0 and cap >= 1").collect()}
    found = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).where(F.col("source").isin(list(goal))).collect()
    have, n_docs = {r["source"]: int(r["t"]) for r in found}, {r["source"]: int(r["n"]) for r in found}
    goal = {s: g for s, g in goal.items() if have.get(s)}
    if not goal:
        return spark.createDataFrame([], "position double, doc_id bigint, copy int, source string, tokens bigint")
    whole = sum(g[0] for g in goal.values())
    shares = {s: g[0] / whole for s, g in goal.items()}
    largest = min(have[s] * goal[s][1] / shares[s] for s in goal)
    total = min(largest, total_tokens) if total_tokens else largest
    slopes = slopes or default_slopes(shares)
    rows = []
    for s in sorted(goal):
        demand = shares[s] * total
        passes = min(goal[s][1], int(demand / have[s] + 1e-9))
        rest = max(0.0, demand - passes * have[s]) if passes < goal[s][1] else 0.0
        rows.append((s, passes, rest, demand, have[s], float(slopes.get(s, 0.0)), 1 + n_docs[s] // BUCKET_ROWS))
    plan = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest double, demand double, have bigint, slope double, ranges bigint"))  # one row per target source
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40)) / float(1 << 40)
    summed = prefix_sum(sized.join(plan, "source").withColumn("__p", place), ["source"], "__p", "tokens", "before", buckets=F.col("ranges"), tie="doc_id").drop("__p")
    drawn = (
        summed
        .withColumn("n", F.col("passes") + (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
        .where("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("u", F.least(F.lit(1.0), ((F.col("copy") - 1) * F.col("have") + F.col("before") + F.col("tokens") / 2) / F.greatest("demand", F.lit(1.0))))
    )
    s, u = F.col("slope"), F.col("u")
    at = F.when(F.abs(s) < 1e-9, u).otherwise((F.sqrt((1 - s) * (1 - s) + 4 * s * u) - (1 - s)) / (2 * s))
    return drawn.select(at.alias("position"), "doc_id", "copy", "source", "tokens").orderBy("position", "doc_id", "copy")


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, n_docs, max_used): one row per target source."""
    per = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_docs"), F.max("copy").alias("max_used"))
    total = per.agg(F.sum("tokens").alias("all"))
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share")
    return (
        want.join(per, "source", "left")
        .withColumn("all", total.scalar())
        .select("source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("all"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_used", F.lit(0)).alias("max_used"))
    )

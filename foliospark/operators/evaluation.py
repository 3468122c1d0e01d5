"""Per-row evaluation, summaries, profiles and joins of judges, logs and annotations (O-084, O-122, O-126, O-141, O-142, O-146, O-150, O-156, O-168, O-169, O-171, O-186, O-204, O-217, O-232, O-235, O-271, O-272)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import citations as C
from foliospark.functions.text import normalise_instruction, path_stem, words
from foliospark.operators.dataset import rank_hash


def densities(text: Column) -> dict[str, Column]:
    """Per 1,000 words: citation markers, links and footnote links (a number before a link), 0 without words."""
    t = F.coalesce(text, F.lit(""))
    n = F.size(words(t))
    per = lambda pattern: F.when(n > 0, 1000 * F.regexp_count(t, F.lit(pattern)) / n).otherwise(0.0)
    return {"markers_per_1k": per(r"\[\d+\]"), "urls_per_1k": per(r"https?://"), "footnote_urls": F.regexp_count(t, F.lit(r"(?m)^\s*\d+\.?\s+https?://")).cast("bigint")}


def whitelist(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, state): every wanted key as found or missing."""
    return wanted.select(key).distinct().join(docs.select(key).distinct().withColumn("__in", F.lit(1)), key, "left").select(key, F.when(F.col("__in").isNull(), "missing").otherwise("found").alias("state"))


def example_issues(examples: DataFrame, id_col: str, doc: Column, instruction: str, answer: str, contexts: Column) -> DataFrame:
    """(id_col, kind): empty fields, instructions repeated within a document or elsewhere, citations out of range.

    Repeats are told by the smallest id of each key, found by aggregation.
    """
    e = examples.select(F.col(id_col).alias("i"), doc.alias("d"), normalise_instruction(F.col(instruction)).alias("k"), F.coalesce(F.col(answer), F.lit("")).alias("a"), F.coalesce(contexts, F.array().cast("array<string>")).alias("c"))
    in_doc = e.where("k <> ''").groupBy("d", "k").agg(F.min("i").alias("first_in_doc"))
    overall = in_doc.groupBy("k").agg(F.min("first_in_doc").alias("first"))
    j = e.join(in_doc, ["d", "k"], "left").join(overall, "k", "left")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("k") == "", "empty_instruction"),
            F.when(~F.col("a").rlike(r"(?U)\S"), "empty_answer"),
            F.when(F.col("i") != F.col("first_in_doc"), "repeated_in_document").when(F.col("i") != F.col("first"), "repeated_elsewhere"),
            F.when(F.size(C.verify(F.col("a"), F.col("c"))["extra"]) > 0, "citation_out_of_range"),
        )
    )
    return j.select(F.col("i").alias(id_col), F.explode(kinds).alias("kind"))


def document_profile(stats: DataFrame, metadata: DataFrame, path: str, meta_path: str, fields: list[str]) -> DataFrame:
    """Document statistics with the fields of the first metadata row of the same path, whatever folder or suffix is written; null where there is none."""
    alias = lambda c: F.lower(path_stem(c))
    one = metadata.where(F.trim(meta_path) != "").groupBy(alias(F.col(meta_path)).alias("__k")).agg(F.min_by(F.struct(*fields), F.concat_ws("\u0001", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))).alias("m"))
    return stats.withColumn("__k", alias(F.col(path))).join(one, "__k", "left").select(*stats.columns, *(F.col(f"m.{f}").alias(f) for f in fields))


def log_coverage(log: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """(key, n_log, n_tasks, side): a log and the tasks made from it, by document; side is log, tasks or both."""
    a = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_log"))
    b = tasks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_tasks"))
    side = F.when(F.col("n_log").isNull(), "tasks").when(F.col("n_tasks").isNull(), "log").otherwise("both")
    return a.join(b, key, "full").select(key, F.coalesce("n_log", F.lit(0)).alias("n_log"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), side.alias("side"))


def against_judges(annotations: DataFrame, judged: DataFrame, key: str, label: str, verdict: str) -> DataFrame:
    """(label, verdict, n): how verdicts fall for each annotated label, over items that have both."""
    j = annotations.select(key, F.col(label).alias("label")).join(judged.select(key, F.col(verdict).alias("verdict")), key)
    return j.where("label is not null and verdict is not null").groupBy("label", "verdict").agg(F.count("*").alias("n"))


def judge_gap(scores: DataFrame, judge: str, condition: str, score: Column, a: str, b: str) -> DataFrame:
    """(condition, mean_a, mean_b, diff, abs_diff): mean score that two judges give under each condition both saw."""
    s = scores.where(F.col(judge).isin(a, b)).select(F.col(judge).alias("j"), F.col(condition).alias("condition"), score.alias("s")).where("s is not null")
    m = s.groupBy("condition").agg(F.avg(F.when(F.col("j") == a, F.col("s"))).alias("x"), F.avg(F.when(F.col("j") == b, F.col("s"))).alias("y")).where("x is not null and y is not null")
    return m.select("condition", F.round("x", 6).alias("mean_a"), F.round("y", 6).alias("mean_b"), F.round(F.col("x") - F.col("y"), 6).alias("diff"), F.round(F.abs(F.col("x") - F.col("y")), 6).alias("abs_diff"))


def coverage_stats(df: DataFrame, answer: Column, contexts: Column) -> DataFrame:
    """One row: examples with contexts, and mean, least and most of the share of their contexts that the answer cites."""
    p = df.select(C.marker_presence(answer, contexts).alias("p")).where("p is not null")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.min("p"), 6).alias("least"), F.round(F.max("p"), 6).alias("most"))


def quality_report(df: DataFrame, kind: Column, instruction: str, answer: str, contexts: Column, minimum: int) -> DataFrame:
    """(task_type, n, share, empty_fields, mean_coverage, below_minimum): one row per type of task."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    rows = df.select(F.coalesce(kind, F.lit("unknown")).alias("task_type"), (blank(instruction).cast("int") + blank(answer).cast("int")).alias("e"), C.marker_presence(F.col(answer), contexts).alias("p"))
    per = rows.groupBy("task_type").agg(F.count("*").alias("n"), F.sum("e").alias("empty_fields"), F.round(F.avg("p"), 6).alias("mean_coverage"))
    return per.select("task_type", "n", F.round(F.col("n") / rows.agg(F.count("*")).scalar(), 6).alias("share"), "empty_fields", "mean_coverage", (F.col("n") < minimum).alias("below_minimum"))


def evaluated(df: DataFrame, id_col: str, question: str, answer: str, contexts: Column) -> DataFrame:
    """Everything measured about one answer in a row: prompt size, citations, precision, recall, coverage, grounding."""
    a, c = F.coalesce(F.col(answer), F.lit("")), F.coalesce(contexts, F.array().cast("array<string>"))
    v = C.verify(a, c)
    mean = F.when(F.size(c) > 0, F.aggregate(v["coverage"], F.lit(0.0), lambda s, x: s + x) / F.size(c))
    return df.select(
        id_col,
        F.length(C.rag_prompt(F.col(question), c)).cast("bigint").alias("prompt_chars"),
        F.size(words(a)).cast("bigint").alias("answer_words"),
        F.size(v["referenced"]).cast("bigint").alias("n_referenced"),
        F.size(v["missing"]).cast("bigint").alias("n_missing"),
        F.size(v["extra"]).cast("bigint").alias("n_extra"),
        F.round(C.precision(a, c), 6).alias("precision"),
        F.round(C.recall(a, c), 6).alias("recall"),
        F.round(mean, 6).alias("mean_coverage"),
        F.round(C.grounded_fraction(a, c), 6).alias("grounded"),
    )


def metrics_summary(rows: DataFrame, metrics: list[str], passed: Column, failed: Column) -> DataFrame:
    """(metric, n, mean, std, n_rows, pass_rate, error_rate): a summary of every metric over all rows."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select("x.*")
    whole = rows.agg(F.count("*").alias("n_rows"), F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"), F.round(F.avg(failed.cast("double")), 6).alias("error_rate"))
    per = long.where("v is not null").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 6).alias("std"))
    return per.select("metric", "n", "mean", "std", *(whole.select(c).scalar().alias(c) for c in ("n_rows", "pass_rate", "error_rate")))


def artifact_coverage(runs: DataFrame, run: str, artifact: Column, expected: list[str]) -> DataFrame:
    """(run, n_found, missing): which expected artifacts a run left."""
    have = runs.groupBy(run).agg(F.collect_set(F.when(artifact.isin(expected), artifact)).alias("h"))  # at most the expected ones
    return have.select(run, F.size("h").cast("bigint").alias("n_found"), F.array_join(F.array_except(F.array(*(F.lit(x) for x in sorted(expected))), F.col("h")), ",").alias("missing"))


def first_per_key(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """(key, rank, id_col): the n smallest ids of each key. Hot keys are cut by hash first, so no task sorts a whole group."""
    k = df.select(F.col(key), F.col(id_col)).where(F.col(key).isNotNull() & F.col(id_col).isNotNull()).distinct()
    part = W.partitionBy(key, F.pmod(F.xxhash64(id_col), F.lit(256))).orderBy(id_col)
    some = k.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n).drop("__r")
    return some.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(id_col))).where(F.col("rank") <= n).select(key, F.col("rank").cast("bigint").alias("rank"), id_col)


def random_chunks(chunks: DataFrame, doc: str, id_col: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` chunks of each document, chosen by hash and restored to their order; no task sorts a whole document."""
    c = chunks.where(F.trim(doc) != "").select(doc, id_col).distinct().withColumn("__h", rank_hash(seed, id_col))
    part = W.partitionBy(doc, F.pmod(F.xxhash64(id_col), F.lit(256))).orderBy("__h", id_col)
    some = c.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= cap)
    kept = some.withColumn("__r", F.row_number().over(W.partitionBy(doc).orderBy("__h", id_col))).where(F.col("__r") <= cap)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy(id_col)).cast("bigint")).select(doc, id_col, "place")


def disagreement_sample(df: DataFrame, key: str, score: Column, width: float, n: int, seed: int = 42) -> DataFrame:
    """n rows (a stated sample size): those whose score is within ``width`` of a half first, each kind by hash."""
    near = F.coalesce(F.abs(score - 0.5) < width, F.lit(False))
    return df.withColumn("near", near).withColumn("__h", rank_hash(seed, key)).orderBy(F.desc("near"), "__h", key).limit(n).drop("__h")


def mean_matrix(means: DataFrame, label: str, value: str, margin: float) -> DataFrame:
    """(label_a, label_b, diff, differs): pairs of labels and whether their means lie more than ``margin`` apart."""
    m = means.select(F.col(label).alias("l"), F.col(value).alias("v"))
    d = F.round(F.col("a.v") - F.col("b.v"), 6)
    return m.alias("a").join(m.alias("b"), F.col("a.l") < F.col("b.l")).select(F.col("a.l").alias("label_a"), F.col("b.l").alias("label_b"), d.alias("diff"), (F.abs(d) > margin).alias("differs"))


def log_status(log: DataFrame, status: Column, items: Column) -> DataFrame:
    """(status, n, n_items): outcomes of a generator's log and how many items each gave."""
    return log.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum(items), F.lit(0)).cast("bigint").alias("n_items"))

"""Roll-ups, searches and reports composed of the other operators (O-109..O-112, O-133, O-152, O-153, O-166, O-167, O-176, O-185, O-187, O-188, O-205, O-209, O-210, O-214, O-222..O-224, O-262..O-272)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import citations as C


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which any of the columns holds the needle, whatever the case."""
    n = F.lit(needle.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), n)
    return df.where(hit)


def unblind(verdicts: DataFrame, mapping: DataFrame, keys: list[str], verdict: str, shown_first: str, model_a: str) -> DataFrame:
    """Verdicts about 'A' and 'B' as shown, turned into win_a and win_b of the models."""
    j = verdicts.join(mapping, keys)
    straight = F.col(shown_first) == F.col(model_a)
    v = F.upper(F.trim(F.col(verdict)))
    return j.withColumn("outcome", F.when(v == "TIE", "tie").when((v == "A") == straight, "win_a").otherwise("win_b"))


def work_grid(examples: DataFrame, conditions: list[str], done: DataFrame, key: str) -> DataFrame:
    """(key, condition) still to be done: every example under every condition, less those in the sink."""
    grid = examples.select(key, F.explode(F.array(*(F.lit(c) for c in conditions))).alias("condition"))
    return grid.join(done.select(key, "condition").distinct(), [key, "condition"], "left_anti")


def top_documents(df: DataFrame, doc: str, kind: str, n: int = 10) -> DataFrame:
    """(doc, kind, n) of the n documents with most rows; ties by name."""
    total = df.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.count("*").alias("total")).orderBy(F.desc("total"), doc).limit(n)
    return df.join(F.broadcast(total.select(doc)), doc).groupBy(doc, F.coalesce(kind, F.lit("unknown")).alias(kind)).agg(F.count("*").alias("n"))


def citation_rollup(df: DataFrame, answer: Column, contexts: Column) -> DataFrame:
    """One row of counters over all examples."""
    v = C.verify(answer, contexts)
    t = df.select(F.size(contexts).alias("n_ctx"), F.size(C.markers(answer)).alias("n_marks"), F.size(v["missing"]).alias("n_missing"), F.size(v["extra"]).alias("n_extra"))
    return t.agg(
        F.count("*").alias("examples"),
        F.count_if(F.col("n_ctx") > 0).alias("with_contexts"),
        F.count_if(F.col("n_marks") > 0).alias("with_markers"),
        F.count_if(F.col("n_missing") > 0).alias("with_missing"),
        F.count_if(F.col("n_extra") > 0).alias("with_extra"),
        F.coalesce(F.sum("n_marks"), F.lit(0)).alias("markers"),
        F.round(F.avg("n_ctx"), 6).alias("mean_contexts"),
    )


def judge_aggregate(df: DataFrame, passed: Column, scores: dict[str, Column]) -> DataFrame:
    """One row: pass rate and mean of each score."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"), *(F.round(F.avg(c), 6).alias(f"mean_{k}") for k, c in scores.items()))


def frequent_issues(df: DataFrame, issues: Column, n: int = 20) -> DataFrame:
    """(issue, n): the most frequent issue texts, lower case, first 100 characters."""
    i = df.select(F.explode(issues).alias("i")).select(F.substring(F.lower(F.trim("i")), 1, 100).alias("issue")).where("issue <> ''")
    return i.groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(n)


def language_summary(docs: DataFrame, group: str, lang: str) -> DataFrame:
    """(group, main_language, n_languages, mixed) by frequency; ties to the first name."""
    per = docs.where(F.col(lang).isNotNull()).groupBy(group, lang).agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(F.min_by(lang, F.struct(-F.col("n"), F.col(lang))).alias("main_language"), F.count("*").alias("n_languages")).withColumn("mixed", F.col("n_languages") > 1)


def error_breakdown(df: DataFrame, label: str, errors: str) -> DataFrame:
    """(label, kind, n): generation, judge, both or other, by the keys of a map of errors."""
    has = lambda k: F.map_contains_key(errors, F.lit(k))
    kind = F.when(has("generation") & has("judge"), "both").when(has("generation"), "generation").when(has("judge"), "judge").otherwise("other")
    return df.where(F.size(errors) > 0).groupBy(label, kind.alias("kind")).agg(F.count("*").alias("n"))


def mode_means(df: DataFrame, mode: str, value: Column) -> DataFrame:
    """(mode, mean, spread): spread is the population deviation."""
    return df.select(mode, value.cast("double").alias("v")).where("v is not null").groupBy(mode).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("spread"))


def balance_buckets(sizes: list[tuple[str, int]], quotas: dict[str, int]) -> dict[str, str]:
    """Whole buckets, largest first, to the split with most room left; for bucket lists of bounded size."""
    left = dict(quotas)
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        s = max(left, key=lambda k: (left[k], k))
        left[s] -= n
        out[name] = s
    return out


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    value = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return min(1.0, max(0.0, value))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t by bisection: P(T <= q) = p for p above a half."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def mean_interval(n: int, mean: float, std: float, confidence: float = 0.95) -> tuple[float, float]:
    """Student interval of a mean; the mean itself for fewer than two values."""
    if n < 2:
        return mean, mean
    h = t_quantile(0.5 + confidence / 2, n - 1) * std / math.sqrt(n)
    return mean - h, mean + h


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_diff, t) of paired values; rows with a null are left out."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d is not null")
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return s.select("n", F.round("m", 6).alias("mean_diff"), F.round(F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(0.0), 6).alias("t"))


def agreement_stats(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """One row: items, those with several ratings, those of them with one label only, and their share."""
    per = ratings.where(F.col(label).isNotNull()).groupBy(item).agg(F.count("*").alias("n"), (F.max(label) == F.min(label)).alias("same"))
    multi = F.col("n") >= 2
    return per.agg(F.count("*").alias("n_items"), F.count_if(multi).alias("n_multi"), F.count_if(multi & F.col("same")).alias("n_unanimous")).withColumn("unanimous_rate", F.round(F.when(F.col("n_multi") > 0, F.col("n_unanimous") / F.col("n_multi")), 6))


def missing_labels(expected: list[str], found: DataFrame, label: str) -> DataFrame:
    want = found.sparkSession.createDataFrame([(x,) for x in expected], f"{label} string")
    return want.join(found.select(label).distinct(), label, "left_anti")


def missing_keys(records: DataFrame, payload: str, required: list[str], key: str) -> DataFrame:
    """(key, missing): required keys that a JSON object lacks."""
    miss = F.array_except(F.array(*(F.lit(x) for x in required)), F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))
    return records.select(key, miss.alias("missing")).where(F.size("missing") > 0)


def links_map(pdf: Column, abstract: Column) -> Column:
    return F.map_filter(F.create_map(F.lit("pdf"), pdf, F.lit("abstract"), abstract), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")


def range_phrase(low: Column, high: Column, noun: str) -> Column:
    text = lambda c: c.cast("string")
    return F.when(low == high, F.concat(text(low), F.lit(f" {noun}"))).when(low <= 0, F.concat(F.lit("up to "), text(high), F.lit(f" {noun}"))).otherwise(F.concat(text(low), F.lit(" to "), text(high), F.lit(f" {noun}")))


def judge_contexts(contexts: Column, limit: int = 1500) -> Column:
    return F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)))


def windows_of(text: Column, k: int, width: int) -> Column:
    """k evenly spaced pieces of a text, or the whole where it is short."""
    step = F.floor((F.length(text) - width) / max(1, k - 1)).cast("int")
    return F.when(F.length(text) <= width, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(text, i * step + 1, width)))


def name_list(authors: Column) -> Column:
    """Sorted distinct names of an array, blanks out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != "")))


def task_records(items: DataFrame, doc: str, kind: str, instruction: str, order: str, cap: int | None) -> DataFrame:
    """Accepted items numbered per document and kind, at most ``cap`` each if there is one, with ids '<slug>-<kind>-<nn>'."""
    from foliospark.functions.text import slug

    w = W.partitionBy(doc, kind).orderBy(order)
    ok = items.where(F.coalesce(F.trim(instruction), F.lit("")) != "")
    n = ok.withColumn("nn", F.row_number().over(w))
    n = n if cap is None else n.where(F.col("nn") <= cap)
    return n.withColumn("record_id", F.format_string("%s-%s-%02d", slug(F.col(doc)), F.col(kind), F.col("nn")))


def greedy_match_f1(a: Column, b: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays of unit vectors, each token matched with its nearest on the other side."""
    from foliospark.operators.retrieval import dot

    side = lambda x, y: F.aggregate(F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: dot(u, v)))), F.lit(0.0), lambda s, m: s + m) / F.size(x)
    p = F.when((F.size(a) > 0) & (F.size(b) > 0), side(a, b)).otherwise(0.0)
    r = F.when((F.size(a) > 0) & (F.size(b) > 0), side(b, a)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}

"""Validation, de-duplication, leakage, sampling and splitting of QA data sets (O-120..O-135, O-220, O-227..O-236, O-124)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import citations as C
from foliospark.functions.text import normalise_instruction, words
from foliospark.plans.scale import BUCKET_ROWS, prefix_sum

#: A stratum is sorted in so many slices.
SLICES = 256

# What each kind of generated item must have.
REQUIRED_FIELDS = {"qa": ("question", "answer"), "summaries": ("instruction", "response"), "citations": ("instruction", "answer"), "contextualizations": ("instruction", "response")}


def size_gate(pages: Column, tokens: Column, max_pages: int, max_tokens: int) -> Column:
    return F.when(pages > max_pages, "page_limit").when(tokens > max_tokens, "token_limit")


def confidence_gate(df: DataFrame, score: Column, threshold: float) -> DataFrame:
    """All rows, with skipped and skip_reason."""
    low = score < threshold
    return df.withColumn("skipped", low).withColumn("skip_reason", F.when(low, "low_confidence"))


def missing_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_col, field): blank required fields."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(f).cast("string"), F.lit("")).rlike(r"(?U)\S"), F.lit(f)) for f in fields)))
    return df.select(id_col, F.explode(found).alias("field"))


def field_report(missing: DataFrame, field: str = "field") -> DataFrame:
    return missing.groupBy(field).agg(F.count("*").alias("n"))


def valid_items(items: Column, first: str, second: str) -> Column:
    """Items of an array of maps with both fields filled, trimmed."""
    filled = lambda m, k: F.coalesce(F.trim(F.try_element_at(m, F.lit(k))), F.lit("")) != ""
    return F.filter(items, lambda m: filled(m, first) & filled(m, second))


def payload_rows(df: DataFrame, payload: str, keep: list[str], caps: dict[str, int]) -> DataFrame:
    """(keep, task_type, item_no, instruction, response) of generated JSON payloads; at most ``caps[type]`` valid items each."""
    parsed = F.from_json(payload, "map<string,array<map<string,string>>>")
    out = None
    for kind, (first, second) in REQUIRED_FIELDS.items():
        items = F.slice(valid_items(F.coalesce(F.try_element_at(F.col("__p"), F.lit(kind)), F.array().cast("array<map<string,string>>")), first, second), 1, caps.get(kind, 1000))
        rows = df.withColumn("__p", parsed).select(*keep, F.lit(kind).alias("task_type"), F.posexplode(items).alias("item_no", "m")).select(*keep, "task_type", "item_no", F.trim(F.col("m")[first]).alias("instruction"), F.trim(F.col("m")[second]).alias("response"))
        out = rows if out is None else out.unionByName(rows)
    return out


def strip_json_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def lenient_json(text: Column) -> Column:
    """Text of the JSON object in an answer: fences off, a missing end brace added, else the outermost braces; null if none parses."""
    t = strip_json_fences(text)
    closed = F.concat(t, F.lit("}"))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    ok = lambda x: F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{")
    return F.when(ok(t), t).when(ok(closed), closed).when((inner != "") & ok(inner), inner)


def verdict_of(raw: Column) -> Column:
    """win_a, win_b or tie from a judge's raw answer: its JSON, else a keyword; thoughts are left out."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>", "")
    v = F.lower(F.trim(F.coalesce(F.get_json_object(lenient_json(t), "$.verdict"), F.get_json_object(lenient_json(t), "$.winner"))))
    clean = F.when(v.isin("win_a", "a", "model_a"), "win_a").when(v.isin("win_b", "b", "model_b"), "win_b").when(v.isin("tie", "draw"), "tie")
    low = F.lower(t)
    words_of = F.when(F.contains(low, F.lit("win_a")) | low.rlike(r"\b(response|answer|model) a (is better|wins)"), "win_a").when(F.contains(low, F.lit("win_b")) | low.rlike(r"\b(response|answer|model) b (is better|wins)"), "win_b").when(low.rlike(r"\btie\b"), "tie")
    return F.when(lenient_json(t).isNotNull(), clean).otherwise(words_of)


def first_rows(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in order, whole; rows whose key is blank are dropped. Aggregates map-side instead of sorting groups."""
    cols = df.columns
    return df.withColumn("__k", key).where("__k is not null and __k <> ''").groupBy("__k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")


def dedup_instructions(df: DataFrame, instruction: str, order: list[str]) -> DataFrame:
    return first_rows(df, normalise_instruction(F.col(instruction)), order)


def duplicate_report(df: DataFrame, instruction: str, id_col: str) -> DataFrame:
    """(id_col, first_id): rows that repeat the instruction of a smaller id."""
    k = df.select(F.col(id_col).alias("i"), normalise_instruction(F.col(instruction)).alias("k")).where("k <> ''").distinct()
    firsts = k.groupBy("k").agg(F.min("i").alias("f"))
    return k.join(firsts, "k").where("i <> f").select(F.col("i").alias(id_col), F.col("f").alias("first_id"))


def leakage(train: DataFrame, held: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key, n_shared): distinct values of each key found on both sides."""
    out = None
    for name, c in keys.items():
        a = train.select(c.alias("k")).where("k is not null and k <> ''").distinct()
        b = held.select(c.alias("k")).where("k is not null and k <> ''").distinct()
        n = a.join(b, "k", "left_semi").agg(F.count("*").alias("n_shared")).select(F.lit(name).alias("key"), "n_shared")
        out = n if out is None else out.unionByName(n)
    return out


def rank_hash(seed: int, *cols: str) -> Column:
    """Order of a seeded sample: the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest hashes; all of them if there are no more."""
    return df.orderBy(rank_hash(seed, key), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, equally many per stratum as far as they go, the rest by hash over all.

    A row can only enter among the n smallest hashes of its stratum. Those are cut
    within slices of the stratum first, so no task sorts a whole stratum.
    """
    s = F.coalesce(F.col(stratum), F.lit("unknown"))
    strata = df.select(s.alias("s")).distinct().count()
    each = max(1, n // max(1, strata))
    sliced = W.partitionBy(s, F.pmod(F.xxhash64(key), F.lit(SLICES))).orderBy("__h", key)
    some = df.withColumn("__h", rank_hash(seed, key)).withColumn("__r", F.row_number().over(sliced)).where(F.col("__r") <= n)
    ranked = some.withColumn("__r", F.row_number().over(W.partitionBy(s).orderBy("__h", key)))
    return ranked.orderBy((F.col("__r") > each).cast("int"), "__h", key).limit(n).drop("__h", "__r")


def paper_split(df: DataFrame, paper: Column, key: str, ratio: float = 0.2, min_eval: int = 1, seed: int = 42) -> DataFrame:
    """Adds split: per paper a share of examples goes to eval; two or fewer give none, up to four at most one, others leave two for training.

    Ranks within a paper come from the counts of ranges of the hash, so a paper
    (or all rows that name none) may hold any number of rows.
    """
    h = rank_hash(seed, key)
    rows = df.withColumn("__p", paper).withColumn("__h", F.struct(h.alias("h"), F.col(key).alias("k"))).withColumn("__one", F.lit(1))
    rows = rows.withColumn("__u", F.conv(F.substring(F.col("__h.h"), 1, 12), 16, 10).cast("double") / float(1 << 48))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    ranked = prefix_sum(rows.join(sizes, "__p"), ["__p"], "__u", "__one", "__rank", buckets=1 + F.floor(F.col("__n") / BUCKET_ROWS), tie="__h")
    want = F.greatest(F.lit(min_eval), F.bround(F.col("__n") * ratio).cast("int"))
    take = F.when(F.col("__n") <= 2, 0).when(F.col("__n") <= 4, F.least(want, F.lit(1))).otherwise(F.least(want, F.col("__n") - 2))
    return ranked.withColumn("split", F.when(F.col("__rank") < take, "eval").otherwise("train")).select(*df.columns, "split")


def citation_compliance(answer: Column, contexts: Column, minimum: float = 0.1) -> Column:
    """Why an answer's citations fail, or null: none, out_of_range or low_coverage."""
    v = C.verify(answer, contexts)
    covered = F.aggregate(v["coverage"], F.lit(0.0), lambda a, x: F.greatest(a, x))
    return F.when(F.size(v["referenced"]) == 0, "no_citation").when(F.size(v["extra"]) > 0, "out_of_range").when(covered < minimum, "low_coverage")


def quality_reason(task_type: Column, top_score: Column, grounding: Column, answer: Column, contexts: Column) -> Column:
    """The first reason for which an example is removed, or null."""
    return (
        F.when(task_type == "contextualizations", "task_type")
        .when(F.coalesce(top_score, F.lit(0.0)) < 0.3, "retrieval_score")
        .when(grounding < 0.25, "grounding")
        .when(F.length(answer) < 100, "answer_length")
        .when(F.size(C.verify(answer, contexts)["extra"]) > 0, "citation")
    )


def corpus_warnings(stats: DataFrame, doc: str, tokens: str, pages: str, low: int, high: int) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.coalesce(F.col(pages), F.lit(0)) == 0, "missing_pages"), F.when(F.col(tokens) < low, "too_few_tokens"), F.when(F.col(tokens) > high, "too_many_tokens")))
    return stats.select(doc, F.explode(kinds).alias("kind"))


def prompt_issues(prompt: Column, system: Column, needs: list[str]) -> Column:
    """Array of faults of a prompt: system text inside it, markers missing."""
    return F.array_compact(F.array(F.when((F.trim(system) != "") & F.contains(prompt, F.trim(system)), "system_text"), *(F.when(~F.contains(prompt, F.lit(m)), f"missing:{m}") for m in needs)))


def presentation_order(key: Column, seed: int = 42) -> Column:
    """Whether a pair is shown the other way round, by hash."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("bigint"), F.lit(2)) == 1


def unswap(verdict: Column, swapped: Column) -> Column:
    return F.when(swapped & (verdict == "win_a"), "win_b").when(swapped & (verdict == "win_b"), "win_a").otherwise(verdict)


def long_enough(text: Column, n: int) -> Column:
    return F.size(words(text)) >= n

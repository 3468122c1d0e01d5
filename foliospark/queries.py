"""The queries of the core operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import citations as C
from foliospark.functions import plugins, quality, text
from foliospark.operators import catalog, chunking, compare, dataset, evaluation, pairwise, reports, retrieval, scoring
from foliospark.plans.scale import cut, shared_folder
from foliospark.sources import writers
from foliospark.sources.tables import table
from foliospark.streaming import incremental as inc

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Pieces of SQL: words between any white space, normal forms.
_SPACE = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _w(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{_SPACE}'), lambda t: t <> '')"


def _norm(x: str) -> str:
    return f"regexp_replace(lower(trim(coalesce({x}, ''))), '{_SPACE}', ' ', 'g')"


_ONE_EXAMPLE = "(SELECT DISTINCT ON (task_id) * FROM offline_examples ORDER BY task_id)"
_GAMES = """(SELECT match_id, min(task_id) AS task_id, min(a) AS model_a, min(b) AS model_b, min(o) AS outcome, min(judged_at) AS ord FROM (
  SELECT match_id, task_id, judged_at, replace(lower(trim(model_a)), '_', '-') AS a, replace(lower(trim(model_b)), '_', '-') AS b,
    CASE lower(trim(winner)) WHEN 'a' THEN 'win_a' WHEN 'b' THEN 'win_b' WHEN 'tie' THEN 'tie' END AS o FROM match_results)
  WHERE o IS NOT NULL AND a <> b GROUP BY match_id)"""
_VERDICT = "CASE regexp_replace(lower(trim(verdict)), '[^a-z]+', '_', 'g') WHEN 'win_a' THEN 'win_a' WHEN 'win_b' THEN 'win_b' WHEN 'tie' THEN 'tie' END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples, one row per task_id: rows delivered again are whole copies but for their arrival."""
    t = table(spark, d, "offline_examples")
    return t.where("task_id is not null").dropDuplicates(["task_id"])


def games(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.comparisons(table(spark, d, "match_results"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    v = F.regexp_replace(F.lower(F.trim("verdict")), "[^a-z]+", "_")
    clean = F.when(v.isin("win_a", "win_b", "tie"), v)
    rows = table(spark, d, "judgments").select("pair_id", "judge_name", clean.alias("verdict"), "confidence", "latency_seconds", "judged_at", "model_a", "scores_a")
    return rows.where("verdict is not null")


# --- chunks ----------------------------------------------------------------

_CHUNKS = f"""SELECT doc_id, s.i::BIGINT AS chunk_index, array_to_string(list_slice(w, s.i * 68 + 1, s.i * 68 + 80), ' ') AS t
FROM (SELECT doc_id, {_w('text')} AS w FROM documents) d, LATERAL (SELECT unnest(range(0, greatest(1, ceil((len(w) - 12) / 68.0)::BIGINT))) AS i) s WHERE len(w) > 0"""


def _doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunking.chunk_documents(docs, "doc_id", "text", 80, 12)


@query(f"SELECT doc_id, chunk_index, md5(t) AS h FROM ({_CHUNKS})")
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return _doc_chunks(spark, d).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("chunk_text").alias("h"))


@query(f"""WITH c AS ({_CHUNKS}), k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id), u AS (SELECT md5(t) AS h, count(*) AS n FROM c GROUP BY 1), e AS (SELECT doc_id, count(*) AS r FROM c JOIN u ON u.h = md5(c.t) WHERE u.n > 1 GROUP BY doc_id)
SELECT coalesce(source, 'unknown') AS source, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_chunks, coalesce(sum(r), 0)::BIGINT AS n_repeated FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id) GROUP BY 1""")
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    c = cut(_doc_chunks(spark, d).select("doc_id", F.xxhash64("chunk_text").alias("h")))  # used three times
    per_hash = c.groupBy("h").agg(F.count("*").alias("n"))
    repeated = c.join(per_hash.where("n > 1"), "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("r"))
    k = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"))
    return docs.join(k, "doc_id", "left").join(repeated, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_repeated"))


@query(f"""WITH c AS ({_CHUNKS}), n AS (SELECT doc_id, chunk_index, len({_w('t')}) AS k FROM c), s AS (SELECT *, CASE WHEN lag(k) OVER o IS NULL THEN 0 ELSE least(12, lag(k) OVER o) END AS sh FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)), o AS (SELECT *, greatest(1, k - sh) AS own FROM s)
SELECT doc_id, chunk_index, coalesce(sum(own) OVER w, 0)::BIGINT AS token_start, (coalesce(sum(own) OVER w, 0) + k)::BIGINT AS token_end FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    c = _doc_chunks(spark, d).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), text.word_count(F.col("chunk_text")).alias("k"), F.lit(1).alias("section"))
    return chunking.chunk_spans(c, "doc_id", "section", "chunk_index", "k", 12).select("doc_id", "chunk_index", "token_start", "token_end")


@query("SELECT source_path, chunk_index::BIGINT AS chunk_index, chunk_id, row_number() OVER (ORDER BY source_path, chunk_index, chunk_id) - 1 AS chunk_no FROM (SELECT DISTINCT source_path, chunk_index, chunk_id FROM chunks WHERE trim(source_path) <> '')")
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("trim(source_path) <> ''").select("source_path", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_id").distinct().withColumn("__o", F.struct("chunk_index", "chunk_id"))
    return chunking.global_ids(c, "source_path", "__o").select("source_path", "chunk_index", "chunk_id", F.col("chunk_no").cast("bigint").alias("chunk_no"))


@query(f"""SELECT source_path, count(*) AS n, list_sort(list(chunk_index))[1]::BIGINT AS first_index FROM (SELECT DISTINCT source_path, chunk_index, {_norm('text')} AS t FROM chunks WHERE trim(source_path) <> '') WHERE len({_w('t')}) >= 8 GROUP BY source_path, md5(t) HAVING count(*) > 1""")
def dup_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.duplicate_chunks(table(spark, d, "chunks"), 8).select("source_path", "n", F.col("chunk_indices")[0].cast("bigint").alias("first_index"))


@query("""WITH r AS (SELECT DISTINCT source_path, chunk_index, chunk_id, token_start AS a, token_end AS b FROM chunks WHERE trim(source_path) <> ''), p AS (
  SELECT *, last_value(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY chunk_index NULLS FIRST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT source_path, chunk_index::BIGINT AS chunk_index, chunk_id, kind FROM (SELECT *, unnest(CASE WHEN a IS NULL OR b IS NULL THEN ['missing_span'] ELSE list_filter([CASE WHEN a < 0 OR b < 0 THEN 'negative_span' END, CASE WHEN b <= a THEN 'non_positive_length' END, CASE WHEN a < before THEN 'non_monotonic_start' END], lambda x: x IS NOT NULL) END) AS kind FROM p)""")
def span_issues(spark: SparkSession, d: str) -> DataFrame:
    return chunking.span_issues(table(spark, d, "chunks")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("""WITH r AS (SELECT DISTINCT ON (chunk_id) source_path, chunk_id, nullif(trim(section_title), '') AS t, text FROM chunks WHERE trim(source_path) <> '' ORDER BY chunk_id), p AS (
  SELECT *, row_number() OVER w AS rn, last_value(t IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WINDOW w AS (PARTITION BY source_path ORDER BY chunk_id)), s AS (
  SELECT *, sum((rn = 1 OR (t IS NOT NULL AND (before IS NULL OR t <> before)))::INT) OVER (PARTITION BY source_path ORDER BY chunk_id) AS section FROM p)
SELECT source_path, section::BIGINT AS section, max(t) AS section_title, min(chunk_id) AS start_page, max(chunk_id) AS end_page, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id) FILTER (WHERE trim(text) <> '')) AS h
FROM s GROUP BY source_path, section HAVING count(*) FILTER (WHERE trim(text) <> '') > 0""")
def section_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("trim(source_path) <> ''").dropDuplicates(["chunk_id"])
    return chunking.section_groups(c, "source_path", "chunk_id", "section_title", "text").select("source_path", "section", "section_title", "start_page", "end_page", F.md5("text").alias("h"))


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"), 80, 12)).alias("chunk_index", "chunk_text"))


# --- quality ---------------------------------------------------------------

_CHARS = "length(text)"
_Q = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT doc_id, text, length(text) AS c, len({_w('text')}) AS w, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '({_SPACE})?')) AS l FROM t), r AS (
  SELECT doc_id, c, w, len(l) AS n, CASE WHEN len(l) > 0 THEN list_sum(list_transform(l, lambda x: length(x))) / len(l) ELSE 0.0 END AS line, (trim(text) <> '')::INT AS ok, contains(text, chr(10) || chr(10)) AS par, regexp_matches(text, '[.!?]\\s+[A-Z]') AS sen,
  CASE WHEN c > 0 THEN (c - length(regexp_replace(text, '\\p{{L}}', '', 'g'))) / c ELSE 0.0 END AS alpha, CASE WHEN c > 0 THEN (c - length(regexp_replace(text, '\\p{{Nd}}', '', 'g'))) / c ELSE 0.0 END AS digit,
  CASE WHEN c > 0 THEN (c - length(regexp_replace(text, '{_SPACE}', '', 'g'))) / c ELSE 0.0 END AS space FROM b)
SELECT doc_id, c::BIGINT AS char_count, w::BIGINT AS word_count, n::BIGINT AS line_count, par AS has_paragraphs, sen AS has_sentences, round(line, 6) AS avg_line_length, round(alpha, 6) AS alphabetic_ratio, round(digit, 6) AS digit_ratio, round(space, 6) AS whitespace_ratio,
  round(greatest(0.0, least(1.0, 0.3 * ok + 0.2 * (least(c / 1000, 1.0) + least(w / 100, 1.0)) / 2 + 0.2 * (par::INT + sen::INT) / 2 + 0.2 * ((CASE WHEN alpha BETWEEN 0.6 AND 0.9 THEN 1.0 ELSE alpha END) + (CASE WHEN space BETWEEN 0.1 AND 0.3 THEN 1.0 ELSE greatest(0.0, 1 - abs(space - 0.2) / 0.2) END)) / 2 + 0.1 * (CASE WHEN line BETWEEN 30 AND 100 THEN 1.0 ELSE greatest(0.0, 1 - abs(line - 65) / 65) END))), 5) AS confidence FROM r"""


@query(_Q)
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", quality.quality_struct(F.col("text")).alias("q"))
    keep = ("char_count", "word_count", "line_count", "has_paragraphs", "has_sentences", "avg_line_length", "alphabetic_ratio", "digit_ratio", "whitespace_ratio")
    return rows.select("doc_id", *(F.round(f"q.{k}", 6).alias(k) if "ratio" in k or "avg" in k else F.col(f"q.{k}").alias(k) for k in keep), F.round("q.confidence", 5).alias("confidence"))


@query()
def text_features(spark: SparkSession, d: str) -> DataFrame:
    q = quality.feature_columns(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(v.alias(k) for k, v in q.items()))


@query()
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", quality.section_title(F.col("text")).alias("guess")).dropDuplicates(["chunk_id"])


@query("SELECT error, CASE WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN regexp_matches(lower(error), 'connection|network|http|socket|refused|unreachable') THEN 'network' WHEN regexp_matches(lower(error), 'json|parse|decode|syntax|invalid format|malformed') THEN 'parsing' WHEN regexp_matches(lower(error), 'model|api|rate limit|quota|unauthorized|forbidden|401|403|429') THEN 'model' WHEN regexp_matches(lower(error), 'validation|invalid|missing|required|valueerror') THEN 'validation' ELSE 'unknown' END AS class, count(*) AS n FROM judgments WHERE error IS NOT NULL GROUP BY 1, 2")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments").where("error is not null").groupBy("error", quality.error_class(F.col("error")).alias("class")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT source_path, max(page) AS p, coalesce(nullif(max(token_end), 0), sum(len(" + _w("text") + "))) AS t FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id) WHERE trim(source_path) <> '' GROUP BY 1) SELECT source_path, p::BIGINT AS page_count, t::BIGINT AS token_count, CASE WHEN p > 12 THEN 'page_limit' WHEN t > 4000 THEN 'token_limit' END AS gate FROM s")
def size_gate(spark: SparkSession, d: str) -> DataFrame:
    s = catalog.document_stats(table(spark, d, "chunks"))
    return s.select("source_path", F.col("page_count").cast("bigint").alias("page_count"), "token_count", dataset.size_gate(F.col("page_count"), F.col("token_count"), 12, 4000).alias("gate"))


# --- catalogue -------------------------------------------------------------

_MANIFEST = "(SELECT source_path AS text_path, count(DISTINCT page) AS page_count, sum(strlen(text))::BIGINT AS bytes, regexp_replace(source_path, '\\.[^./]*$', '') AS document_id FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id) WHERE trim(source_path) <> '' GROUP BY source_path)"


@query(f"SELECT * FROM {_MANIFEST}")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.manifest(table(spark, d, "chunks"))


@query(f"""WITH p AS (SELECT DISTINCT ON (source_path) * FROM papers WHERE trim(source_path) <> '' ORDER BY source_path, coalesce(arxiv_id, ''), published NULLS FIRST, coalesce(title, ''))
SELECT text_path, page_count, bytes, coalesce(nullif(trim(canonical_id), ''), nullif(split_part(trim(arxiv_id), 'v', 1), '')) AS canonical, array_to_string(coalesce(authors, []), '; ') AS authors_joined, array_to_string(coalesce(categories, []), '; ') AS categories_joined FROM {_MANIFEST} m JOIN p ON p.source_path = m.text_path""")
def catalog_join(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog(table(spark, d, "papers"), catalog.manifest(table(spark, d, "chunks")))


@query(f"SELECT text_path FROM {_MANIFEST} m WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.source_path = m.text_path)")
def catalog_missing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog_missing(table(spark, d, "papers"), catalog.manifest(table(spark, d, "chunks")))


@query("""WITH c AS (SELECT *, coalesce(nullif(trim(canonical_id), ''), nullif(split_part(trim(arxiv_id), 'v', 1), '')) AS cid FROM papers WHERE published >= TIMESTAMP '2025-03-01' AND published < TIMESTAMP '2025-10-01'), l AS (
  SELECT DISTINCT ON (cid) * FROM c WHERE cid <> '' ORDER BY cid, coalesce(updated, published) DESC, coalesce(arxiv_id, '') DESC)
SELECT cid, published FROM l ORDER BY published DESC, cid LIMIT 50""")
def harvest_newest(spark: SparkSession, d: str) -> DataFrame:
    return catalog.harvest(table(spark, d, "papers"), "2025-03-01 00:00:00", "2025-10-01 00:00:00", 50).select("cid", "published")


@query("""WITH s AS (SELECT source_path, max(page) AS page_count, coalesce(nullif(max(token_end), 0), sum(len(""" + _w("text") + """))) AS token_count FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id) WHERE trim(source_path) <> '' GROUP BY 1)
SELECT count(*) AS n_documents, min(token_count)::BIGINT AS min_token_count, round(median(token_count), 6) AS median_token_count, max(token_count)::BIGINT AS max_token_count, min(page_count)::BIGINT AS min_page_count, round(median(page_count), 6) AS median_page_count, max(page_count)::BIGINT AS max_page_count FROM s""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.corpus_summary(catalog.document_stats(table(spark, d, "chunks")).withColumn("page_count", F.col("page_count").cast("bigint")))


# --- citations and prompts ---------------------------------------------------

_CTX = f"(SELECT task_id, coalesce(expected_response, '') AS a, coalesce(rag.contexts, []) AS c, coalesce(instruction, '') AS q FROM {_ONE_EXAMPLE})"
_REF = "list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT)))"


def _with_contexts(spark: SparkSession, d: str) -> DataFrame:
    return examples(spark, d).select("task_id", F.coalesce("expected_response", F.lit("")).alias("a"), F.coalesce("rag.contexts", F.array().cast("array<string>")).alias("c"), F.coalesce("instruction", F.lit("")).alias("q"))


@query(f"""WITH e AS (SELECT task_id, {_REF} AS r, range(1, len(c) + 1) AS v FROM {_CTX}) SELECT task_id, len(list_intersect(r, v))::BIGINT AS n_referenced, len(list_filter(v, lambda x: NOT list_contains(r, x)))::BIGINT AS n_missing, len(list_filter(r, lambda x: NOT list_contains(v, x)))::BIGINT AS n_extra,
  round(CASE WHEN len(r) = 0 THEN CASE WHEN len(v) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(r, v)) / len(r) END, 6) AS precision, round(CASE WHEN len(v) = 0 THEN CASE WHEN len(r) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(r, v)) / len(v) END, 6) AS recall FROM e""")
def citation_verify(spark: SparkSession, d: str) -> DataFrame:
    e = _with_contexts(spark, d)
    v = C.verify(F.col("a"), F.col("c"))
    n = lambda k: F.size(v[k]).cast("bigint").alias(f"n_{k}")
    return e.select("task_id", n("referenced"), n("missing"), n("extra"), F.round(C.precision(F.col("a"), F.col("c")), 6).alias("precision"), F.round(C.recall(F.col("a"), F.col("c")), 6).alias("recall"))


@query(f"""WITH e AS (SELECT task_id, list_filter(regexp_extract_all(lower(a), '[a-z0-9'']+'), lambda w: length(w) >= 3) AS t, list_distinct(flatten(list_transform(c, lambda x: list_filter(regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9'']+'), lambda w: length(w) >= 3)))) AS k, len(c) AS n FROM {_CTX})
SELECT task_id, round(CASE WHEN len(t) > 0 AND n > 0 THEN len(list_filter(t, lambda w: list_contains(k, w))) / len(t) ELSE 0.0 END, 6) AS grounded FROM e""")
def grounded_fraction(spark: SparkSession, d: str) -> DataFrame:
    return _with_contexts(spark, d).select("task_id", F.round(C.grounded_fraction(F.col("a"), F.col("c")), 6).alias("grounded"))


@query(f"""WITH e AS (SELECT task_id, c, {_REF} AS r, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9''\\[\\]]+'), lambda w: length(w) >= 4)) AS v, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(a, '\\[\\d+\\]', ' ', 'g')), '[a-z0-9'']+'), lambda w: length(w) >= 4)) AS u FROM {_CTX})
SELECT task_id, round(coalesce(list_sum(list_transform(c, lambda x: CASE WHEN len(v) > 0 THEN len(list_intersect(v, regexp_extract_all(lower(x), '[a-z0-9''\\[\\]]+'))) / len(v) ELSE 0.0 END)), 0), 6) AS by_answer, round(coalesce(list_sum(list_transform(list_transform(c, lambda x: list_filter(regexp_extract_all(lower(regexp_replace(x, '\\[\\d+\\]', ' ', 'g')), '[a-z0-9'']+'), lambda w: length(w) >= 4)), lambda t: CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda w: list_contains(u, w))) / len(t) ELSE 0.0 END)), 0), 6) AS by_context, CASE WHEN len(c) > 0 THEN len(list_intersect(r, range(1, len(c) + 1))) / len(c) END AS presence FROM e""")
def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = _with_contexts(spark, d)
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)
    return e.select("task_id", total(C.verify(F.col("a"), F.col("c"))["coverage"]).alias("by_answer"), total(C.evaluate(F.col("a"), F.col("c"))["coverage"]).alias("by_context"), C.marker_presence(F.col("a"), F.col("c")).alias("presence"))


@query(f"""SELECT task_id, md5('Answer the question using the provided context. Cite the sources inline as [#] based on the order of the snippets. If the answer is not in the context, say you don''t know.' || chr(10) || chr(10) || 'Context:' || chr(10) || CASE WHEN len(c) > 0 THEN array_to_string(CASE WHEN len(list_filter(c, lambda x: NOT regexp_matches(x, '^\\s*\\[\\d+\\]'))) = 0 THEN list_transform(c, lambda x: trim(x)) ELSE list_transform(c, lambda x, i: '[' || i || '] ' || trim(x)) END, chr(10) || chr(10)) ELSE '(No contexts provided)' END || chr(10) || chr(10) || 'Question: ' || trim(q) || chr(10) || 'Answer:') AS h, length(trim(q))::BIGINT AS q_chars FROM {_CTX} WHERE trim(q) <> ''""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    e = _with_contexts(spark, d).where("trim(q) <> ''")
    return e.select("task_id", F.md5(C.rag_prompt(F.col("q"), F.col("c"))).alias("h"), F.length(F.trim("q")).cast("bigint").alias("q_chars"))


@query(f"""WITH x AS (SELECT task_id, s.i AS i, c[s.i] AS t FROM {_CTX}, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i) s), r AS (SELECT task_id, i, sum(length(t) + 2) OVER (PARTITION BY task_id ORDER BY i) AS used FROM x) SELECT task_id, count(*) AS n, max(used)::BIGINT AS used FROM r WHERE used <= 1500 GROUP BY task_id""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    x = _with_contexts(spark, d).select("task_id", F.posexplode("c").alias("i", "t"))
    return retrieval.pack_contexts(x, "task_id", "i", "t", 1500).groupBy("task_id").agg(F.count("*").alias("n"), F.max("used").cast("bigint").alias("used"))


@query(f"""WITH RECURSIVE x AS (SELECT task_id, list_transform(c, lambda t: floor(len({_w('t')}) * 1.3)::INT) AS k, list_transform(c, lambda t: len({_w('t')})) AS w FROM {_CTX}), r AS (SELECT task_id, k, w, 0 AS i, 0 AS used, 0 AS n, false AS stop FROM x UNION ALL SELECT task_id, k, w, i + 1, CASE WHEN NOT stop AND used + k[i + 1] <= 200 THEN used + k[i + 1] WHEN NOT stop AND n = 0 THEN floor(least(w[i + 1], 153) * 1.3)::INT ELSE used END, n + (NOT stop AND (used + k[i + 1] <= 200 OR n = 0))::INT, stop OR NOT (used + k[i + 1] <= 200 OR n = 0) FROM r WHERE i < len(k)) SELECT task_id, n FROM r WHERE i = len(k)""")
def context_token_pack(spark: SparkSession, d: str) -> DataFrame:
    return _with_contexts(spark, d).select("task_id", F.size(retrieval.pack_tokens(F.col("c"), 200)).alias("n"))


@query(f"SELECT task_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a || b)) ELSE 0.0 END, 6) AS jaccard FROM (SELECT task_id, list_transform(coalesce(rag.contexts, []), lambda x: lower(trim(x))[1:200]) AS a, list_transform(coalesce(rag.retrieved, []), lambda x: lower(trim(x.text))[1:200]) AS b FROM {_ONE_EXAMPLE})")
def context_jaccard(spark: SparkSession, d: str) -> DataFrame:
    e = examples(spark, d).select("task_id", F.coalesce("rag.contexts", F.array().cast("array<string>")).alias("a"), F.coalesce(F.col("rag.retrieved.text"), F.array().cast("array<string>")).alias("b"))
    return e.select("task_id", F.round(C.context_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"""SELECT task_id, CASE WHEN len(c) = 0 THEN 'No context was given.' ELSE trim(CASE WHEN len(list_filter(c, lambda x: NOT regexp_matches(x, '^\\s*\\[\\d+\\]'))) = 0 THEN substr(trim(string_split(trim(c[1]), chr(10))[1]), 4) ELSE string_split(trim(c[1]), chr(10))[1] END) || ' [1]' END AS answer FROM {_CTX} WHERE trim(q) <> ''""")
def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    e = _with_contexts(spark, d).where("trim(q) <> ''").select("task_id", C.rag_prompt(F.col("q"), F.col("c")).alias("prompt"))
    return plugins.generate(e, "prompt").select("task_id", "answer")


# --- retrieval -----------------------------------------------------------------


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, "query_id", "vec_id", "embedding", k)


_TOPK = "(SELECT q AS query_id, rank, v AS vec_id, s AS score FROM (SELECT a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= {k})"


@query("SELECT query_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM " + _TOPK.format(k=10))
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 10).withColumn("rank", F.col("rank").cast("bigint"))


def _labelled_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    h = _hits(spark, d, k)
    return h.join(e.select("vec_id", F.col("label").alias("found_label")), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")


_HITS = "(SELECT h.query_id, max((r.label = q.label AND rank <= 1)::INT) AS h1, max((r.label = q.label AND rank <= 3)::INT) AS h3, max((r.label = q.label AND rank <= 5)::INT) AS h5, coalesce(1.0 / min(CASE WHEN r.label = q.label THEN rank END), 0.0) AS rr FROM " + _TOPK.format(k=10) + " h JOIN embeddings r USING (vec_id) JOIN embeddings q ON q.vec_id = h.query_id GROUP BY h.query_id)"


@query(f"SELECT query_id, h1::BIGINT AS hit_at_1, h3::BIGINT AS hit_at_3, h5::BIGINT AS hit_at_5, round(rr, 6) AS reciprocal_rank FROM {_HITS}")
def hit_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.hit_metrics(_labelled_hits(spark, d, 10), "query_id", F.col("label") == F.col("found_label"))
    return m.select("query_id", *(F.col(f"hit_at_{k}").cast("bigint").alias(f"hit_at_{k}") for k in (1, 3, 5)), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"SELECT count(*) AS evaluated, round(avg(h1), 6) AS hit_at_1, round(avg(h3), 6) AS hit_at_3, round(avg(h5), 6) AS hit_at_5, round(avg(rr), 6) AS mrr FROM {_HITS}")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.hit_metrics(_labelled_hits(spark, d, 10), "query_id", F.col("label") == F.col("found_label"))
    return retrieval.retrieval_summary(m, table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")), "query_id")


@query("WITH h AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN score + 0.5 END AS second FROM (SELECT query_id, rank, vec_id, round(score, 6) AS score FROM " + _TOPK.format(k=10) + ")), g AS (SELECT * FROM (VALUES ('narrow', 5, 3), ('wide', 10, 5)) t(condition, wide, narrow)), r AS (SELECT condition, query_id, vec_id, narrow, row_number() OVER (PARTITION BY query_id, condition ORDER BY coalesce(second, score) DESC, rank) AS final_rank FROM h JOIN g ON rank <= wide) SELECT condition, query_id, vec_id, final_rank FROM r WHERE final_rank <= narrow")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    boost = F.when(F.col("vec_id") % 2 == 0, F.col("score") + 0.5)
    g = retrieval.ablation(_hits(spark, d, 10), "query_id", [("narrow", 5, 3), ("wide", 10, 5)], boost)
    return g.select("condition", "query_id", "vec_id", F.col("final_rank").cast("bigint").alias("final_rank"))


@query("WITH c AS (SELECT count(DISTINCT chunk_id) AS n FROM chunks), v AS (SELECT count(DISTINCT vec_id) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS bad FROM embeddings), o AS (SELECT count(*) AS n FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings))) SELECT 'mapping_size_mismatch' AS kind, c.n AS expected, v.n AS found FROM c, v WHERE c.n <> v.n UNION ALL SELECT 'dimension_mismatch', 0, bad FROM v WHERE bad > 0 UNION ALL SELECT 'missing_vectors', 0, n FROM o WHERE n > 0")
def index_issues(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.index_issues(table(spark, d, "chunks"), table(spark, d, "embeddings"), 64, "chunk_id", "vec_id", "embedding")


# --- data sets -------------------------------------------------------------------


@query(f"SELECT min(task_id) AS task_id, md5(k) AS h FROM (SELECT task_id, regexp_replace({_norm('instruction')}, '[?.!]+$', '') AS k FROM offline_examples) WHERE k <> '' GROUP BY k")
def instruction_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "offline_examples").select("task_id", "instruction")
    return dataset.dedup_instructions(t, "instruction", ["task_id"]).select("task_id", F.md5(text.normalise_instruction(F.col("instruction"))).alias("h"))


@query(f"WITH k AS (SELECT DISTINCT task_id, regexp_replace({_norm('instruction')}, '[?.!]+$', '') AS k FROM offline_examples), f AS (SELECT k, min(task_id) AS f FROM k WHERE k <> '' GROUP BY k) SELECT task_id, f AS first_id FROM k JOIN f USING (k) WHERE task_id <> f")
def duplicate_instructions(spark: SparkSession, d: str) -> DataFrame:
    return dataset.duplicate_report(table(spark, d, "offline_examples"), "instruction", "task_id")


@query(f"WITH t AS (SELECT *, {_norm('instruction')} AS i, {_norm('rag.prompt')} AS p FROM offline_examples) SELECT 'instruction' AS key, count(*) AS n_shared FROM (SELECT DISTINCT i FROM t WHERE split = 'train' AND i <> '' INTERSECT SELECT i FROM t WHERE split IN ('validation', 'test')) UNION ALL SELECT 'prompt', count(*) FROM (SELECT DISTINCT p FROM t WHERE split = 'train' AND p <> '' INTERSECT SELECT p FROM t WHERE split IN ('validation', 'test')) UNION ALL SELECT 'task_id', count(*) FROM (SELECT DISTINCT task_id FROM t WHERE split = 'train' INTERSECT SELECT task_id FROM t WHERE split IN ('validation', 'test'))")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "offline_examples")
    return dataset.leakage(t.where("split = 'train'"), t.where("split in ('validation', 'test')"), {"instruction": text.normalise(F.col("instruction")), "prompt": text.normalise(F.col("rag.prompt")), "task_id": F.col("task_id")})


@query("SELECT task_id FROM (SELECT DISTINCT task_id FROM offline_examples) ORDER BY md5('42|' || task_id), task_id LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sample(table(spark, d, "offline_examples").select("task_id").distinct(), "task_id", 50)


@query("WITH t AS (SELECT task_id, min(coalesce(split, 'unknown')) AS s FROM offline_examples GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('42|' || task_id), task_id) AS r FROM t) SELECT task_id, s FROM r ORDER BY (r > greatest(1, 60 // (SELECT count(DISTINCT s) FROM t)))::INT, md5('42|' || task_id), task_id LIMIT 60")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "offline_examples").groupBy("task_id").agg(F.min(F.coalesce("split", F.lit("unknown"))).alias("s"))
    return dataset.stratified_sample(t, "s", "task_id", 60)


_PAPER = "coalesce(nullif(regexp_extract(lower(doc_path), '(\\d{4}\\.\\d{4,9})', 1), ''), 'unknown')"
_PSPLIT = f"(SELECT task_id, task_type, CASE WHEN r <= CASE WHEN n <= 2 THEN 0 WHEN n <= 4 THEN least(greatest(1, round_even(n * 0.2, 0)), 1) ELSE least(greatest(1, round_even(n * 0.2, 0)), n - 2) END THEN 'eval' ELSE 'train' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY p) AS n, row_number() OVER (PARTITION BY p ORDER BY md5('42|' || task_id), task_id) AS r FROM (SELECT task_id, min(task_type) AS task_type, min({_PAPER}) AS p FROM task_records GROUP BY task_id)))"


def _split_tasks(spark: SparkSession, d: str) -> DataFrame:
    p = F.coalesce(F.nullif(F.regexp_extract(F.lower("doc_path"), r"(\d{4}\.\d{4,9})", 1), F.lit("")), F.lit("unknown"))
    t = table(spark, d, "task_records").groupBy("task_id").agg(F.min("task_type").alias("task_type"), F.min(p).alias("paper"))
    return dataset.paper_split(t, F.col("paper"), "task_id")


@query(f"SELECT task_id, split FROM {_PSPLIT}")
def paper_split(spark: SparkSession, d: str) -> DataFrame:
    return _split_tasks(spark, d).select("task_id", "split")


@query(f"SELECT CASE regexp_replace(lower(trim(task_type)), '[^a-z0-9]+', '', 'g') WHEN 'summary' THEN 'summaries' WHEN 'citation' THEN 'citations' ELSE regexp_replace(lower(trim(task_type)), '[^a-z0-9]+', '', 'g') END AS task_type, count(*) FILTER (WHERE split = 'eval') AS n_eval, count(*) FILTER (WHERE split = 'train') AS n_train FROM {_PSPLIT} GROUP BY 1")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _split_tasks(spark, d).withColumn("task_type", text.task_type(F.col("task_type")))
    return t.groupBy("task_type").agg(F.count_if(F.col("split") == "eval").alias("n_eval"), F.count_if(F.col("split") == "train").alias("n_train"))


@query(f"""WITH e AS (SELECT task_id, regexp_replace(lower(trim(task_type)), '[^a-z0-9]+', '', 'g') AS t, list_max(coalesce(rag.scores, [])) AS s, coalesce(expected_response, '') AS a, len(coalesce(rag.contexts, [])) AS n, list_filter(regexp_extract_all(lower(coalesce(expected_response, '')), '[a-z0-9'']+'), lambda w: length(w) >= 3) AS aw, flatten(list_transform(coalesce(rag.contexts, []), lambda x: regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9'']+'))) AS cw FROM {_ONE_EXAMPLE}), e2 AS (SELECT *, CASE WHEN len(aw) > 0 AND n > 0 THEN len(list_filter(aw, lambda w: list_contains(cw, w))) / len(aw) ELSE 0.0 END AS g FROM e), r AS (SELECT CASE WHEN t = 'contextualizations' THEN 'task_type' WHEN coalesce(s, 0) < 0.3 THEN 'retrieval_score' WHEN g < 0.25 THEN 'grounding' WHEN length(a) < 100 THEN 'answer_length' WHEN len(list_filter({_REF}, lambda x: x < 1 OR x > n)) > 0 THEN 'citation' ELSE 'kept' END AS reason FROM e2) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = examples(spark, d)
    reason = dataset.quality_reason(text.task_type(F.col("task_type")), F.array_max("rag.scores"), C.grounded_fraction(F.col("expected_response"), F.coalesce("rag.contexts", F.array().cast("array<string>"))), F.coalesce("expected_response", F.lit("")), F.coalesce("rag.contexts", F.array().cast("array<string>")))
    return e.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT unnest(list_filter([CASE WHEN len(" + _w("instruction") + ") = 0 THEN 'instruction' END, CASE WHEN len(" + _w("expected_response") + ") = 0 THEN 'expected_response' END, CASE WHEN len(" + _w("split") + ") = 0 THEN 'split' END], lambda x: x IS NOT NULL)) AS field, count(*) AS n FROM " + _ONE_EXAMPLE + " GROUP BY 1")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return dataset.field_report(dataset.missing_fields(examples(spark, d), "task_id", ["instruction", "expected_response", "split"]))


@query("WITH c AS (SELECT coalesce(task_type, 'unknown') AS task_type, count(*) AS n FROM task_records GROUP BY 1) SELECT task_type, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return scoring.distribution(table(spark, d, "task_records"), F.col("task_type"), "task_type")


@query("WITH c AS (SELECT task_type AS value, count(*) AS n FROM task_records WHERE task_type IS NOT NULL GROUP BY 1), w AS (SELECT unnest(['qa', 'summaries', 'contextual']) AS value) SELECT value, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 100 THEN 'below_minimum' END AS kind FROM w LEFT JOIN c USING (value) WHERE n IS NULL OR n < 100 UNION ALL SELECT value, n, 'unexpected' FROM c WHERE value NOT IN (SELECT value FROM w)")
def distribution_issues(spark: SparkSession, d: str) -> DataFrame:
    return scoring.distribution_issues(table(spark, d, "task_records"), "task_type", ["qa", "summaries", "contextual"], 100)


@query(f"SELECT coalesce(split, 'unknown') AS split, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, min(v) AS least, round(quantile_cont(v, 0.05), 6) AS p05, round(median(v), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS most FROM (SELECT split, len({_w('expected_response')})::DOUBLE AS v FROM {_ONE_EXAMPLE}) GROUP BY 1")
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.describe(examples(spark, d), "split", text.word_count(F.col("expected_response")))


@query("SELECT match_id, CASE lower(trim(winner)) WHEN 'a' THEN 'win_a' WHEN 'b' THEN 'win_b' WHEN 'tie' THEN 'tie' END AS clean_winner FROM (SELECT DISTINCT match_id, winner FROM match_results)")
def clean_winners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_results").select("match_id", "winner").distinct().select("match_id", pairwise.clean_winner(F.col("winner")).alias("clean_winner"))


@query("""SELECT parsed, count(*) AS n FROM (SELECT CASE WHEN try_cast(j AS JSON) IS NOT NULL AND j <> '' THEN CASE WHEN v IN ('win_a', 'a', 'model_a') THEN 'win_a' WHEN v IN ('win_b', 'b', 'model_b') THEN 'win_b' WHEN v IN ('tie', 'draw') THEN 'tie' END ELSE CASE WHEN contains(lower(t), 'win_a') OR regexp_matches(lower(t), '\\b(response|answer|model) a (is better|wins)') THEN 'win_a' WHEN contains(lower(t), 'win_b') OR regexp_matches(lower(t), '\\b(response|answer|model) b (is better|wins)') THEN 'win_b' WHEN regexp_matches(lower(t), '\\btie\\b') THEN 'tie' END END AS parsed FROM (
  SELECT t, j, lower(trim(coalesce(json_extract_string(try_cast(j AS JSON), '$.verdict'), json_extract_string(try_cast(j AS JSON), '$.winner')))) AS v FROM (SELECT t, CASE WHEN try_cast(x AS JSON) IS NOT NULL AND starts_with(ltrim(x), '{') THEN x WHEN try_cast(x || '}' AS JSON) IS NOT NULL AND starts_with(ltrim(x), '{') THEN x || '}' ELSE regexp_extract(x, '(?s)\\{.*\\}', 0) END AS j FROM (SELECT t, regexp_replace(regexp_replace(trim(t), '^```[A-Za-z]*\\s*', ''), '\\s*```$', '') AS x FROM (SELECT regexp_replace(coalesce(raw_response, ''), '(?s)<think>.*?</think>', '', 'g') AS t FROM judgments))))) GROUP BY 1""")
def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "judgments").select("pair_id", "judge_name", dataset.verdict_of(F.col("raw_response")).alias("parsed"))
    return t.groupBy("parsed").agg(F.count("*").alias("n"))


@query("SELECT (i - 1) // 25 + 1 AS batch, count(*) AS n, md5(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS h FROM (SELECT task_id, min(instruction) AS t, row_number() OVER (ORDER BY task_id) AS i FROM task_records GROUP BY task_id) GROUP BY 1")
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_records").groupBy("task_id").agg(F.min("instruction").alias("t"))
    return writers.prompt_batches(t, "task_id", "t", 25).select("batch", "n", F.md5("body").alias("h"))


# --- scores -------------------------------------------------------------------


@query("WITH p AS (SELECT task_id, max(response_a) AS prediction FROM match_results GROUP BY 1) SELECT CASE WHEN coalesce(trim(instruction), '') = '' THEN 'skipped' WHEN coalesce(trim(prediction), '') = '' THEN 'missing' ELSE 'scored' END AS status, count(*) AS n FROM (SELECT task_id, min(instruction) AS instruction FROM task_records GROUP BY 1) LEFT JOIN p USING (task_id) GROUP BY 1")
def prediction_status(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_records").groupBy("task_id").agg(F.min("instruction").alias("instruction"))
    p = table(spark, d, "match_results").groupBy("task_id").agg(F.max("response_a").alias("p"))
    return scoring.join_predictions(t, p, "task_id", "instruction", "p").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT sides, count(*) AS n, round(sum(coalesce(generation, 0)), 3) AS generation, round(sum(coalesce(retrieval, 0)), 3) AS retrieval FROM (SELECT CASE WHEN a.task_id IS NULL THEN 'right' WHEN b.task_id IS NULL THEN 'left' ELSE 'both' END AS sides, generation, retrieval FROM (SELECT task_id, count(*)::DOUBLE AS generation FROM match_results GROUP BY 1) a FULL JOIN (SELECT task_id, count(*)::DOUBLE AS retrieval FROM judgments GROUP BY 1) b ON a.task_id = b.task_id) GROUP BY 1")
def harness_merge(spark: SparkSession, d: str) -> DataFrame:
    n = lambda t: table(spark, d, t).groupBy("task_id").agg(F.count("*").cast("double").alias("v"))
    m = scoring.merge_metrics(n("match_results"), n("judgments"), "task_id", "v")
    return m.groupBy("sides").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("generation", F.lit(0.0))), 3).alias("generation"), F.round(F.sum(F.coalesce("retrieval", F.lit(0.0))), 3).alias("retrieval"))


@query("""WITH r AS (SELECT match_id, regexp_extract_all(lower(coalesce(response_a, '')), '[a-z0-9]+') AS p, regexp_extract_all(lower(coalesce(response_b, '')), '[a-z0-9]+') AS r FROM (SELECT DISTINCT ON (match_id) * FROM match_results ORDER BY match_id)), g AS (
  SELECT match_id, n, array_to_string(list_slice(p, i, i + n - 1), ' ') AS g, 1 AS a, 0 AS b FROM r, LATERAL (SELECT unnest([1, 2, 3, 4]) AS n) k, LATERAL (SELECT unnest(range(1, greatest(1, len(p) - n + 2))) AS i) s WHERE len(p) >= n
  UNION ALL SELECT match_id, n, array_to_string(list_slice(r, i, i + n - 1), ' '), 0, 1 FROM r, LATERAL (SELECT unnest([1, 2, 3, 4]) AS n) k, LATERAL (SELECT unnest(range(1, greatest(1, len(r) - n + 2))) AS i) s WHERE len(r) >= n),
m AS (SELECT n, sum(least(a, b)) AS m, sum(a) AS t FROM (SELECT match_id, n, g, sum(a) AS a, sum(b) AS b FROM g GROUP BY 1, 2, 3) GROUP BY n), l AS (SELECT sum(len(p)) AS lp, sum(len(r)) AS lr FROM r)
SELECT round((CASE WHEN lp >= lr THEN 1 ELSE exp(1 - lr / lp) END) * (SELECT exp(avg(ln(m / t))) FROM m), 6) AS bleu, lp::BIGINT AS prediction_tokens, lr::BIGINT AS reference_tokens FROM l""")
def bleu4(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_results").dropDuplicates(["match_id"])
    return scoring.bleu4(m, "response_a", "response_b")


@query(f"SELECT CASE WHEN grouping(verdict) = 1 THEN 'overall' ELSE 'group' END AS scope, verdict, count(*) AS n, round(avg(latency_seconds), 6) AS avg_latency_seconds FROM (SELECT {_VERDICT} AS verdict, latency_seconds FROM judgments) WHERE verdict IS NOT NULL GROUP BY GROUPING SETS ((), (verdict))")
def metric_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return scoring.grouped_means(votes(spark, d), "verdict", ["latency_seconds"])


@query("SELECT model_a, k AS metric, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, min(v) AS least, max(v) AS most FROM (SELECT model_a, unnest(map_keys(scores_a)) AS k, unnest(map_values(scores_a)) AS v FROM judgments WHERE " + _VERDICT + " IS NOT NULL) WHERE v IS NOT NULL GROUP BY 1, 2")
def score_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_rollup(votes(spark, d), "model_a", "scores_a")


@query("SELECT 'latency_seconds' AS stage, count(latency_seconds) AS n, round(avg(latency_seconds), 6) AS mean, min(latency_seconds) AS least, max(latency_seconds) AS most, round(sum(latency_seconds), 3) AS total FROM judgments WHERE latency_seconds IS NOT NULL")
def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    return scoring.timing(table(spark, d, "judgments"), ["latency_seconds"])


@query("SELECT least(4, greatest(0, floor(v * 5)))::BIGINT AS bucket, count(*) AS n FROM (SELECT element_at(scores_a, 'grounding')[1] AS v FROM judgments) WHERE v IS NOT NULL GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.histogram(table(spark, d, "judgments"), F.try_element_at("scores_a", F.lit("grounding"))).withColumn("bucket", F.col("bucket").cast("bigint"))


@query(f"""WITH v AS (SELECT DISTINCT pair_id, judge_name, {_VERDICT} AS v, coalesce(confidence, 'low') AS c FROM judgments), w AS (SELECT pair_id, v, sum(CASE c WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS w, count(*) AS n, min(judge_name) AS o FROM v WHERE v IS NOT NULL GROUP BY 1, 2), b AS (
  SELECT *, sum(n) OVER (PARTITION BY pair_id) AS total, row_number() OVER (PARTITION BY pair_id ORDER BY w DESC, o, v) AS r FROM w) SELECT pair_id, v AS verdict, round(n / total, 6) AS agreement, total::BIGINT AS n_votes FROM b WHERE r = 1""")
def weighted_consensus(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).select("pair_id", "judge_name", "verdict", F.coalesce("confidence", F.lit("low")).alias("c")).distinct().withColumn("verdict_name", F.col("verdict"))
    weight = F.when(F.col("c") == "high", 3).when(F.col("c") == "medium", 2).otherwise(1)
    return scoring.weighted_consensus(v, "pair_id", F.col("verdict"), weight, ["judge_name", "verdict_name"])


# --- tournaments ---------------------------------------------------------------


@query(f"SELECT m AS model, count(*) AS games, count(*) FILTER (WHERE o = w) AS wins, count(*) FILTER (WHERE o <> w AND o <> 'tie') AS losses, count(*) FILTER (WHERE o = 'tie') AS ties, round((count(*) FILTER (WHERE o = w) + 0.5 * count(*) FILTER (WHERE o = 'tie')) / count(*), 6) AS win_rate FROM (SELECT model_a AS m, outcome AS o, 'win_a' AS w FROM {_GAMES} UNION ALL SELECT model_b, outcome, 'win_b' FROM {_GAMES}) GROUP BY 1")
def win_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.win_counts(games(spark, d))


@query(f"SELECT m AS model, p AS opponent, count(*) FILTER (WHERE o = w) AS wins, count(*) FILTER (WHERE o <> w AND o <> 'tie') AS losses, count(*) FILTER (WHERE o = 'tie') AS ties FROM (SELECT model_a AS m, model_b AS p, outcome AS o, 'win_a' AS w FROM {_GAMES} UNION ALL SELECT model_b, model_a, outcome, 'win_b' FROM {_GAMES}) GROUP BY 1, 2")
def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.head_to_head(games(spark, d))


@query("WITH r AS (SELECT DISTINCT task_id, unnest([replace(lower(trim(model_a)), '_', '-'), replace(lower(trim(model_b)), '_', '-')]) AS m FROM match_results) SELECT x.m AS model_a, y.m AS model_b, count(*) AS n_tasks FROM r x JOIN r y ON x.task_id = y.task_id AND x.m < y.m GROUP BY 1, 2")
def pairs_common(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "match_results").select("task_id", F.explode(F.array(pairwise.clean_name(F.col("model_a")), pairwise.clean_name(F.col("model_b")))).alias("m"))
    return pairwise.model_pairs(r, "task_id", "m").groupBy("model_a", "model_b").agg(F.count("*").alias("n_tasks"))


@query("WITH s AS (SELECT task_id, model_a AS m, avg(element_at(scores_a, 'grounding')[1]) AS s FROM judgments WHERE task_id IS NOT NULL GROUP BY 1, 2) SELECT CASE WHEN round(x.s - y.s, 9) > 0.1 THEN 'win_a' WHEN round(x.s - y.s, 9) < -0.1 THEN 'win_b' ELSE 'tie' END AS outcome, count(*) AS n FROM s x JOIN s y ON x.task_id = y.task_id AND x.m < y.m GROUP BY 1")
def synthetic_comparisons(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "judgments").where("task_id is not null").select("task_id", "model_a", F.try_element_at("scores_a", F.lit("grounding")).alias("g"))
    return pairwise.synthetic(s, "task_id", "model_a", "g").groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE g AS (SELECT row_number() OVER (ORDER BY ord, match_id) AS i, model_a AS a, model_b AS b, CASE outcome WHEN 'win_a' THEN 1.0 WHEN 'win_b' THEN 0.0 ELSE 0.5 END AS s FROM {_GAMES}), m AS (SELECT list_sort(list_distinct(list(a) || list(b))) AS l FROM g), k AS (SELECT i, list_position(l, a) AS pa, list_position(l, b) AS pb, s FROM g, m), f AS (
  SELECT 0::BIGINT AS i, list_transform(l, lambda x: 1500.0::DOUBLE) AS r FROM m UNION ALL SELECT k.i, list_transform(f.r, lambda x, j: CASE WHEN j = pa THEN x + 32 * (s - 1 / (1 + pow(10, (f.r[pb] - f.r[pa]) / 400))) WHEN j = pb THEN x + 32 * ((1 - s) - (1 - 1 / (1 + pow(10, (f.r[pb] - f.r[pa]) / 400)))) ELSE x END) FROM f JOIN k ON k.i = f.i + 1)
SELECT unnest(l) AS model, round(unnest(r), 6) AS rating FROM f, m WHERE i = (SELECT max(i) FROM f)""")
def elo_ratings(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.elo(games(spark, d)).drop("tournament")


@query()
def elo_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    counts = games(spark, d).groupBy("model_a", "model_b", "outcome").agg(F.count("*").alias("n"))
    return pairwise.bootstrap(counts, rounds=1000)


@query(_SQL["elo_ratings"].replace("SELECT unnest(l) AS model", ", e AS (SELECT unnest(l) AS model").replace("(SELECT max(i) FROM f)", "(SELECT max(i) FROM f))") + f", c AS ({_SQL['win_counts']}) SELECT * FROM e JOIN c USING (model)")
def elo_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    g = games(spark, d)
    return pairwise.leaderboard(pairwise.elo(g).drop("tournament"), pairwise.win_counts(g))


# --- statistics ----------------------------------------------------------------

_WINS = f"(SELECT model_a, model_b, count(*) FILTER (WHERE outcome = 'win_a') AS a, count(*) FILTER (WHERE outcome = 'win_b') AS b FROM (SELECT least(model_a, model_b) AS model_a, greatest(model_a, model_b) AS model_b, CASE WHEN model_a < model_b OR outcome = 'tie' THEN outcome WHEN outcome = 'win_a' THEN 'win_b' ELSE 'win_a' END AS outcome FROM {_GAMES}) GROUP BY 1, 2)"


def _wins(spark: SparkSession, d: str) -> DataFrame:
    g = games(spark, d)
    flipped = F.when((F.col("model_a") < F.col("model_b")) | (F.col("outcome") == "tie"), F.col("outcome")).when(F.col("outcome") == "win_a", "win_b").otherwise("win_a")
    return g.groupBy(F.least("model_a", "model_b").alias("x"), F.greatest("model_a", "model_b").alias("y")).agg(F.count_if(flipped == "win_a").alias("a"), F.count_if(flipped == "win_b").alias("b")).withColumnsRenamed({"x": "model_a", "y": "model_b"})


@query(f"""WITH RECURSIVE t AS (SELECT model_a, model_b, a, b, 0 AS i, 1.0::DOUBLE AS c, 1.0::DOUBLE AS s FROM {_WINS} UNION ALL SELECT model_a, model_b, a, b, i + 1, c * (a + b - i) / (i + 1), s + c * (a + b - i) / (i + 1) FROM t WHERE i < least(a, b))
SELECT model_a, model_b, a, b, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * max(s) / pow(2.0, a + b)) END, 6) AS p, round(CASE WHEN a + b > 0 THEN (a / (a + b) + 1.9208 / (a + b) - 1.96 * sqrt((a / (a + b)) * (b / (a + b)) / (a + b) + 0.9604 / ((a + b) * (a + b)))) / (1 + 3.8416 / (a + b)) ELSE 0.0 END, 6) AS wilson_low, round(CASE WHEN a + b > 0 THEN 2 * asin(sqrt(a / (a + b))) - 2 * asin(sqrt(0.5)) END, 6) AS h FROM t GROUP BY 1, 2, 3, 4""")
def pair_significance(spark: SparkSession, d: str) -> DataFrame:
    w = _wins(spark, d)
    n = F.col("a") + F.col("b")
    low, _ = compare.wilson(F.col("a"), n)
    return w.select("model_a", "model_b", "a", "b", F.round(compare.sign_test_exact(F.col("a"), F.col("b")), 6).alias("p"), F.round(low, 6).alias("wilson_low"), F.round(F.when(n > 0, compare.cohens_h(F.col("a") / n, F.lit(0.5))), 6).alias("h"))


_TYPES = "(SELECT min(event_type) AS x, max(event_type) AS y FROM events)"


def _two_types(spark: SparkSession, d: str) -> tuple[DataFrame, str, str]:
    e = table(spark, d, "events").select("event_type", "value")
    r = e.agg(F.min("event_type").alias("x"), F.max("event_type").alias("y")).first()
    return e, r["x"], r["y"]


@query(f"SELECT round(avg(value) FILTER (WHERE event_type = x), 6) AS mean_a, round(avg(value) FILTER (WHERE event_type = y), 6) AS mean_b, round((avg(value) FILTER (WHERE event_type = x) - avg(value) FILTER (WHERE event_type = y)) / sqrt((var_samp(value) FILTER (WHERE event_type = x) + var_samp(value) FILTER (WHERE event_type = y)) / 2), 6) AS d FROM events, {_TYPES}")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    e, x, y = _two_types(spark, d)
    return compare.cohens_d(e, "event_type", "value", x, y)


@query(f"WITH s AS (SELECT avg(value) FILTER (WHERE event_type = x) AS ma, avg(value) FILTER (WHERE event_type = y) AS mb, var_samp(value) FILTER (WHERE event_type = x) / count(value) FILTER (WHERE event_type = x) AS sa, var_samp(value) FILTER (WHERE event_type = y) / count(value) FILTER (WHERE event_type = y) AS sb, count(value) FILTER (WHERE event_type = x) AS na, count(value) FILTER (WHERE event_type = y) AS nb FROM events, {_TYPES}) SELECT round((ma - mb) / sqrt(sa + sb), 6) AS t, round(pow(sa + sb, 2) / (pow(sa, 2) / (na - 1) + pow(sb, 2) / (nb - 1)), 4) AS df FROM s")
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    e, x, y = _two_types(spark, d)
    return compare.welch_t(e, "event_type", "value", x, y)


@query(f"WITH e AS (SELECT event_type = x AS a, value FROM events, {_TYPES} WHERE event_type IN (x, y) AND value IS NOT NULL), r AS (SELECT a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM e), s AS (SELECT sum(r) FILTER (WHERE a) AS r, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE NOT a) AS n_b FROM r) SELECT round(r - n_a * (n_a + 1) / 2, 1) AS u, n_a, n_b FROM s")
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    e, x, y = _two_types(spark, d)
    return compare.mann_whitney_u(e, "event_type", "value", x, y)


_RATERS = f"(SELECT a.pair_id, a.v AS x, b.v AS y FROM (SELECT pair_id, judge_name, min({_VERDICT}) AS v FROM judgments GROUP BY 1, 2) a JOIN (SELECT pair_id, judge_name, min({_VERDICT}) AS v FROM judgments GROUP BY 1, 2) b ON a.pair_id = b.pair_id AND a.judge_name < b.judge_name WHERE a.v IS NOT NULL AND b.v IS NOT NULL)"


def _raters(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).groupBy("pair_id", "judge_name").agg(F.min("verdict").alias("v"))
    return v.alias("a").join(v.alias("b"), "pair_id").where("a.judge_name < b.judge_name").select("pair_id", F.col("a.v").alias("x"), F.col("b.v").alias("y"))


@query(f"WITH p AS (SELECT * FROM {_RATERS}), m AS (SELECT l, count(*) FILTER (WHERE x = l) AS a, count(*) FILTER (WHERE y = l) AS b FROM p, (SELECT unnest(['win_a', 'win_b', 'tie']) AS l) GROUP BY l), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS s FROM p) SELECT n, round(s / n, 6) AS observed, round((SELECT sum(a * b) FROM m) / (n * n), 6) AS expected, round((s / n - (SELECT sum(a * b) FROM m) / (n * n)) / (1 - (SELECT sum(a * b) FROM m) / (n * n)), 6) AS kappa FROM t")
def judge_kappa(spark: SparkSession, d: str) -> DataFrame:
    return compare.kappa(_raters(spark, d), "x", "y")


@query(f"SELECT x AS label_1, y AS label_2, count(*) AS n FROM {_RATERS} GROUP BY 1, 2")
def judge_confusion(spark: SparkSession, d: str) -> DataFrame:
    return compare.confusion(_raters(spark, d), "x", "y")


@query(f"WITH v AS (SELECT pair_id, judge_name, min({_VERDICT}) AS v FROM judgments GROUP BY 1, 2), c AS (SELECT pair_id, v, count(*) AS c FROM v WHERE v IS NOT NULL GROUP BY 1, 2), i AS (SELECT pair_id, sum(c) AS n, sum(c * (c - 1)) AS s FROM c GROUP BY 1 HAVING sum(c) >= 2), o AS (SELECT count(*) AS n_items, avg(s / (n * (n - 1))) AS po FROM i), e AS (SELECT sum(c * c) / pow(sum(c), 2) AS pe FROM (SELECT v, sum(c) AS c FROM c WHERE pair_id IN (SELECT pair_id FROM i) GROUP BY 1)) SELECT n_items, round((po - pe) / (1 - pe), 6) AS kappa FROM o, e")
def judge_fleiss(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d).groupBy("pair_id", "judge_name").agg(F.min("verdict").alias("v"))
    return compare.fleiss(v, "pair_id", "v")


@query("WITH m AS (SELECT model_a AS c, k AS m, round(avg(v), 6) AS v FROM (SELECT model_a, unnest(map_keys(scores_a)) AS k, unnest(map_values(scores_a)) AS v FROM judgments WHERE " + _VERDICT + " IS NOT NULL) GROUP BY 1, 2) SELECT x.m AS metric, x.c AS condition_a, y.c AS condition_b, round(x.v - y.v, 6) AS diff, CASE WHEN round(x.v - y.v, 6) > 0.01 THEN x.c WHEN round(x.v - y.v, 6) < -0.01 THEN y.c ELSE 'tie' END AS winner FROM m x JOIN m y ON x.m = y.m AND x.c < y.c")
def condition_compare(spark: SparkSession, d: str) -> DataFrame:
    m = scoring.score_rollup(votes(spark, d), "model_a", "scores_a")
    return compare.condition_pairs(m, "model_a", "metric", "mean", 0.01)


@query("WITH k AS (SELECT DISTINCT event_type AS run, user_id AS k FROM events), b AS (SELECT k FROM k WHERE run = (SELECT min(run) FROM k)) SELECT run, (SELECT count(*) FROM b) - count(*) FILTER (WHERE k IN (SELECT k FROM b)) AS missing, count(*) FILTER (WHERE k NOT IN (SELECT k FROM b)) AS extra FROM k WHERE run <> (SELECT min(run) FROM k) GROUP BY run")
def run_mismatch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    base = e.agg(F.min("event_type")).first()[0]
    return compare.run_mismatch(e, "event_type", "user_id", base)


# --- streams ---------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return inc.final_batch(inc.tumbling(inc.file_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "value"), ["window_start", "event_type"])


@query("SELECT time_bucket(INTERVAL 1 hour, ts) - to_hours(k) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return inc.final_batch(inc.sliding(inc.file_stream(spark, f"{d}/events.parquet"), "ts", "event_type"), ["window_start", "event_type"])


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minutes THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return inc.final_batch(inc.sessions(inc.file_stream(spark, f"{d}/events.parquet"), "ts", "user_id"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    e = inc.file_stream(spark, f"{d}/events.parquet").select("ts", "user_id")
    return inc.run_available(inc.first_seen(e, "ts", "user_id")).select("user_id")


# --- relational breadth --------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT n_name, c_mktsegment, grouping(n_name) + grouping(c_mktsegment) AS level, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def orders_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup("n_name", "c_mktsegment").agg((F.grouping("n_name") + F.grouping("c_mktsegment")).cast("bigint").alias("level"), F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- reports -------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'calibration error') OR contains(lower(coalesce(title, '')), 'calibration error')")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.search(table(spark, d, "documents").select("doc_id", "text", "title"), "calibration error", "text", "title").select("doc_id")


@query("SELECT t.task_id, c.condition FROM (SELECT DISTINCT task_id FROM task_records) t, (SELECT unnest(['base', 'rag']) AS condition) c WHERE NOT (c.condition = 'rag' AND t.task_id IN (SELECT task_id FROM match_results WHERE task_id IS NOT NULL))")
def work_grid(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "match_results").select("task_id", F.lit("rag").alias("condition"))
    return reports.work_grid(table(spark, d, "task_records").select("task_id").distinct(), ["base", "rag"], done, "task_id")


@query("WITH t AS (SELECT doc_path FROM task_records WHERE doc_path IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, doc_path LIMIT 10) SELECT doc_path, coalesce(task_type, 'unknown') AS task_type, count(*) AS n FROM task_records JOIN t USING (doc_path) GROUP BY 1, 2")
def top_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_documents(table(spark, d, "task_records").select("doc_path", "task_type"), "doc_path", "task_type")


@query(f"WITH e AS (SELECT {_REF} AS r, len(c) AS n FROM {_CTX}) SELECT count(*) AS examples, count(*) FILTER (WHERE n > 0) AS with_contexts, count(*) FILTER (WHERE len(r) > 0) AS with_markers, count(*) FILTER (WHERE len(list_filter(range(1, n + 1), lambda x: NOT list_contains(r, x))) > 0) AS with_missing, count(*) FILTER (WHERE len(list_filter(r, lambda x: x < 1 OR x > n)) > 0) AS with_extra, sum(len(r))::BIGINT AS markers, round(avg(n), 6) AS mean_contexts FROM e")
def citation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reports.citation_rollup(_with_contexts(spark, d), F.col("a"), F.col("c"))


@query("SELECT count(*) AS n, round(avg((g >= 0.6 AND c >= 0.5)::INT), 6) AS pass_rate, round(avg(g), 6) AS mean_grounding, round(avg(c), 6) AS mean_clarity FROM (SELECT element_at(scores_a, 'grounding')[1] AS g, element_at(scores_a, 'clarity')[1] AS c FROM judgments)")
def judge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    g, c = F.try_element_at("scores_a", F.lit("grounding")), F.try_element_at("scores_a", F.lit("clarity"))
    return reports.judge_aggregate(table(spark, d, "judgments"), (g >= 0.6) & (c >= 0.5), {"grounding": g, "clarity": c})


@query("SELECT lower(trim(reasoning))[1:100] AS issue, count(*) AS n FROM judgments WHERE trim(reasoning) <> '' GROUP BY 1 ORDER BY n DESC, issue LIMIT 20")
def frequent_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.frequent_issues(table(spark, d, "judgments"), F.array_compact(F.array("reasoning")))


@query("WITH p AS (SELECT venue_id, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY n DESC, lang) AS r, count(*) OVER (PARTITION BY venue_id) AS k FROM p) SELECT venue_id, lang AS main_language, k AS n_languages, k > 1 AS mixed FROM r WHERE r = 1")
def language_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.language_summary(table(spark, d, "documents"), "venue_id", "lang")


@query("SELECT setup, round(avg(params_b), 6) AS mean, round(stddev_pop(params_b), 6) AS spread FROM model_cards GROUP BY 1")
def setup_means(spark: SparkSession, d: str) -> DataFrame:
    return reports.mode_means(table(spark, d, "model_cards"), "setup", F.col("params_b"))


@query("SELECT count(x) AS n, round(avg(x), 6) AS mean_diff, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) AS t FROM (SELECT element_at(scores_a, 'grounding')[1] - element_at(scores_b, 'grounding')[1] AS x FROM judgments)")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgments").select(F.try_element_at("scores_a", F.lit("grounding")).alias("a"), F.try_element_at("scores_b", F.lit("grounding")).alias("b"))
    return reports.paired_t(j, "a", "b")


@query(f"WITH p AS (SELECT pair_id, count(*) AS n, min(v) = max(v) AS s FROM (SELECT pair_id, judge_name, min({_VERDICT}) AS v FROM judgments GROUP BY 1, 2) WHERE v IS NOT NULL GROUP BY 1) SELECT count(*) AS n_items, count(*) FILTER (WHERE n >= 2) AS n_multi, count(*) FILTER (WHERE n >= 2 AND s) AS n_unanimous, round(count(*) FILTER (WHERE n >= 2 AND s) / count(*) FILTER (WHERE n >= 2), 6) AS unanimous_rate FROM p")
def agreement_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.agreement_stats(votes(spark, d).groupBy("pair_id", "judge_name").agg(F.min("verdict").alias("v")), "pair_id", "v")


@query("SELECT model_name FROM model_cards WHERE model_name NOT IN (SELECT replace(lower(trim(model_a)), '_', '-') FROM match_results WHERE model_a IS NOT NULL)")
def models_without_first_seat(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "match_results").select(pairwise.clean_name(F.col("model_a")).alias("model_name"))
    return table(spark, d, "model_cards").select("model_name").join(seen.distinct(), "model_name", "left_anti")


@query("SELECT task_id, 'chunks' AS missing FROM (SELECT DISTINCT task_id, metadata FROM offline_examples WHERE task_id IS NOT NULL) WHERE metadata IS NULL OR json_extract(metadata, '$.chunks') IS NULL")
def metadata_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "offline_examples").where("task_id is not null").select("task_id", "metadata").distinct()
    return reports.missing_keys(e, "metadata", ["chunks"], "task_id").select("task_id", F.col("missing")[0].alias("missing"))


@query("WITH a AS (SELECT DISTINCT trim(unnest(authors)) AS author, coalesce(nullif(trim(canonical_id), ''), arxiv_id, title) AS p FROM papers) SELECT author, count(*) AS n FROM a WHERE author <> '' GROUP BY 1")
def author_papers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select(F.explode(reports.name_list(F.coalesce("authors", F.array().cast("array<string>")))).alias("author"), F.coalesce(F.nullif(F.trim("canonical_id"), F.lit("")), "arxiv_id", "title").alias("p"))
    return p.distinct().groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT task_id, slug || '-' || kind || '-' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0') AS record_id FROM (SELECT task_id, regexp_replace(regexp_replace(lower(doc), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, kind, row_number() OVER (PARTITION BY doc, kind ORDER BY task_id) AS n FROM (SELECT task_id, regexp_replace(regexp_extract(doc_path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS doc, CASE k WHEN 'question' THEN 'qa' WHEN 'question_answer' THEN 'qa' WHEN 'qna' THEN 'qa' WHEN 'summary' THEN 'summaries' WHEN 'summarization' THEN 'summaries' WHEN 'citation' THEN 'citations' WHEN 'contextual' THEN 'contextualizations' WHEN 'contextualization' THEN 'contextualizations' ELSE k END AS kind, instruction FROM (SELECT DISTINCT ON (task_id) *, regexp_replace(regexp_replace(lower(trim(task_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM task_records WHERE trim(doc_path) <> '' ORDER BY task_id)) WHERE coalesce(trim(instruction), '') <> '')")
def task_record_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_records").where("trim(doc_path) <> ''").dropDuplicates(["task_id"]).select("task_id", text.path_stem(F.col("doc_path")).alias("doc"), text.task_type(F.col("task_type")).alias("kind"), "instruction")
    return reports.task_records(t, "doc", "kind", "instruction", "task_id", None).select("task_id", "record_id")


# --- questions, judges, evaluation ---------------------------------------------------

_CHUNK = "(SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL AND trim(text) <> '' ORDER BY chunk_id)"
_LETTERS = "list_transform(range(97, 123), lambda i: (length({0}) - length(replace({0}, chr(i::INT), '')))::DOUBLE)"


def letter_embedding(t: Column) -> Column:
    """Stand-in embedder that any engine can compute: how often each letter occurs."""
    low = F.lower(t)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(chr(i)), F.lit("")))).cast("double") for i in range(97, 123)))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    retrieval.build_index(table(spark, d, "chunks"), root, "chunk_id", "text", ["source_path", "page", "section_title"], letter_embedding, "letters")
    return retrieval.load_index(spark, root)


@query(f"SELECT 'letters' AS model, 26::BIGINT AS dimension, count(*) AS n_vectors, count(*) AS n_mapped, count(*) FILTER (WHERE regexp_matches(lower(text), '[a-z]')) AS n_unit FROM {_CHUNK}")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    v, m, meta = _index(spark, d)
    unit = v.where(F.abs(retrieval.dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-9)
    return meta.select("model", F.col("dimension").cast("bigint").alias("dimension"), "n_vectors", m.agg(F.count("*")).scalar().alias("n_mapped"), unit.agg(F.count("*")).scalar().alias("n_unit"))


_ASKED = f"""WITH q AS (SELECT DISTINCT match_id, trim(question) AS q, {_LETTERS.format('lower(trim(question))')} AS e FROM match_results WHERE match_id % 100 = 0 AND trim(question) <> ''), c AS (SELECT *, {_LETTERS.format('lower(text)')} AS e FROM {_CHUNK}),
s AS (SELECT match_id, q, chunk_id, text, source_path, page, section_title, coalesce(round(list_cosine_similarity(q.e, c.e), 9), 0) AS s FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN isnan(s) THEN 0 ELSE s END DESC, chunk_id) AS rank FROM s QUALIFY rank <= 6),
x AS (SELECT *, '[' || rank || '] ' || CASE WHEN h <> '' THEN h || chr(10) ELSE '' END || text AS context, CASE WHEN coalesce(page, 0) <> 0 THEN source_path || '#page=' || page ELSE source_path END AS source FROM (SELECT *, concat_ws(' | ', CASE WHEN coalesce(trim(section_title), '') <> '' THEN 'Section: ' || section_title END, CASE WHEN coalesce(page, 0) <> 0 THEN 'Page ' || page END) AS h FROM r)),
u AS (SELECT *, sum(length(context) + 2) OVER (PARTITION BY match_id ORDER BY rank) AS used FROM x)"""


def _ask(spark: SparkSession, d: str, **more: object) -> DataFrame:
    v, m, _ = _index(spark, d)
    q = table(spark, d, "match_results").where("match_id % 100 = 0").select("match_id", "question").distinct()
    return retrieval.ask(q, v, m, "match_id", "question", "chunk_id", 6, 2500, embed=letter_embedding, **more)


@query(_ASKED + """ SELECT match_id, count(*) AS n_contexts, md5('Answer the question using the provided context. Cite the sources inline as [#] based on the order of the snippets. If the answer is not in the context, say you don''t know.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(string_agg(trim(context), chr(10) || chr(10) ORDER BY rank) FILTER (WHERE used <= 2500), '(No contexts provided)') || chr(10) || chr(10) || 'Question: ' || any_value(q) || chr(10) || 'Answer:') AS h, md5(string_agg(source, ',' ORDER BY rank)) AS sources FROM u GROUP BY match_id""")
def rag_query(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d).select("match_id", F.size("contexts").cast("bigint").alias("n_contexts"), F.md5("prompt").alias("h"), F.md5(F.array_join("sources", ",")).alias("sources"))


@query(_ASKED + """, w AS (SELECT *, list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM r), z AS (SELECT *, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END AS second FROM w)
SELECT match_id, chunk_id, row_number() OVER (PARTITION BY match_id ORDER BY second DESC, rank) AS place FROM z QUALIFY place <= 3""")
def rag_reranked(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, reranker="overlap", keep=3).select("match_id", F.posexplode("ids").alias("p", "chunk_id")).select("match_id", "chunk_id", (F.col("p") + 1).cast("bigint").alias("place"))


_ONE_MATCH = "(SELECT DISTINCT ON (match_id) * FROM match_results ORDER BY match_id)"


@query(f"SELECT 'longer' AS judge_name, CASE WHEN length(a) = length(b) THEN 'tie' WHEN length(a) > length(b) THEN 'win_a' ELSE 'win_b' END AS verdict, count(*) AS n FROM (SELECT regexp_replace(coalesce(response_a, ''), '^[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g') AS a, regexp_replace(coalesce(response_b, ''), '^[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g') AS b FROM {_ONE_MATCH}) GROUP BY 1, 2")
def judge_table(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_results").dropDuplicates(["match_id"]).select("match_id", "question", "response_a", "response_b")
    judged = plugins.judge_pairs(m, "question", "response_a", "response_b", dataset.presentation_order(F.col("match_id").cast("string")), ["longer"])
    return judged.groupBy("judge_name", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT (('0x' || substr(md5('42|' || match_id), 1, 8))::BIGINT % 2) = 1 AS swapped, count(*) AS n, count(*) FILTER (WHERE lower(trim(winner)) = 'a') AS a_wins FROM {_ONE_MATCH} GROUP BY 1")
def presentation_orders(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_results").dropDuplicates(["match_id"])
    swapped = dataset.presentation_order(F.col("match_id").cast("string"))
    turned = dataset.unswap(dataset.unswap(pairwise.clean_winner(F.col("winner")), swapped), swapped)
    return m.groupBy(swapped.alias("swapped")).agg(F.count("*").alias("n"), F.count_if(turned == "win_a").alias("a_wins"))


@query(f"SELECT count(*) FILTER (WHERE o = 'tie') AS ties, count(*) FILTER (WHERE o = 'first') AS wins_first, count(*) FILTER (WHERE o = 'second') AS wins_second, round(CASE WHEN count(*) FILTER (WHERE o <> 'tie') > 0 THEN (count(*) FILTER (WHERE o = 'first') - count(*) FILTER (WHERE o <> 'tie') / 2) / sqrt(count(*) FILTER (WHERE o <> 'tie') / 4) ELSE 0.0 END, 6) AS z FROM (SELECT CASE WHEN w = 'tie' THEN 'tie' WHEN w = f THEN 'first' WHEN w IS NOT NULL AND f IS NOT NULL THEN 'second' END AS o FROM (SELECT CASE lower(trim(winner)) WHEN 'a' THEN 'win_a' WHEN 'b' THEN 'win_b' WHEN 'tie' THEN 'tie' END AS w, CASE WHEN presentation_order IS NULL THEN NULL WHEN regexp_matches(lower(presentation_order), '^\\W*b') THEN 'win_b' ELSE 'win_a' END AS f FROM {_ONE_MATCH}))")
def position_bias(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_results").dropDuplicates(["match_id"])
    first = F.when(F.lower("presentation_order").rlike(r"^\W*b"), "win_b").when(F.col("presentation_order").isNotNull(), "win_a")
    return pairwise.position_bias(m, first, pairwise.clean_winner(F.col("winner")))


_S = "coalesce(element_at(scores_a, '{0}')[1], 0.0)"


@query("SELECT n_rows, round(n_pass / n_rows, 6) AS pass_rate, round(o, 6) AS mean_overall FROM (SELECT count(*) AS n_rows, avg(" + " + ".join(f"{w} * {_S.format(k)}" for k, w in (("factuality", 0.4), ("grounding", 0.3), ("completeness", 0.2), ("communication", 0.1))) + ") AS o, count(*) FILTER (WHERE round(" + " + ".join(f"{w} * {_S.format(k)}" for k, w in (("factuality", 0.4), ("grounding", 0.3), ("completeness", 0.2), ("communication", 0.1))) + ", 12) >= 0.65 AND least(1.0, " + ", ".join(_S.format(k) for k in ("factuality", "grounding", "completeness", "communication")) + ") >= 0.4) AS n_pass FROM judgments)")
def weighted_pass(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgments")
    scores = F.coalesce("scores_a", F.create_map().cast("map<string,double>"))
    return j.agg(F.count("*").alias("n_rows"), F.round(F.avg(scoring.passed(scores, scoring.RAG_WEIGHTS).cast("double")), 6).alias("pass_rate"), F.round(F.avg(scoring.overall(scores, scoring.RAG_WEIGHTS)), 6).alias("mean_overall"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE least(a, b, c, e) >= 0.6 AND round(a + b, 12) >= 1.4) AS n_pass FROM (SELECT element_at(scores_a, 'grounding')[1] AS a, element_at(scores_b, 'grounding')[1] AS b, element_at(scores_a, 'clarity')[1] AS c, element_at(scores_b, 'clarity')[1] AS e FROM judgments) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL")
def dataset_judge_pass(spark: SparkSession, d: str) -> DataFrame:
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    r = table(spark, d, "judgments").select(at("scores_a", "grounding").alias("a"), at("scores_b", "grounding").alias("b"), at("scores_a", "clarity").alias("c"), at("scores_b", "clarity").alias("e")).where("a is not null and b is not null and c is not null and e is not null")
    ok = scoring.verdict_passed(F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.lit(None).cast("boolean"))
    return r.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_pass"))


@query("SELECT skipped, skip_reason, count(*) AS n FROM (SELECT round(confidence, 9) < 0.75 AS skipped, CASE WHEN round(confidence, 9) < 0.75 THEN 'low_confidence' END AS skip_reason FROM (" + _Q + ")) GROUP BY 1, 2")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    q = extraction_quality(spark, d)
    return dataset.confidence_gate(q, F.round("confidence", 9), 0.75).groupBy("skipped", "skip_reason").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT task_id, c, {_REF} AS r, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9''\\[\\]]+'), lambda w: length(w) >= 4)) AS v FROM {_CTX}), k AS (SELECT *, list_transform(c, lambda x: CASE WHEN len(v) > 0 THEN len(list_intersect(v, regexp_extract_all(lower(x), '[a-z0-9''\\[\\]]+'))) / len(v) ELSE 0.0 END) AS p FROM e)
SELECT coalesce(CASE WHEN len(list_filter(r, lambda x: x >= 1 AND x <= len(c))) = 0 THEN 'no_citation' WHEN len(list_filter(r, lambda x: x < 1 OR x > len(c))) > 0 THEN 'out_of_range' WHEN coalesce(list_max(p), 0.0) < 0.3 THEN 'low_coverage' END, 'fine') AS reason, count(*) AS n FROM k GROUP BY 1""")
def citation_compliance(spark: SparkSession, d: str) -> DataFrame:
    reason = dataset.citation_compliance(F.col("a"), F.col("c"), 0.3)
    return _with_contexts(spark, d).groupBy(F.coalesce(reason, F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT task_type AS name, count(DISTINCT md5(instruction)) AS n_digests FROM task_records WHERE instruction IS NOT NULL GROUP BY 1 HAVING count(DISTINCT md5(instruction)) > 1")
def dataset_versions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "task_records").select(F.col("task_type").alias("name"), F.md5("instruction").alias("h"))
    return compare.versions(t.where("h is not null"), "name", "h").select("name", F.size("digests").cast("bigint").alias("n_digests"))


@query("SELECT x AS task_type FROM (SELECT unnest(['qa', 'summaries', 'citations', 'contextualizations', 'absent']) AS x) WHERE x NOT IN (SELECT task_type FROM task_records WHERE task_type IS NOT NULL)")
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return reports.missing_labels(["qa", "summaries", "citations", "contextualizations", "absent"], table(spark, d, "task_records").where("task_type is not null"), "task_type")


_RUNS = "(SELECT judge_name, count(*) AS n, count(*) FILTER (WHERE trim(error) <> '') AS bad FROM judgments GROUP BY 1)"


@query(f"SELECT judge_name AS label, unnest(list_filter([CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n > 0 AND n < 30 THEN 'too_few_examples' END, CASE WHEN n > 0 AND bad / n > 0.03 THEN 'high_error_rate' END], lambda x: x IS NOT NULL)) AS kind FROM {_RUNS}")
def run_sanity(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "judgments").groupBy("judge_name").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("error") != "", F.lit(False))).alias("bad"))
    return compare.sanity(r, "judge_name", "n", "bad", 30, 0.03)


@query("SELECT judge_name, CASE WHEN g AND j THEN 'both' WHEN g THEN 'generation' WHEN j THEN 'judge' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT judge_name, regexp_matches(lower(error), 'timeout|connection') AS g, regexp_matches(lower(error), 'json|parse') AS j FROM judgments WHERE trim(error) <> '') GROUP BY 1, 2")
def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "judgments").where("trim(error) <> ''")
    part = lambda k, p: F.when(F.lower("error").rlike(p), F.create_map(F.lit(k), F.col("error"))).otherwise(F.create_map().cast("map<string,string>"))
    rest = F.create_map(F.lit("seen"), F.col("error"))
    return reports.error_breakdown(e.withColumn("errors", F.map_concat(part("generation", "timeout|connection"), part("judge", "json|parse"), rest)), "judge_name", "errors")


@query("WITH s AS (SELECT source_path, max(page) AS page_count, coalesce(nullif(max(token_end), 0), sum(len(" + _w("text") + "))) AS token_count FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id) WHERE trim(source_path) <> '' GROUP BY 1) SELECT source_path, kind FROM (SELECT source_path, unnest(list_filter([CASE WHEN coalesce(page_count, 0) = 0 THEN 'missing_pages' END, CASE WHEN token_count < 500 THEN 'too_few_tokens' END, CASE WHEN token_count > 8000 THEN 'too_many_tokens' END], lambda x: x IS NOT NULL)) AS kind FROM s)")
def corpus_warnings(spark: SparkSession, d: str) -> DataFrame:
    return dataset.corpus_warnings(catalog.document_stats(table(spark, d, "chunks")), "source_path", "token_count", "page_count", 500, 8000)


# --- reports on examples, documents and judges ---------------------------------------------


@query("SELECT doc_id, round(CASE WHEN n > 0 THEN 1000 * len(regexp_extract_all(t, '\\[\\d+\\]')) / n ELSE 0.0 END, 6) AS markers_per_1k, round(CASE WHEN n > 0 THEN 1000 * len(regexp_extract_all(t, 'https?://')) / n ELSE 0.0 END, 6) AS urls_per_1k, len(regexp_extract_all(t, '(?m)^\\s*\\d+\\.?\\s+https?://'))::BIGINT AS footnote_urls FROM (SELECT doc_id, coalesce(text, '') AS t, len(" + _w("text") + ") AS n FROM documents)")
def text_densities(spark: SparkSession, d: str) -> DataFrame:
    q = evaluation.densities(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(q["markers_per_1k"], 6).alias("markers_per_1k"), F.round(q["urls_per_1k"], 6).alias("urls_per_1k"), q["footnote_urls"].alias("footnote_urls"))


@query("SELECT text_path AS source_path, CASE WHEN text_path IN (SELECT source_path FROM papers WHERE source_path IS NOT NULL) THEN 'found' ELSE 'missing' END AS state FROM " + _MANIFEST)
def paper_whitelist(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "chunks").where("trim(source_path) <> ''").select("source_path")
    return evaluation.whitelist(table(spark, d, "papers"), wanted, "source_path")


@query(f"""WITH e AS (SELECT task_id, coalesce(rag.sources[1], '') AS d, regexp_replace({_norm('instruction')}, '[?.!]+$', '') AS k, coalesce(expected_response, '') AS a, len(coalesce(rag.contexts, [])) AS n FROM {_ONE_EXAMPLE} WHERE task_id IS NOT NULL), i AS (SELECT *, {_REF} AS r, CASE WHEN k <> '' THEN min(task_id) OVER (PARTITION BY d, k) END AS f, CASE WHEN k <> '' THEN min(task_id) OVER (PARTITION BY k) END AS g FROM e)
SELECT task_id, kind FROM (SELECT task_id, unnest(list_filter([CASE WHEN k = '' THEN 'empty_instruction' END, CASE WHEN len({_w('a')}) = 0 THEN 'empty_answer' END, CASE WHEN task_id <> f THEN 'repeated_in_document' WHEN task_id <> g THEN 'repeated_elsewhere' END, CASE WHEN len(list_filter(r, lambda x: x < 1 OR x > n)) > 0 THEN 'citation_out_of_range' END], lambda x: x IS NOT NULL)) AS kind FROM i)""")
def example_issues(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.example_issues(examples(spark, d), "task_id", F.coalesce(F.try_element_at("rag.sources", F.lit(1)), F.lit("")), "instruction", "expected_response", F.col("rag.contexts"))


_STEM = "lower(regexp_replace(regexp_extract({0}, '[^/]*$'), '(.)\\.[^.]*$', '\\1'))"


@query(f"WITH m AS (SELECT {_STEM.format('source_path')} AS k, arg_min({{'primary_category': primary_category, 'title': title}}, coalesce(primary_category, '') || chr(1) || coalesce(title, '')) AS m FROM papers WHERE trim(source_path) <> '' GROUP BY 1) SELECT text_path, page_count, bytes, document_id, m.m.primary_category AS primary_category, m.m.title AS title FROM {_MANIFEST} f LEFT JOIN m ON m.k = {_STEM.format('text_path')}")
def document_profile(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.manifest(table(spark, d, "chunks"))
    return evaluation.document_profile(m, table(spark, d, "papers"), "text_path", "source_path", ["primary_category", "title"]).select("text_path", "page_count", "bytes", "document_id", "primary_category", "title")


@query("SELECT coalesce(a.p, b.p) AS doc_path, coalesce(n_log, 0) AS n_log, coalesce(n_tasks, 0) AS n_tasks, CASE WHEN n_log IS NULL THEN 'tasks' WHEN n_tasks IS NULL THEN 'log' ELSE 'both' END AS side FROM (SELECT source_path AS p, count(*) AS n_log FROM papers WHERE source_path IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT doc_path AS p, count(*) AS n_tasks FROM task_records WHERE doc_path IS NOT NULL GROUP BY 1) b ON a.p = b.p")
def log_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.log_coverage(table(spark, d, "papers").withColumnRenamed("source_path", "doc_path"), table(spark, d, "task_records"), "doc_path")


@query(f"WITH a AS (SELECT task_id, min(CASE lower(trim(winner)) WHEN 'a' THEN 'win_a' WHEN 'b' THEN 'win_b' WHEN 'tie' THEN 'tie' END) AS label FROM match_results WHERE task_id IS NOT NULL GROUP BY 1), j AS (SELECT task_id, {_VERDICT} AS verdict FROM judgments WHERE task_id IS NOT NULL) SELECT label, verdict, count(*) AS n FROM a JOIN j USING (task_id) WHERE label IS NOT NULL AND verdict IS NOT NULL GROUP BY 1, 2")
def annotations_against_judges(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "match_results").where("task_id is not null").groupBy("task_id").agg(F.min(pairwise.clean_winner(F.col("winner"))).alias("label"))
    v = F.regexp_replace(F.lower(F.trim("verdict")), "[^a-z]+", "_")
    j = table(spark, d, "judgments").where("task_id is not null").select("task_id", F.when(v.isin("win_a", "win_b", "tie"), v).alias("verdict"))
    return evaluation.against_judges(a, j, "task_id", "label", "verdict")


@query("WITH t AS (SELECT judge_name, row_number() OVER (ORDER BY count(*) DESC, judge_name) AS r FROM judgments GROUP BY 1), s AS (SELECT r, model_a AS condition, element_at(scores_a, 'grounding')[1] AS s FROM judgments JOIN t USING (judge_name) WHERE r <= 2), m AS (SELECT condition, avg(s) FILTER (WHERE r = 1) AS x, avg(s) FILTER (WHERE r = 2) AS y FROM s WHERE s IS NOT NULL GROUP BY 1) SELECT condition, round(x, 6) AS mean_a, round(y, 6) AS mean_b, round(x - y, 6) AS diff, round(abs(x - y), 6) AS abs_diff FROM m WHERE x IS NOT NULL AND y IS NOT NULL")
def judge_gap(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgments")
    a, b = (r["judge_name"] for r in j.groupBy("judge_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "judge_name").limit(2).collect())
    return evaluation.judge_gap(j, "judge_name", "model_a", F.try_element_at("scores_a", F.lit("grounding")), a, b)


@query(f"SELECT count(*) AS n, round(avg(p), 6) AS mean, round(min(p), 6) AS least, round(max(p), 6) AS most FROM (SELECT len(list_intersect({_REF}, range(1, len(c) + 1))) / len(c) AS p FROM {_CTX} WHERE len(c) > 0)")
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.coverage_stats(_with_contexts(spark, d), F.col("a"), F.col("c"))


@query(f"WITH e AS (SELECT coalesce(t, 'unknown') AS task_type, (len({_w('q')}) = 0)::INT + (len({_w('a')}) = 0)::INT AS e, CASE WHEN len(c) > 0 THEN len(list_intersect({_REF}, range(1, len(c) + 1))) / len(c) END AS p FROM (SELECT split AS t, coalesce(expected_response, '') AS a, coalesce(rag.contexts, []) AS c, coalesce(instruction, '') AS q FROM {_ONE_EXAMPLE})) SELECT task_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 6) AS share, sum(e)::BIGINT AS empty_fields, round(avg(p), 6) AS mean_coverage, count(*) < 100 AS below_minimum FROM e GROUP BY 1")
def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.quality_report(examples(spark, d), F.col("split"), "instruction", "expected_response", F.coalesce("rag.contexts", F.array().cast("array<string>")), 100)


_ROWS = f"""(WITH e AS (SELECT task_id, q, a, c, {_REF} AS r, range(1, len(c) + 1) AS v, list_distinct(list_filter(regexp_extract_all(lower(a), '[a-z0-9''\\[\\]]+'), lambda w: length(w) >= 4)) AS w4, list_filter(regexp_extract_all(lower(a), '[a-z0-9'']+'), lambda w: length(w) >= 3) AS t3, flatten(list_transform(c, lambda x: regexp_extract_all(lower(coalesce(x, '')), '[a-z0-9'']+'))) AS k3 FROM {_CTX}), p AS (SELECT *, list_transform(c, lambda x: CASE WHEN len(w4) > 0 THEN len(list_intersect(w4, regexp_extract_all(lower(x), '[a-z0-9''\\[\\]]+'))) / len(w4) ELSE 0.0 END) AS cov FROM e)
SELECT task_id, len({_w('a')})::BIGINT AS answer_words, len(list_intersect(r, v))::BIGINT AS n_referenced, len(list_filter(v, lambda x: NOT list_contains(r, x)))::BIGINT AS n_missing, len(list_filter(r, lambda x: NOT list_contains(v, x)))::BIGINT AS n_extra, round(CASE WHEN len(r) = 0 THEN CASE WHEN len(v) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(r, v)) / len(r) END, 6) AS precision, round(CASE WHEN len(v) = 0 THEN CASE WHEN len(r) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(r, v)) / len(v) END, 6) AS recall,
  round(CASE WHEN len(c) > 0 THEN list_sum(cov) / len(c) END, 6) AS mean_coverage, round(CASE WHEN len(t3) > 0 AND len(c) > 0 THEN len(list_filter(t3, lambda w: list_contains(k3, w))) / len(t3) ELSE 0.0 END, 6) AS grounded FROM p)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluated(_with_contexts(spark, d), "task_id", "q", "a", F.col("c")).drop("prompt_chars")


@query(f"SELECT * FROM {_ROWS}")
def evaluated_rows(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)


@query(f"WITH e AS (SELECT * FROM {_ROWS}), l AS (SELECT unnest(['precision', 'recall', 'mean_coverage', 'grounded']) AS metric, unnest([precision, recall, mean_coverage, grounded]) AS v FROM e), w AS (SELECT count(*) AS n_rows, round(avg((precision >= 0.5)::INT), 6) AS pass_rate, round(avg((answer_words = 0)::INT), 6) AS error_rate FROM e) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, any_value(n_rows) AS n_rows, any_value(pass_rate) AS pass_rate, any_value(error_rate) AS error_rate FROM l, w WHERE v IS NOT NULL GROUP BY metric")
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics_summary(_evaluated(spark, d), ["precision", "recall", "mean_coverage", "grounded"], F.col("precision") >= 0.5, F.col("answer_words") == 0)


@query("SELECT judge_name, len(h)::BIGINT AS n_found, array_to_string(list_filter(['high', 'low', 'medium'], lambda x: NOT list_contains(h, x)), ',') AS missing FROM (SELECT judge_name, coalesce(list(DISTINCT confidence) FILTER (WHERE confidence IN ('high', 'low', 'medium')), []) AS h FROM judgments GROUP BY 1)")
def artifact_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.artifact_coverage(table(spark, d, "judgments"), "judge_name", F.col("confidence"), ["high", "medium", "low"])


@query("SELECT task_type, row_number() OVER (PARTITION BY task_type ORDER BY task_id) AS rank, task_id FROM (SELECT DISTINCT task_type, task_id FROM task_records WHERE task_type IS NOT NULL AND task_id IS NOT NULL) QUALIFY rank <= 5")
def first_tasks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.first_per_key(table(spark, d, "task_records"), "task_type", "task_id", 5)


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY md5('42|' || chunk_id), chunk_id) AS r FROM (SELECT DISTINCT source_path, chunk_id FROM chunks WHERE trim(source_path) <> '') QUALIFY r <= 4) SELECT source_path, chunk_id, row_number() OVER (PARTITION BY source_path ORDER BY chunk_id) AS place FROM k")
def random_chunks(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.random_chunks(table(spark, d, "chunks"), "source_path", "chunk_id", 4)


@query("WITH s AS (SELECT pair_id, avg(element_at(scores_a, 'grounding')[1]) AS s FROM judgments GROUP BY 1) SELECT pair_id, coalesce(abs(round(s, 9) - 0.5) < 0.1, false) AS near FROM s ORDER BY coalesce(abs(round(s, 9) - 0.5) < 0.1, false) DESC, md5('42|' || pair_id), pair_id LIMIT 40")
def disagreement_sample(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "judgments").groupBy("pair_id").agg(F.avg(F.try_element_at("scores_a", F.lit("grounding"))).alias("s"))
    return evaluation.disagreement_sample(s, "pair_id", F.round("s", 9), 0.1, 40).select("pair_id", "near")


@query("WITH m AS (SELECT setup AS l, avg(params_b) AS v FROM model_cards WHERE setup IS NOT NULL GROUP BY 1) SELECT x.l AS label_a, y.l AS label_b, round(x.v - y.v, 6) AS diff, abs(round(x.v - y.v, 6)) > 2 AS differs FROM m x JOIN m y ON x.l < y.l")
def mean_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "model_cards").where("setup is not null").groupBy("setup").agg(F.avg("params_b").alias("v"))
    return evaluation.mean_matrix(m, "setup", "v", 2.0)


@query("SELECT CASE WHEN trim(error) <> '' THEN 'error' WHEN verdict IS NULL THEN 'unknown' ELSE 'success' END AS status, count(*) AS n, coalesce(sum(cardinality(scores_a)), 0)::BIGINT AS n_items FROM judgments GROUP BY 1")
def log_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.trim("error") != "", "error").when(F.col("verdict").isNotNull(), "success")
    return evaluation.log_status(table(spark, d, "judgments"), status, F.when(F.col("scores_a").isNotNull(), F.size("scores_a")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

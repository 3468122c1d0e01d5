"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import format_duplicates, label_consensus, linked_splits, luce_ranking, mixing, packing, pair_defects, residue, scan_repair, split_overlap
from foliospark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.found(table(spark, d, "offline_examples"), table(spark, d, "match_results"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("table_name", "defect").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return label_consensus.found(table(spark, d, "judgments"))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    items, model = label_consensus.judgments_model(table(spark, d, "judgments"))
    return label_consensus.consensus(items, model).withColumnsRenamed({"item": "pair_id", "label": "verdict"})


def p2_judges(spark: SparkSession, d: str) -> DataFrame:
    items, model = label_consensus.judgments_model(table(spark, d, "judgments"))
    return label_consensus.reliability(items, model).withColumnRenamed("annotator", "judge_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.found(table(spark, d, "chunks"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired(table(spark, d, "chunks"))


def _p4_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks = table(spark, d, "task_records").select(F.col("task_id").alias("id"), F.array("doc_path").alias("paths"))
    examples = table(spark, d, "offline_examples").select(F.col("task_id").alias("id"), F.col("rag.sources").alias("paths"))
    return tasks, examples


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.found(*_p4_parts(spark, d))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.record_splits(linked_splits.records(*_p4_parts(spark, d)), table(spark, d, "split_targets"))


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """Task records first, then examples, which fill what the splits lack."""
    return linked_splits.batch_splits([linked_splits.records(x) for x in _p4_parts(spark, d)], table(spark, d, "split_targets"))


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    """Components after the second of two persisted batches, those that had a split before and new ones."""
    return linked_splits.batch_states([linked_splits.records(x) for x in _p4_parts(spark, d)], table(spark, d, "split_targets"))


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.balance(linked_splits.records(*_p4_parts(spark, d)), table(spark, d, "split_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return luce_ranking.found(table(spark, d, "match_results"), table(spark, d, "model_cards"))


def p5_strengths(spark: SparkSession, d: str) -> DataFrame:
    return luce_ranking.rank(table(spark, d, "match_results"), table(spark, d, "model_cards"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.found(table(spark, d, "offline_examples"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(table(spark, d, "offline_examples"), linked_splits.arxiv_numbers(F.col("rag.sources")))


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """The hash join alone: evaluation records whose canonical form stands in training, and their pairs, per split."""
    return split_overlap.exact_counts(table(spark, d, "offline_examples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies(table(spark, d, "offline_examples"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapsed(table(spark, d, "offline_examples"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "bin_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d), table(spark, d, "bin_sizes"))


#: Limits that bind: a segment per 96 tokens, and loss on at most nine tokens of ten.
_TIGHT = {"tokens_per_segment": 96, "loss_share": 0.9}


def p8_tight(spark: SparkSession, d: str) -> DataFrame:
    """Fill in every dimension where all three limits bind."""
    docs, bins = table(spark, d, "documents"), table(spark, d, "bin_sizes")
    return packing.fill_report(packing.pack(docs, bins, **_TIGHT), bins, **_TIGHT)


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """No container beyond a limit, no token lost, no text divided that fits."""
    docs, bins = table(spark, d, "documents"), table(spark, d, "bin_sizes")
    return packing.breaches(packing.pack(docs, bins), docs, bins)


def p8_tight_limits(spark: SparkSession, d: str) -> DataFrame:
    """The same under the tighter limits."""
    docs, bins = table(spark, d, "documents"), table(spark, d, "bin_sizes")
    return packing.breaches(packing.pack(docs, bins, **_TIGHT), docs, bins, **_TIGHT)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """(source, off_share, over_cap): whether a source misses its target share by more than half a hundredth or is used too often."""
    targets = table(spark, d, "mix_targets")
    r = p9_shares(spark, d).join(targets.select(mixing.source_key(F.col("source")).alias("source"), "max_repeats"), "source")
    return r.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) > 0.005).alias("off_share"), (F.col("max_used") > F.col("max_repeats")).alias("over_cap"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents"))


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


_P4 = r"""
WITH RECURSIVE rec AS (
  SELECT task_id AS id, [doc_path] AS paths FROM task_records WHERE task_id IS NOT NULL
  UNION ALL
  SELECT task_id, coalesce(rag.sources, []) FROM offline_examples WHERE task_id IS NOT NULL
), named AS (
  SELECT DISTINCT id, unnest(list_distinct(flatten(list_transform(paths, lambda p: regexp_extract_all(lower(coalesce(p, '')), '(\d{4}\.\d{4,9}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})', 1))))) AS e FROM rec
), edge AS (
  SELECT DISTINCT a.e AS u, b.e AS v FROM named a JOIN named b ON a.id = b.id
), reach AS (
  SELECT u, v FROM edge
  UNION
  SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u
), comp AS (SELECT u AS e, min(v) AS c FROM reach GROUP BY u
), grp AS (SELECT c, min(id) AS g FROM named JOIN comp USING (e) GROUP BY c
)
SELECT r.id AS task_id, coalesce(min(g.g), r.id) AS group_id
FROM (SELECT DISTINCT id FROM rec) r LEFT JOIN named n ON n.id = r.id LEFT JOIN comp USING (e) LEFT JOIN grp g ON g.c = comp.c
GROUP BY r.id
"""

_P7 = r"""
WITH src AS (
  SELECT DISTINCT task_id, trim(regexp_replace(regexp_replace(trim(coalesce(instruction, '')), '(?:^|[;|\n\r•·])[^\p{L}\p{N};|\n\r]*(\p{L}[\p{L}\p{N} _\-]{0,39}?)\s*[:：]', chr(1) || '\1' || chr(2), 'g'), '^ +', '')) AS m,
    coalesce(instruction, '') AS t, regexp_replace(replace(lower(coalesce(task_type, '')), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS tt
  FROM offline_examples WHERE task_id IS NOT NULL
), norm AS (
  SELECT task_id, tt, string_split(m, chr(1)) AS p, regexp_replace(replace(lower(t), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS whole FROM src
), keyed AS (
  SELECT task_id, tt, CASE WHEN len(p) > 2 AND regexp_replace(p[1], '[^\p{L}\p{N}\p{M}]+', '', 'g') = ''
    THEN array_to_string(list_sort(list_transform(list_filter(p, lambda x: contains(x, chr(2))), lambda x: regexp_replace(replace(lower(split_part(x, chr(2), 1)), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]+', '', 'g') || '=' || regexp_replace(replace(lower(split_part(x, chr(2), 2)), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]+', '', 'g'))), chr(3))
    ELSE 'instruction=' || whole END AS k
  FROM norm WHERE whole <> ''
), grp AS (SELECT tt, k, min(task_id) AS kept FROM keyed GROUP BY tt, k)
"""


_NO_BREACH = "SELECT bin_name, count(*) AS n_documents, 0::BIGINT AS over_tokens, 0::BIGINT AS over_segments, 0::BIGINT AS over_loss, 0::BIGINT AS lost, 0::BIGINT AS divided FROM bin_sizes, documents WHERE doc_id IS NOT NULL GROUP BY bin_name"
_SQUEEZE = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"
_P6 = (
    _P7.replace("SELECT DISTINCT task_id,", "SELECT DISTINCT task_id, lower(trim(split)) AS split, " + _SQUEEZE.format(r"regexp_replace(coalesce(expected_response, ''), '\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]', ' ', 'g')") + " AS a,")
    .replace("SELECT task_id, tt, string_split", "SELECT task_id, split, a, tt, string_split")
    .replace("SELECT task_id, tt, CASE", "SELECT task_id, split, a, tt, CASE")
    + """, member AS (SELECT DISTINCT task_id, split, k, a FROM keyed WHERE split IN ('train', 'validation', 'test')
), n AS (SELECT k, a, count(*) FILTER (WHERE split = 'train') AS t FROM member GROUP BY k, a HAVING t > 0)
SELECT split, count(*) AS n_records, sum(t)::BIGINT AS n_overlaps FROM member JOIN n USING (k, a) WHERE split <> 'train' GROUP BY split"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4,
        "p4_balance": "SELECT split_name AS split, FALSE AS off_target, 0::BIGINT AS torn FROM split_targets",
        "p4_states": f"WITH g AS ({_P4}), s AS (SELECT group_id, count(*) AS n, bool_or(task_id IN (SELECT task_id FROM task_records WHERE task_id IS NOT NULL)) AS old FROM g GROUP BY 1) SELECT CASE WHEN old THEN 'old' ELSE 'new' END AS state, count(*) AS n_components, sum(n)::BIGINT AS n_records FROM s GROUP BY 1",
        "p6_exact": _P6,
        "p8_limits": _NO_BREACH,
        "p9_checks": "SELECT source, FALSE AS off_share, FALSE AS over_cap FROM mix_targets",
        "p8_tight_limits": _NO_BREACH,
        "p7_found": _P7 + "SELECT g.kept AS kept_task_id, x.task_id AS copy_task_id FROM keyed x JOIN grp g USING (tt, k) WHERE x.task_id <> g.kept",
        "p7_collapsed": _P7 + "SELECT g.kept AS kept_task_id, count(DISTINCT x.task_id) AS n_records FROM keyed x JOIN grp g USING (tt, k) GROUP BY g.kept",
    }

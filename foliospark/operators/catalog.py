"""Harvest, catalogue, manifest and document statistics (O-016..O-020, O-031, O-032, O-140..O-142, O-183, O-184)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import canonical_id, words


def latest_by(df: DataFrame, key: Column, order: Column, last: bool = True) -> DataFrame:
    """One whole row per key, the last (or first) in order, by a combining aggregate."""
    pick = F.max_by if last else F.min_by
    return df.withColumn("__k", key).where("__k is not null and __k <> ''").groupBy("__k").agg(pick(F.struct(*df.columns), order).alias("r")).select("r.*")


def harvest(papers: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """The n newest papers of a period, each canonical id once (its last version)."""
    cid = canonical_id(F.col("canonical_id"), F.col("arxiv_id"))
    inside = papers.where((F.col("published") >= F.lit(start).cast("timestamp_ntz")) & (F.col("published") < F.lit(end).cast("timestamp_ntz")))
    one = latest_by(inside.withColumn("cid", cid), F.col("cid"), F.struct(F.coalesce("updated", "published").alias("u"), F.coalesce("arxiv_id", F.lit("")).alias("a")))
    return one.orderBy(F.desc("published"), "cid").limit(n)


def document_stats(chunks: DataFrame) -> DataFrame:
    """(source_path, page_count, token_count, n_chunks) from chunk rows: the largest token end, else the sum of words."""
    rows = chunks.where(F.trim("source_path") != "").dropDuplicates(["chunk_id"])
    return rows.groupBy("source_path").agg(F.max("page").alias("page_count"), F.coalesce(F.nullif(F.max("token_end").cast("bigint"), F.lit(0)), F.sum(F.size(words(F.col("text")))).cast("bigint")).alias("token_count"), F.count("*").alias("n_chunks"))


def manifest(chunks: DataFrame) -> DataFrame:
    """(document_id, text_path, page_count, bytes): one row per source file."""
    rows = chunks.where(F.trim("source_path") != "").dropDuplicates(["chunk_id"])
    return rows.groupBy(F.col("source_path").alias("text_path")).agg(F.countDistinct("page").alias("page_count"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes")).withColumn("document_id", F.regexp_replace("text_path", r"\.[^./]*$", ""))


def catalog(papers: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Papers joined with their documents by path, first version wins, arrays also as text."""
    one = latest_by(papers.where(F.trim("source_path") != ""), F.col("source_path"), F.struct(F.coalesce("arxiv_id", F.lit("")).alias("a"), F.coalesce("published").alias("p"), F.coalesce("title", F.lit("")).alias("t")), last=False)
    return one.join(manifest_rows, one["source_path"] == manifest_rows["text_path"]).select(
        "text_path", "page_count", "bytes", canonical_id(F.col("canonical_id"), F.col("arxiv_id")).alias("canonical"), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; ").alias("authors_joined"), F.array_join(F.coalesce("categories", F.array().cast("array<string>")), "; ").alias("categories_joined")
    )


def catalog_missing(papers: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """(text_path): documents without a paper."""
    return manifest_rows.select("text_path").join(papers.select(F.col("source_path").alias("text_path")).where("text_path is not null"), "text_path", "left_anti")


def corpus_summary(stats: DataFrame) -> DataFrame:
    """One row: least, median and most tokens and pages per document."""
    out = [F.count("*").alias("n_documents")]
    for c in ("token_count", "page_count"):
        out += [F.min(c).alias(f"min_{c}"), F.round(F.median(c), 6).alias(f"median_{c}"), F.max(c).alias(f"max_{c}")]
    return stats.agg(*out)


def parse_atom(df: DataFrame, payload: str) -> DataFrame:
    """(arxiv_id, version, title, summary, authors, categories, primary_category, published, updated, pdf_url) of Atom feeds, JVM-side.

    Entries without id or dates are dropped; blank links fall back to the id's PDF; http becomes https.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(payload), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    entries = df.select(F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("e"))
    x = lambda path: F.nullif(F.trim(F.regexp_replace(F.xpath_string("e", F.lit(path)), r"\s+", " ")), F.lit(""))
    lists = lambda path: F.filter(F.transform(F.xpath("e", F.lit(path)), lambda a: F.trim(a)), lambda a: a != "")
    full = F.element_at(F.split(x("entry/id"), "/abs/"), -1)
    e = entries.select(
        F.split_part(full, F.lit("v"), F.lit(1)).alias("arxiv_id"),
        F.coalesce(F.nullif(F.regexp_extract(full, "^[^v]*v(.*)$", 1), F.lit("")), F.lit("1")).alias("version"),
        x("entry/title").alias("title"),
        x("entry/summary").alias("summary"),
        lists("entry/author/name/text()").alias("authors"),
        lists("entry/category/@term").alias("categories"),
        x("entry/primary_category/@term").alias("primary_category"),
        F.try_to_timestamp(x("entry/published"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("published"),
        F.try_to_timestamp(x("entry/updated"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("updated"),
        x("entry/link[@title='pdf']/@href").alias("link"),
    )
    pdf = F.regexp_replace(F.coalesce("link", F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id", F.lit("v"), "version")), "^http:", "https:")
    return e.where("arxiv_id is not null and published is not null and updated is not null").withColumn("pdf_url", pdf).drop("link")


def category_query(categories: list[str], after: str | None = None, before: str | None = None) -> str:
    """Search expression for any of the categories within submission dates (yyyymmdd)."""
    if not categories:
        raise ValueError("at least one category is needed")
    q = "(" + "+OR+".join(f"cat:{c}" for c in categories) + ")"
    return q + (f"+AND+submittedDate:[{after or '*'}+TO+{before or '*'}]" if after or before else "")

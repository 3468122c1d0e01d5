"""Chunks, sentences, sections, spans and their diagnostics (O-100..O-107, O-182, O-195)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import normalise, words
from foliospark.plans.scale import numbered

# Endings after which a full stop ends no sentence.
ABBREVIATIONS = """
al. e.g. i.e. cf. vs. etc. incl. approx. dr. mr. mrs. ms. sr. jr. prof. rev. hon. gov. gen. col. lt. sgt. fig. figs. eq. eqs. tab. ref. refs. no. nos. vol. vols. pp. ch. sec. sect. app.
suppl. ibid. op. cit. ed. eds. trans. dept. univ. inst. assoc. corp. inc. ltd. co. min. max. avg. std. est. ca. c.
""".split()


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def word_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Array of word windows; the window that reaches the last word is the last."""
    check_window(size, overlap)
    step = size - overlap

    def cut_up(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - overlap) / step) - 1).cast("int")
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(words(text)), cut_up))  # bound once: otherwise every window splits the text again


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id_col, chunk_index, chunk_text): one row per window, JVM-side."""
    return docs.select(id_col, F.posexplode(word_chunks(F.col(text_col), size, overlap)).alias("chunk_index", "chunk_text"))


def sentences(text: Column) -> Column:
    """Array of sentences; abbreviations end none, and pieces of under three words join the sentence before."""
    c = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    pieces = F.regexp_extract_all(c, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    pattern = "(?i)(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")$"
    none = F.array().cast("array<string>")
    seed = F.struct(F.lit("").alias("open"), none.alias("out"))

    def close(s: Column, p: Column) -> Column:
        whole = F.concat(s["open"], p)
        done = whole.rlike(r"[.!?]$") & (F.trim(whole) != "") & ~F.trim(whole).rlike(pattern)
        return F.struct(F.when(done, F.lit("")).otherwise(whole).alias("open"), F.when(done, F.concat(s["out"], F.array(F.trim(whole)))).otherwise(s["out"]).alias("out"))

    split = F.aggregate(pieces, seed, close, lambda s: F.when(F.trim(s["open"]) != "", F.concat(s["out"], F.array(F.trim(s["open"])))).otherwise(s["out"]))
    return F.aggregate(
        split,
        none,
        lambda out, p: F.when((F.size(words(p)) < 3) & (F.size(out) > 0), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), p)))).otherwise(F.concat(out, F.array(p))),
    )


def sentence_chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Array of chunks of whole sentences, each begun with the last ``overlap`` words of the one before."""
    check_window(size, overlap)
    none = F.array().cast("array<string>")
    seed = F.struct(none.alias("tail"), none.alias("cur"), none.alias("out"))

    def add(s: Column, p: Column) -> Column:
        w = words(p)
        fits = (F.size(s["cur"]) == 0) | (F.size(s["tail"]) + F.size(s["cur"]) + F.size(w) <= size)
        full = F.concat(s["tail"], s["cur"])
        tail = F.when(F.lit(overlap) > 0, F.slice(full, F.greatest(F.lit(1), F.size(full) - overlap + 1), F.lit(max(overlap, 1)))).otherwise(none)
        return F.struct(
            F.when(fits, s["tail"]).otherwise(tail).alias("tail"),
            F.when(fits, F.concat(s["cur"], w)).otherwise(w).alias("cur"),
            F.when(fits, s["out"]).otherwise(F.concat(s["out"], F.array(F.array_join(full, " ")))).alias("out"),
        )

    return F.aggregate(sentences(text), seed, add, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(F.array_join(F.concat(s["tail"], s["cur"]), " ")))).otherwise(s["out"]))


def section_groups(pages: DataFrame, doc: str, page: str, title: str, text: str) -> DataFrame:
    """(doc, section, section_title, start_page, end_page, text): runs of pages with the same carried-on title."""
    clean = F.nullif(F.trim(title), F.lit(""))
    w = W.partitionBy(doc).orderBy(page)
    rows = pages.withColumn("__t", clean)
    before = F.last("__t", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = (F.row_number().over(w) == 1) | (F.col("__t").isNotNull() & (before.isNull() | (F.col("__t") != before)))
    runs = rows.withColumn("__n", fresh.cast("int")).withColumn("section", F.sum("__n").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(F.col(page).alias("p"), F.col(text).alias("x"))))), lambda s: s["x"]), "\n\n")
    return (
        runs.groupBy(doc, "section")
        .agg(F.max("__t").alias("section_title"), F.min(page).alias("start_page"), F.max(page).alias("end_page"), body.alias("text"))
        .where("text <> ''")
    )


def chunk_spans(chunks: DataFrame, doc: str, section: str, order: str, n_words: str, overlap: int) -> DataFrame:
    """Adds token_start and token_end: the cursor of a document moves on by the words that a chunk doesn't share with the one before in its section."""
    d, s = W.partitionBy(doc).orderBy(order), W.partitionBy(doc, section).orderBy(order)
    lag = F.lag(n_words).over(s)
    shared = F.when(lag.isNull(), 0).otherwise(F.least(F.lit(overlap), lag))
    own = F.greatest(F.lit(1), F.col(n_words) - F.col("__shared"))
    start = F.coalesce(F.sum("__own").over(d.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("__shared", shared).withColumn("__own", own).withColumn("token_start", start.cast("bigint")).withColumn("token_end", (F.col("token_start") + F.col(n_words)).cast("bigint")).drop("__shared", "__own")


def global_ids(chunks: DataFrame, doc: str, order: str, out: str = "chunk_no") -> DataFrame:
    """Numbers 0, 1, ... over all chunks by document and order, from the counts of ranges."""
    return numbered(chunks, out, doc, order).withColumn(out, F.col(out) - 1)


def duplicate_chunks(chunks: DataFrame, min_tokens: int = 8) -> DataFrame:
    """(source_path, chunk_indices, n): groups of equal normalised texts of at least ``min_tokens`` words within a source."""
    rows = chunks.select("source_path", "chunk_index", normalise(F.col("text")).alias("t")).where((F.trim("source_path") != "") & (F.size(words(F.col("t"))) >= min_tokens)).distinct()
    return rows.groupBy("source_path", F.md5("t").alias("h")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk_index")).alias("chunk_indices")).where("n > 1").select("source_path", "chunk_indices", "n")


def span_issues(chunks: DataFrame) -> DataFrame:
    """(source_path, chunk_index, chunk_id, kind): missing, negative, empty and backward spans."""
    w = W.partitionBy("source_path").orderBy("chunk_index", "chunk_id").rowsBetween(W.unboundedPreceding, -1)
    both = F.col("token_start").isNotNull() & F.col("token_end").isNotNull()
    before = F.last(F.when(both, F.col("token_start")), True).over(w)
    found = F.when(~both, F.array(F.lit("missing_span"))).otherwise(
        F.array_compact(
            F.array(
                F.when((F.col("token_start") < 0) | (F.col("token_end") < 0), "negative_span"),
                F.when(F.col("token_end") <= F.col("token_start"), "non_positive_length"),
                F.when(F.col("token_start") < before, "non_monotonic_start"),
            )
        )
    )
    rows = chunks.where(F.trim("source_path") != "").select("source_path", "chunk_index", "chunk_id", "token_start", "token_end").distinct()
    return rows.withColumn("found", found).select("source_path", "chunk_index", "chunk_id", F.explode("found").alias("kind"))

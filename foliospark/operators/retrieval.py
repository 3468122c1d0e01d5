"""Exact vector search, re-ranking, retrieval metrics, context packing and index checks (O-069, O-072, O-143, O-154, O-177, O-190..O-196)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.text import words
from foliospark.plans.scale import cut

#: Queries are searched in blocks of about so many bytes; a block travels to every task.
BLOCK_BYTES = 64 << 20
#: Within a task, a batch of vectors meets so many queries at once.
STEP = 1024


def norm(v: Column) -> Column:
    """Euclidean norm in doubles; 1 for a null vector or one of zeros."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n > 0, n).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores and their ids, ties to the smaller id; only the candidates at or above the k-th score are sorted."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        most = int((scores >= kth).sum(1).max())
        keep = np.argpartition(-scores, min(most, scores.shape[1]) - 1, axis=1)[:, :most]
        scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def top_k(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, embedding: str, k: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, vector_id, score): the k nearest of all vectors by cosine, exactly; ties go to the smaller id.

    Every query meets every vector, in blocks of queries of about BLOCK_BYTES: a
    block is sent out, each task multiplies its vectors with it and keeps k per
    query, those partial answers are written, and the block is dropped before the
    next one - so neither driver nor executors ever hold more than one.
    """
    spark = vectors.sparkSession
    qid, vid = queries.schema[query_id].dataType.simpleString(), vectors.schema[vector_id].dataType.simpleString()
    result = f"{query_id} {qid}, rank int, {vector_id} {vid}, score double"
    v = vectors.where(F.col(embedding).isNotNull() & F.col(vector_id).isNotNull()).select(F.col(vector_id).alias("v"), F.col(embedding).alias("x"))
    asked = cut(queries.where(F.col(embedding).isNotNull()).select(F.col(query_id).alias("q"), F.col(embedding).alias("x"), F.xxhash64(query_id).alias("b")))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    blocks = max(1, -(-(size["n"] * 8 * (size["d"] or 1)) // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod("b", F.lit(blocks)) == b).select("q", "x").toPandas()
        if rows.empty:
            continue
        state = spark.sparkContext.broadcast((rows["q"].to_numpy(), _unit(rows["x"])))

        def search(it: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            ids, q = state.value
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(ids) // STEP)
            for pdf in it:
                x, own = _unit(pdf["x"]), pdf["v"].to_numpy()
                for i in range(len(best)):
                    part = slice(i * STEP, (i + 1) * STEP)
                    s = np.round(q[part] @ x.T, 9)
                    if exclude_self:
                        s[ids[part, None] == own[None, :]] = -np.inf
                    names = np.broadcast_to(own, s.shape)
                    old = best[i]
                    best[i] = _best(s, names, k) if old is None else _best(np.hstack([old[0], s]), np.hstack([old[1], names]), k)
            for i, found in enumerate(best):
                if found is not None:
                    keep = np.isfinite(found[0]).ravel()
                    yield pd.DataFrame({"q": np.repeat(ids[i * STEP : (i + 1) * STEP], found[0].shape[1])[keep], "v": found[1].ravel()[keep], "score": found[0].ravel()[keep]})

        got = v.mapInPandas(search, f"q {qid}, v {vid}, score double")
        parts.append(cut(got) if blocks > 1 else got)
        if blocks > 1:
            state.destroy()
    if not parts:
        return spark.createDataFrame([], result)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = W.partitionBy("q").orderBy(F.desc("score"), "v")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "rank", F.col("v").alias(vector_id), F.round("score", 6).alias("score"))


def rerank(hits: DataFrame, query_id: str, rerank_score: Column, keep: int) -> DataFrame:
    """Hits ordered by the second score where there is one, else the first; ties keep the earlier rank."""
    scored = hits.withColumn("reranker_score", rerank_score)
    w = W.partitionBy(query_id).orderBy(F.desc(F.coalesce("reranker_score", "score")), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= keep)


def ablation(hits: DataFrame, query_id: str, grid: list[tuple[str, int, int]], rerank_score: Column) -> DataFrame:
    """Hits under each condition (name, wide k, narrow k): ranks come once, at the widest k."""
    cond = F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), F.lit(a).alias("wide"), F.lit(b).alias("narrow")) for n, a, b in grid)))
    rows = hits.withColumn("c", cond).where(F.col("rank") <= F.col("c.wide")).withColumn("second", rerank_score)
    w = W.partitionBy(query_id, "c.condition").orderBy(F.desc(F.coalesce("second", "score")), "rank")
    return rows.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= F.col("c.narrow")).select(F.col("c.condition").alias("condition"), *[c for c in rows.columns if c not in ("c", "second")], "final_rank")


def hit_metrics(hits: DataFrame, query_id: str, relevant: Column, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per query: hit@k for each k and the reciprocal of the first relevant rank, 0 where none is."""
    first = F.min(F.when(relevant, F.col("rank")))
    return hits.groupBy(query_id).agg(*(F.max(F.when(relevant & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_at_{k}") for k in ks), F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_summary(per_query: DataFrame, queries: DataFrame, query_id: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: hit rates over all evaluated queries, mean reciprocal rank over those with results."""
    all_q = queries.select(query_id).distinct().join(per_query, query_id, "left")
    return all_q.agg(F.count("*").alias("evaluated"), *(F.round(F.avg(F.coalesce(F.col(f"hit_at_{k}"), F.lit(0))), 6).alias(f"hit_at_{k}") for k in ks), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def pack_contexts(contexts: DataFrame, query_id: str, order: str, text: str, max_chars: int) -> DataFrame:
    """The leading contexts of each query whose lengths, two for each joint, stay within the limit; it stops at the first that doesn't fit."""
    w = W.partitionBy(query_id).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return contexts.withColumn("used", F.sum(F.length(text) + 2).over(w)).where(F.col("used") <= max_chars)


def pack_tokens(contexts: Column, budget: int) -> Column:
    """Contexts within a budget of estimated tokens; the first always enters, cut to the budget if need be, and is charged."""
    est = lambda x: F.floor(F.size(words(x)) * F.lit(1.3)).cast("int")
    seed = F.struct(F.lit(False).alias("stop"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        first = F.size(s["out"]) == 0
        fits = s["used"] + est(x) <= budget
        short = F.when(fits, x).otherwise(F.array_join(F.slice(words(x), 1, max(1, int(budget / 1.3))), " "))
        take = ~s["stop"] & (fits | first)
        return F.struct((s["stop"] | ~(fits | first)).alias("stop"), F.when(take, s["used"] + est(short)).otherwise(s["used"]).cast("int").alias("used"), F.when(take, F.concat(s["out"], F.array(short))).otherwise(s["out"]).alias("out"))

    return F.aggregate(contexts, seed, add, lambda s: s["out"])


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Stand-in embedder: counts of words by hash, as array<double>."""
    buckets = F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))


def index_issues(chunks: DataFrame, embeddings: DataFrame, dimension: int, id_chunk: str, id_vec: str, embedding: str) -> DataFrame:
    """(kind, expected, found): counts that differ, vectors of another dimension, ids on one side only."""
    c = chunks.agg(F.countDistinct(id_chunk).alias("n_chunks"))
    e = embeddings.agg(F.countDistinct(id_vec).alias("n_vectors"), F.count_if(F.size(embedding) != dimension).alias("n_bad"))
    a = chunks.select(F.col(id_chunk).cast("bigint").alias("i")).distinct().join(embeddings.select(F.col(id_vec).cast("bigint").alias("i")), "i", "left_anti").agg(F.count("*").alias("n_only"))
    row = c.withColumn("n_vectors", e.select("n_vectors").scalar()).withColumn("n_bad", e.select("n_bad").scalar()).withColumn("n_only", a.scalar())
    kinds = F.array_compact(
        F.array(
            F.when(F.col("n_chunks") != F.col("n_vectors"), F.struct(F.lit("mapping_size_mismatch").alias("kind"), F.col("n_chunks").alias("expected"), F.col("n_vectors").alias("found"))),
            F.when(F.col("n_bad") > 0, F.struct(F.lit("dimension_mismatch").alias("kind"), F.lit(0).cast("bigint").alias("expected"), F.col("n_bad").alias("found"))),
            F.when(F.col("n_only") > 0, F.struct(F.lit("missing_vectors").alias("kind"), F.lit(0).cast("bigint").alias("expected"), F.col("n_only").alias("found"))),
        )
    )
    return row.select(F.explode(kinds).alias("i")).select("i.*")


# --- index ------------------------------------------------------------------


def build_index(chunks: DataFrame, root: str, id_col: str, text_col: str, keep: list[str], embed: Callable[[Column], Column] = hashed_embedding, model: str = "hashed") -> None:
    """Write an index below ``root``: unit vectors, the map of chunks, and one row of metadata (model, dimension, count)."""
    ids = chunks.where(F.col(id_col).isNotNull() & (F.trim(text_col) != "")).dropDuplicates([id_col])
    v = ids.select(F.col(id_col), embed(F.col(text_col)).alias("__x"))
    v.select(id_col, F.transform(F.col("__x"), lambda a: a / norm(F.col("__x"))).alias("embedding")).write.mode("overwrite").parquet(f"{root}/vectors")
    ids.select(id_col, *keep, F.col(text_col).alias("text")).write.mode("overwrite").parquet(f"{root}/mapping")
    written = chunks.sparkSession.read.parquet(f"{root}/vectors")
    written.agg(F.lit(model).alias("model"), F.max(F.size("embedding")).alias("dimension"), F.count("*").alias("n_vectors")).coalesce(1).write.mode("overwrite").json(f"{root}/meta")


def load_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, mapping, meta) of an index written by :func:`build_index`."""
    return spark.read.parquet(f"{root}/vectors"), spark.read.parquet(f"{root}/mapping"), spark.read.schema("model string, dimension int, n_vectors bigint").json(f"{root}/meta")


def ask(questions: DataFrame, vectors: DataFrame, mapping: DataFrame, question_id: str, question: str, chunk_id: str, k: int, max_chars: int = 6000, keep: int | None = None, embed: Callable[[Column], Column] = hashed_embedding, reranker: str | None = None, generator: str | None = None) -> DataFrame:
    """(question_id, prompt, contexts, sources, ids, scores, answer): retrieve, re-rank, render, pack and prompt, and the generator's answer if one is named.

    ``mapping`` has chunk_id, text, source_path, page and section_title. Contexts
    are headed by section and page and numbered by rank; those that pass
    ``max_chars`` stay in ``contexts`` but out of the prompt.
    """
    from foliospark.functions import citations as C
    from foliospark.functions import plugins

    asked = questions.where(F.trim(question) != "").select(question_id, F.trim(question).alias("__q"))
    q = asked.select(question_id, embed(F.col("__q")).alias("embedding"))
    hits = top_k(q, vectors, question_id, chunk_id, "embedding", k, exclude_self=False)
    full = hits.join(mapping, chunk_id)
    if reranker is not None:
        full = plugins.score_pairs(full.join(asked, question_id), "__q", "text", reranker, "reranker_score").drop("__q")
        full = rerank(full, question_id, F.col("reranker_score"), keep or k).drop("rank").withColumnRenamed("new_rank", "rank")
    elif keep is not None:
        full = full.where(F.col("rank") <= keep)
    header = C.context_header(F.col("section_title"), F.col("page"))
    body = F.when(header != "", F.concat(header, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    ranked = full.select(question_id, F.struct("rank", F.col(chunk_id).alias("id"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), body).alias("context"), C.source_ref(F.col("source_path"), F.col("page")).alias("source"), "score").alias("h"))
    one = ranked.groupBy(question_id).agg(F.array_sort(F.collect_list("h")).alias("h")).join(asked, question_id)  # at most k hits each
    fits = F.aggregate("h.context", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("stop")), lambda s, x: F.struct((s["used"] + F.length(x) + 2).alias("used"), (s["n"] + (~s["stop"] & (s["used"] + F.length(x) + 2 <= max_chars)).cast("int")).alias("n"), (s["stop"] | (s["used"] + F.length(x) + 2 > max_chars)).alias("stop")), lambda s: s["n"])
    done = one.withColumn("prompt", C.rag_prompt(F.col("__q"), F.slice(F.col("h.context"), 1, fits))).select(question_id, "prompt", F.col("h.context").alias("contexts"), F.col("h.source").alias("sources"), F.col("h.id").alias("ids"), F.col("h.score").alias("scores"))
    return done if generator is None else plugins.generate(done, "prompt", generator)

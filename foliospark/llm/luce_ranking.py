"""Problem 5: one global ranking from pairwise comparisons.

Iterative Luce spectral ranking: from the current strengths, the rate at which
the chain moves from a loser i to a winner j is (wins of j over i) / (s_i + s_j);
the stationary distribution of that chain gives the next strengths, and at the
fixed point they are the maximum-likelihood strengths of the Bradley-Terry-Luce
model. A tie is half a win for each.

Comparisons are reduced to one row per ordered pair of items before anything
leaves the executors. Up to ``dense_items`` items the chain is solved on the
driver (that many squared doubles). Beyond it the pairs stay a table: in each step
the rates are rebuilt and every item's stationary equation (what flows in equals
what flows out) is solved for its own strength; steps are extrapolated from the
last ones (Anderson) and end when no log strength moves by more than ``tol``. Both
ways reach the same strengths.

Where some item never won or never lost, the likelihood has no maximum. Every
item therefore also plays ``prior`` of a win and a loss against one virtual
item, which also joins items that met nobody; with the small default it moves
strengths that are determined by data by about as little.

Defined results: an item without comparisons gets the strength of the virtual
item; comparisons of an item with itself, undecided ones, and ones with an
unknown name say nothing; rows delivered twice count once; equal strengths are
ranked by name; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.scale import HOT_SHARE, MAX_SALTS, cut, numbered, release


def name_key(name: Column) -> Column:
    """A name's letters and digits in lower case, by which its spellings meet."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def decided(matches: DataFrame, id_col: str, winner: str, a: str, b: str) -> DataFrame:
    """(ka, kb, score_a): one row per decided match of two different items."""
    w = F.regexp_replace(F.lower(F.col(winner)), r"[^\p{L}]+", "")
    score = F.when(w.isin("a", "wina", "modela"), 1.0).when(w.isin("b", "winb", "modelb"), 0.0).when(w.isin("tie", "draw"), 0.5)
    return (
        matches.select(F.col(id_col).alias("id"), name_key(F.col(a)).alias("ka"), name_key(F.col(b)).alias("kb"), score.alias("score_a"))
        .where("score_a is not null and ka <> kb")
        .groupBy("id")
        .agg(F.max_by(F.struct("ka", "kb", "score_a"), F.struct("ka", "kb", "score_a")).alias("m"))
        .select("m.*")
    )


def pair_wins(games: DataFrame) -> DataFrame:
    """(winner, loser, w): summed scores per ordered pair."""
    two = games.select(F.explode(F.array(F.struct(F.col("ka").alias("winner"), F.col("kb").alias("loser"), F.col("score_a").alias("w")), F.struct(F.col("kb").alias("winner"), F.col("ka").alias("loser"), (1 - F.col("score_a")).alias("w")))).alias("x")).select("x.*")
    return two.where("w > 0").groupBy("winner", "loser").agg(F.sum("w").alias("w"))


def ilsr(wins: np.ndarray, tol: float = 1e-10, max_iter: int = 10000) -> np.ndarray:
    """Maximum-likelihood strengths (mean 1) from wins[i, j] = wins of i over j; the win graph must be strongly connected."""
    n = len(wins)
    s = np.ones(n)
    for _ in range(max_iter):
        rate = (wins / (s[:, None] + s[None, :])).T  # from loser to winner
        np.fill_diagonal(rate, 0.0)
        q = rate - np.diag(rate.sum(1))
        lhs = np.vstack([q.T[:-1], np.ones(n)])
        rhs = np.zeros(n)
        rhs[-1] = n
        new = np.clip(np.linalg.solve(lhs, rhs), 1e-300, None)
        done = np.max(np.abs(np.log(new) - np.log(s))) < tol
        s = new
        if done:
            break
    return s


def _salts(n: Column, total: Column) -> Column:
    return F.least(F.ceil(n * HOT_SHARE / total), F.lit(MAX_SALTS)).cast("int")


def _adjacency(wins: DataFrame) -> DataFrame:
    """(i, j, won, lost): both sides of every pair."""
    sides = wins.select(F.explode(F.array(F.struct(F.col("winner").alias("i"), F.col("loser").alias("j"), F.col("w").alias("won"), F.lit(0.0).alias("lost")), F.struct(F.col("loser").alias("i"), F.col("winner").alias("j"), F.lit(0.0).alias("won"), F.col("w").alias("lost")))).alias("x")).select("x.*")
    return sides.groupBy("i", "j").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))


def _history(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each strength's step is (logarithms), and the last k changes of the strengths and of their steps."""
    f = (pdf["g"] - pdf["x"]).to_numpy()
    dx, df = np.zeros((len(pdf), k)), np.zeros((len(pdf), k))
    if k:
        dx[:, 0], df[:, 0] = pdf["x"] - pdf["x0"], f - pdf["f0"].to_numpy()
        if k > 1:
            dx[:, 1:] = np.array([v[: k - 1] for v in pdf["dx"]])
            df[:, 1:] = np.array([v[: k - 1] for v in pdf["df"]])
    return f, dx, df


def _moments(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Extremes of the steps, and products of their changes with each other and with the steps."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                f, _, df = _history(pdf, k)
                yield pd.DataFrame({"low": [f.min()], "high": [f.max()], "gram": [(df.T @ df).ravel()], "rhs": [df.T @ f]})

    return run


def _advance(gamma: np.ndarray, memory: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The extrapolated strengths and their history."""
    k = len(gamma)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            f, dx, df = _history(pdf, k)
            yield pd.DataFrame({"item": pdf["item"], "salts": pdf["salts"], "x": pdf["x"] + f - (dx + df) @ gamma, "dx": list(dx), "df": list(df), "f0": f, "x0": pdf["x"]})

    return run


def _spectral_on_cluster(items: DataFrame, wins: DataFrame, prior: float, tol: float, max_steps: int, memory: int = 4) -> DataFrame:
    """(item, strength): strengths of mean logarithm 0, with the pairs as a table."""
    names = items.select(F.col("key").alias("item")).distinct()
    virtual = names.select(F.explode(F.array(F.struct(F.col("item").alias("winner"), F.lit("").alias("loser")), F.struct(F.lit("").alias("winner"), F.col("item").alias("loser")))).alias("x")).select("x.*", F.lit(prior).alias("w"))
    adj = cut(_adjacency(wins.unionByName(virtual)))
    degree = adj.groupBy("i").agg(F.count("*").alias("n"))
    salts = degree.select(F.col("i").alias("item"), _salts(F.col("n"), adj.agg(F.count("*")).scalar()).alias("salts"))
    salts = cut(salts)
    own = adj.join(salts.select(F.col("item").alias("i"), F.col("salts").alias("a")), "i").join(salts.select(F.col("item").alias("j"), F.col("salts").alias("b")), "j")
    salted = cut(own.select("i", "j", "won", "lost", F.pmod(F.xxhash64("j"), F.col("a")).cast("int").alias("si"), F.pmod(F.xxhash64("i"), F.col("b")).cast("int").alias("sj")), adj)
    schema = "item string, salts int, x double, dx array<double>, df array<double>, f0 double, x0 double"
    state = cut(salts.select("item", "salts", F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("dx"), F.array().cast("array<double>").alias("df"), F.lit(None).cast("double").alias("f0"), F.lit(None).cast("double").alias("x0")))
    for step in range(max_steps):
        spread = state.select("item", F.exp("x").alias("s"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        flows = (
            salted.join(spread.select(F.col("item").alias("j"), F.col("salt").alias("sj"), F.col("s").alias("s_j")), ["j", "sj"])
            .join(spread.select(F.col("item").alias("i"), F.col("salt").alias("si"), F.col("s").alias("s_i")), ["i", "si"])
            .groupBy(F.col("i").alias("item"))
            .agg(F.log(F.sum(F.col("won") * F.col("s_j") / (F.col("s_i") + F.col("s_j"))) / F.sum(F.col("lost") / (F.col("s_i") + F.col("s_j")))).alias("g"))
        )
        new = cut(state.join(flows, "item"), loop=True)
        k = min(step, memory)
        parts = new.mapInPandas(_moments(k), "low double, high double, gram array<double>, rhs array<double>").collect()  # a few numbers per partition
        move = max(p["high"] for p in parts) - min(p["low"] for p in parts)
        gamma = np.zeros(k)
        if k and move >= tol:
            gram = np.sum([p["gram"] for p in parts], axis=0).reshape(k, k)
            gamma = np.linalg.lstsq(gram + 1e-14 * np.trace(gram) * np.eye(k), np.sum([p["rhs"] for p in parts], axis=0), rcond=None)[0]
        state = cut(new.mapInPandas(_advance(gamma, memory), schema), new, state, loop=True)
        if move < tol:
            break
    else:
        warnings.warn(f"strengths still move by {move:.2g} after {max_steps} steps", RuntimeWarning, stacklevel=2)
    release(salted, salts)
    mean = state.where("item <> ''").agg(F.avg("x")).first()[0] or 0.0
    return state.where("item <> ''").select("item", F.exp(F.col("x") - F.lit(mean)).alias("strength"))


def rank(matches: DataFrame, items: DataFrame, item_col: str = "model_name", id_col: str = "match_id", winner: str = "winner", a: str = "model_a", b: str = "model_b", prior: float = 1e-3, dense_items: int = 2000, tol: float = 1e-9, max_steps: int = 1000) -> DataFrame:
    """(item_col, strength, games, model_rank): every item of ``items``, rank 1 the strongest; strengths have mean logarithm 0."""
    spark = matches.sparkSession
    names = items.where(F.col(item_col).isNotNull()).groupBy(name_key(F.col(item_col)).alias("key")).agg(F.min(item_col).alias(item_col))
    wins = pair_wins(decided(matches, id_col, winner, a, b))
    known = wins.join(names.select(F.col("key").alias("winner")), "winner", "left_semi").join(names.select(F.col("key").alias("loser")), "loser", "left_semi")
    n = names.count()
    if n <= dense_items:
        keys = [r["key"] for r in names.select("key").orderBy("key").collect()]
        at = {k: i for i, k in enumerate(keys)}
        m = np.zeros((n + 1, n + 1))
        m[:n, n] = m[n, :n] = prior
        pairs = known.toPandas()  # at most dense_items squared rows
        np.add.at(m, (pairs["winner"].map(at).to_numpy(dtype=int), pairs["loser"].map(at).to_numpy(dtype=int)), pairs["w"].to_numpy(dtype=float))
        s = ilsr(m)[:n]
        s = s / np.exp(np.log(s).mean()) if n else s
        games = m[:n, :n].sum(0) + m[:n, :n].sum(1)
        solved = spark.createDataFrame([(k, float(x), float(g)) for k, x, g in zip(keys, s, games, strict=True)], "key string, strength double, games double")
    else:
        known = cut(known)
        played = known.select(F.explode(F.array("winner", "loser")).alias("key"), "w").groupBy("key").agg(F.sum("w").alias("games"))
        solved = _spectral_on_cluster(names, known, prior, tol, max_steps).withColumnRenamed("item", "key").join(played, "key", "left").select("key", "strength", F.coalesce("games", F.lit(0.0)).alias("games"))
    ranked = names.join(solved, "key").withColumn("strength", F.round("strength", 9)).withColumn("__down", -F.col("strength"))
    return numbered(ranked, "model_rank", "__down", item_col).select(item_col, "strength", "games", F.col("model_rank").cast("int").alias("model_rank"))


def found(matches: DataFrame, items: DataFrame) -> DataFrame:
    """(model_name, model_rank)."""
    return rank(matches, items).select("model_name", "model_rank")

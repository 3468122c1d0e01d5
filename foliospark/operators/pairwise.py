"""Tournaments: pairs, synthetic comparisons, head-to-head, position bias, ELO (O-147..O-153, O-178..O-180, O-197..O-202)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K_FACTOR, INITIAL, TIE = 32.0, 1500.0, 0.5
#: A resampled tournament is laid out in blocks of so many games.
BLOCK_GAMES = 100_000


def expected_score(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def clean_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "_", "-")


def clean_winner(winner: Column) -> Column:
    w = F.lower(F.trim(winner))
    return F.when(w == "a", "win_a").when(w == "b", "win_b").when(w == "tie", "tie")


def comparisons(matches: DataFrame, id_col: str = "match_id") -> DataFrame:
    """(id_col, task_id, model_a, model_b, outcome, ord): decided matches of two models, one row per id, in order of judgement."""
    rows = matches.select(id_col, "task_id", clean_name(F.col("model_a")).alias("model_a"), clean_name(F.col("model_b")).alias("model_b"), clean_winner(F.col("winner")).alias("outcome"), F.col("judged_at").alias("ord"))
    return rows.where("outcome is not null and model_a <> model_b").groupBy(id_col).agg(*(F.min(c).alias(c) for c in ("task_id", "model_a", "model_b", "outcome", "ord")))


def model_pairs(responses: DataFrame, task: str, model: str) -> DataFrame:
    """(task, model_a, model_b): unordered pairs of different models that answered the same task."""
    r = responses.select(F.col(task).alias("task"), F.col(model).alias("m")).distinct()
    return r.alias("x").join(r.alias("y"), "task").where("x.m < y.m").select("task", F.col("x.m").alias("model_a"), F.col("y.m").alias("model_b"))


def synthetic(scores: DataFrame, task: str, model: str, score: str, margin: float = 0.1) -> DataFrame:
    """Comparisons from scores: the higher one wins if it leads by more than the margin."""
    s = scores.groupBy(F.col(task).alias("task"), F.col(model).alias("m")).agg(F.avg(score).alias("s"))
    d = F.round(F.col("x.s") - F.col("y.s"), 9)
    return s.alias("x").join(s.alias("y"), "task").where("x.m < y.m").select("task", F.col("x.m").alias("model_a"), F.col("y.m").alias("model_b"), F.when(d > margin, "win_a").when(d < -margin, "win_b").otherwise("tie").alias("outcome"))


def win_counts(games: DataFrame) -> DataFrame:
    """(model, games, wins, losses, ties, win_rate); a tie is half a win."""
    sides = games.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("outcome").alias("o"), F.lit("win_a").alias("w")), F.struct(F.col("model_b").alias("model"), F.col("outcome").alias("o"), F.lit("win_b").alias("w")))).alias("s")).select("s.*")
    c = sides.groupBy("model").agg(F.count("*").alias("games"), F.count_if(F.col("o") == F.col("w")).alias("wins"), F.count_if(F.col("o") == "tie").alias("ties"))
    return c.select("model", "games", "wins", (F.col("games") - F.col("wins") - F.col("ties")).alias("losses"), "ties", F.round((F.col("wins") + 0.5 * F.col("ties")) / F.col("games"), 6).alias("win_rate"))


def head_to_head(games: DataFrame) -> DataFrame:
    """(model, opponent, wins, losses, ties) both ways round."""
    flip = F.when(F.col("outcome") == "win_a", "win_b").when(F.col("outcome") == "win_b", "win_a").otherwise("tie")
    both = games.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("model_b").alias("opponent"), F.col("outcome").alias("o")), F.struct(F.col("model_b").alias("model"), F.col("model_a").alias("opponent"), flip.alias("o")))).alias("s")).select("s.*")
    return both.groupBy("model", "opponent").agg(F.count_if(F.col("o") == "win_a").alias("wins"), F.count_if(F.col("o") == "win_b").alias("losses"), F.count_if(F.col("o") == "tie").alias("ties"))


def position_bias(matches: DataFrame, first: Column, winner: Column) -> DataFrame:
    """(wins_first, wins_second, ties, z): whether the answer shown first wins more often than not."""
    o = matches.select(F.when(winner == "tie", "tie").when(winner == first, "first").when(winner.isNotNull() & first.isNotNull(), "second").alias("o"))
    c = o.agg(F.count_if(F.col("o") == "first").alias("wins_first"), F.count_if(F.col("o") == "second").alias("wins_second"), F.count_if(F.col("o") == "tie").alias("ties"))
    n = F.col("wins_first") + F.col("wins_second")
    return c.withColumn("z", F.round(F.when(n > 0, (F.col("wins_first") - n / 2) / F.sqrt(n / 4)).otherwise(0.0), 6))


def _fold(games: pd.DataFrame, r: dict[str, float], k: float = K_FACTOR, initial: float = INITIAL, tie: float = TIE) -> None:
    """Update the ratings ``r`` by games in order."""
    for a, b, o in zip(games["model_a"], games["model_b"], games["outcome"], strict=True):
        ra, rb = r.get(a, initial), r.get(b, initial)
        e = 1 / (1 + math.pow(10, (rb - ra) / 400))
        s = 1.0 if o == "win_a" else 0.0 if o == "win_b" else tie
        r[a], r[b] = ra + k * (s - e), rb + k * (e - s)


def elo(games: DataFrame, group: str | None = None, order: tuple[str, ...] = ("ord", "match_id"), k: float = K_FACTOR, initial: float = INITIAL, tie: float = TIE, start: dict[str, float] | None = None) -> DataFrame:
    """(tournament, model, rating): ratings after all games in order, one sequential fold per group; ``start`` holds earlier ratings.

    The update depends on everything before it, so a group is one task by
    definition; several tournaments run side by side. A group streams through
    the task sorted, batch by batch, and only ratings are held.
    """
    rows = games.withColumn("__g", F.lit("all") if group is None else F.col(group).cast("string")).select("__g", *order, "model_a", "model_b", "outcome")
    parts = rows.repartition("__g").sortWithinPartitions("__g", *order)

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: str | None = None
        r: dict[str, float] = dict(start or {})
        out: list[tuple[str, str, float]] = []
        for pdf in it:
            for g, a, b, o in zip(pdf["__g"], pdf["model_a"], pdf["model_b"], pdf["outcome"], strict=True):
                if g != at:
                    out += [(at, m, x) for m, x in r.items()] if at is not None else []
                    at, r = g, dict(start or {})
                ra, rb = r.get(a, initial), r.get(b, initial)
                e = 1 / (1 + math.pow(10, (rb - ra) / 400))
                s = 1.0 if o == "win_a" else 0.0 if o == "win_b" else tie
                r[a], r[b] = ra + k * (s - e), rb + k * (e - s)
        out += [(at, m, x) for m, x in r.items()] if at is not None else []
        yield pd.DataFrame(out, columns=["tournament", "model", "rating"])

    return parts.mapInPandas(fold, "tournament string, model string, rating double").withColumn("rating", F.round("rating", 6))


def bootstrap(counts: DataFrame, rounds: int = 200, seed: int = 7, confidence: float = 0.95) -> DataFrame:
    """(model, lower, upper): confidence bounds of ratings from resampled games.

    Games are reduced to counts per (model_a, model_b, outcome); each round draws
    a multinomial sample of them and folds it in a seeded order. Rounds are
    spread over tasks; what travels to each is the count table, whose size is
    models squared and independent of the number of games.
    """
    spark = counts.sparkSession
    table = counts.toPandas().sort_values(["model_a", "model_b", "outcome"]).reset_index(drop=True)
    if table.empty:
        return spark.createDataFrame([], "model string, lower double, upper double")
    state = spark.sparkContext.broadcast(table)

    def draw(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = state.value
        p = (t["n"] / t["n"].sum()).to_numpy()
        for pdf in it:
            rows = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                left = rng.multinomial(int(t["n"].sum()), p)
                ratings: dict[str, float] = {}
                while left.sum():  # a random order, laid out block by block
                    take = rng.multivariate_hypergeometric(left, min(BLOCK_GAMES, int(left.sum())), method="marginals")
                    left = left - take
                    picks = np.repeat(np.arange(len(t)), take)
                    rng.shuffle(picks)
                    _fold(t.iloc[picks], ratings)
                rows += list(ratings.items())
            yield pd.DataFrame(rows, columns=["model", "rating"])

    r = spark.range(rounds).repartition(max(1, rounds // 10)).mapInPandas(draw, "model string, rating double")
    a = (1 - confidence) / 2
    return r.groupBy("model").agg(F.round(F.percentile("rating", F.lit(a)), 3).alias("lower"), F.round(F.percentile("rating", F.lit(1 - a)), 3).alias("upper"))


def leaderboard(ratings: DataFrame, counts: DataFrame) -> DataFrame:
    """Ratings with game counts, best first; ties by name."""
    return ratings.join(counts, "model").orderBy(F.desc("rating"), "model")

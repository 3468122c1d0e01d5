"""Problem 2: one label per item from annotators who disagree.

Minimax conditional entropy: annotator i labels item j of true class c as k with
probability proportional to exp(tau_j[c,k] + sigma_i[c,k]). The dual is fitted by
coordinate ascent with quadratic penalties (alpha on sigma, beta on tau),
alternating with the label posteriors; beta is alpha times labels per annotator
over labels per item, as in the published heuristics, so items with few votes
barely tilt. Class shares are estimated along the way.

Scale: votes are reduced to one row per (item, annotator, label) and gathered
per item once - an item holds at most annotators x classes entries however many
rows it has. Given sigma, tau and the posterior of an item depend on its own
votes only and are solved to the end within the pass, so an iteration is one pass
that keeps no state per item and returns sums per annotator that its task met; steps
in sigma are extrapolated from the last ones (Anderson), until none moves; sigma (annotators x classes squared) is the only shared
state. Up to ``max_annotators`` it is broadcast; beyond that it stays a table that
is joined with the votes in every iteration, and nothing per annotator reaches
the driver.

Defined results: unknown labels, null annotators and failed attempts are no
votes; an item without votes gets the most frequent class, no agreement and the
class shares as posterior; equal posteriors go to the first class; null items
are left out; rows delivered twice count once; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.scale import cut, salted_join

VERDICTS = ("win_a", "win_b", "tie")


def clean_label(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def gather(df: DataFrame, item: str, annotator: str, label: str, failed: Column, classes: tuple[str, ...]) -> DataFrame:
    """(item, votes array<struct<a string, k int>>): one row per item; items without votes have an empty array."""
    k = F.when(~failed, F.array_position(F.array(*(F.lit(c) for c in classes)), clean_label(F.col(label))).cast("int") - 1)
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.trim(F.col(annotator)).alias("a"), k.alias("k"))
    # Hot items and annotators shrink here, map-side, to distinct entries.
    once = rows.withColumn("ok", F.col("a").isNotNull() & (F.col("k") >= 0)).groupBy("item", F.when(F.col("ok"), F.col("a")).alias("a"), F.when(F.col("ok"), F.col("k")).alias("k")).agg(F.lit(1).alias("one"))
    return once.groupBy("item").agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull() & F.col("k").isNotNull(), F.struct("a", "k")))).alias("votes"))


def _flat(batch: pa.RecordBatch, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item number, annotator number and label of every vote of a batch."""
    votes = batch.column("votes")
    j = np.repeat(np.arange(len(votes)), pc.fill_null(pc.list_value_length(votes), 0).to_numpy(zero_copy_only=False))
    flat = votes.flatten()
    a = pc.index_in(flat.field("a"), value_set=names).to_numpy(zero_copy_only=False)
    return j, a.astype(np.int64), flat.field("k").to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` (any shape behind the first axis) added up by ``index``."""
    flat = values.reshape(len(index), -1)
    return np.stack([np.bincount(index, weights=flat[:, c], minlength=n) for c in range(flat.shape[1])], 1).reshape(n, *values.shape[1:])


def _solve_items(n: int, j: np.ndarray, a: np.ndarray, k: np.ndarray, sigma: np.ndarray, share: np.ndarray, beta: float, rounds: int, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n x C) and each vote's label distribution per true class (votes x C x C), given sigma.

    Tilts of the items start at zero and ascend, in turn with the posteriors,
    until none moves by more than ``tol``: both are functions of sigma, so nothing
    is kept between iterations.
    """
    c = len(share)
    tau = np.zeros((n, c, c))
    counts = _sums(j, np.eye(c)[k], n)
    total = counts.sum(1)[:, None, None]
    post = np.tile(share, (n, 1))
    p = np.zeros((len(j), c, c))
    rows = np.arange(len(j))
    for _ in range(rounds):
        z = tau[j] + sigma[a]
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        ll = _sums(j, np.log(np.clip(p[rows, :, k], 1e-12, None)), n) + np.log(share)
        ll -= ll.max(1, keepdims=True)
        post = np.exp(ll)
        post /= post.sum(1, keepdims=True)
        grad = post[:, :, None] * (counts[:, None, :] - _sums(j, p, n)) - beta * tau
        step = grad / (post[:, :, None] * total * 0.5 + beta)
        tau += step
        if np.abs(step).max(initial=0.0) < tol:
            break
    return post, p


def _start(c: int) -> np.ndarray:
    """Tilts of an annotator who is right in seven cases of ten."""
    rest = 0.3 / max(1, c - 1)
    s = np.log(np.full((c, c), rest) + np.eye(c) * (0.7 - rest))
    return s - s.mean(1, keepdims=True)


def _batch_sums(n: int, j: np.ndarray, k: np.ndarray, own: np.ndarray, tilts: np.ndarray, share: np.ndarray, beta: float, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vote: posterior weight on the label given, and on each label expected (votes x C x C each); summed posteriors of the items."""
    c = len(share)
    post, p = _solve_items(n, j, own, k, tilts, share, beta, rounds)
    w = post[j]
    return w[:, :, None] * np.eye(c)[k][:, None, :], w[:, :, None] * p, post[np.unique(j)].sum(0)


def _advance(sigma: np.ndarray, given: np.ndarray, expected: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """One ascent step of the dual in the annotators' tilts, and its largest move."""
    step = (given - expected - alpha * sigma) / (expected + alpha)
    return sigma + np.clip(step, -1.0, 1.0), float(np.abs(step).max()) if step.size else 0.0


class _Extrapolation:
    """Anderson extrapolation of a fixed-point iteration from its last ``memory`` steps."""

    def __init__(self, memory: int = 5) -> None:
        self.memory = memory
        self.points: list[np.ndarray] = []
        self.steps: list[np.ndarray] = []

    def next(self, x: np.ndarray, step: np.ndarray) -> np.ndarray:
        self.points = [*self.points, x][-self.memory - 1 :]
        self.steps = [*self.steps, step][-self.memory - 1 :]
        if len(self.steps) < 2:
            return x + step
        dx, df = np.diff(self.points, axis=0).T, np.diff(self.steps, axis=0).T
        gram = df.T @ df
        gamma = np.linalg.lstsq(gram + 1e-12 * np.trace(gram) * np.eye(len(gram)), df.T @ step, rcond=None)[0]
        return x + step - (dx + df) @ gamma


def fit(items: DataFrame, classes: tuple[str, ...], gamma: float = 0.25, iterations: int = 200, rounds: int = 50, tol: float = 1e-3, max_annotators: int = 100_000) -> dict:
    """Tilts, class shares and settings from a gathered, materialised table of items.

    Iterates until no tilt or share moves by more than ``tol``; ``moved`` and
    ``iterations`` of the result tell how it ended, and a warning is given where
    ``iterations`` did not suffice.
    """
    c = len(classes)
    per = items.select(F.explode("votes").alias("v")).groupBy(F.col("v.a").alias("a")).agg(F.count("*").alias("n"))
    size = per.agg(F.count("*").alias("j"), F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()
    n_items = items.where(F.size("votes") > 0).count()
    alpha = gamma * c * c
    beta = alpha * (size["v"] / max(1, size["j"])) / max(1.0, size["v"] / max(1, n_items))
    model = {"beta": beta, "classes": classes, "rounds": rounds, "share": np.full(c, 1.0 / c)}
    if size["j"] > max_annotators:
        return _fit_joined(items, per, model, alpha, iterations, tol)
    names = [r["a"] for r in per.select("a").orderBy("a").collect()]  # at most max_annotators
    sigma, share = np.tile(_start(c), (len(names), 1, 1)), model["share"]
    cols = [f"s{i}" for i in range(2 * c * c)]
    schema = "a int, " + ", ".join(f"{x} double" for x in cols)
    ahead, moved, step = _Extrapolation(), 0.0, 0
    for step in range(1, (iterations if names else 0) + 1):
        state = items.sparkSession.sparkContext.broadcast((sigma, share, names))

        def sums(it: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            sg, sh, known = state.value
            values = pa.array(known, pa.string())
            both, seen, total = np.zeros((len(known), 2 * c * c)), np.zeros(len(known), dtype=bool), np.zeros(c)
            for batch in it:
                j, a, k = _flat(batch, values)
                if len(j):
                    g, e, t = _batch_sums(batch.num_rows, j, k, a, sg, sh, beta, rounds)
                    both += _sums(a, np.concatenate([g.reshape(len(j), -1), e.reshape(len(j), -1)], 1), len(known))
                    seen[a] = True
                    total += t
            at = np.flatnonzero(seen)  # only annotators that this task met
            out = np.vstack([both[at], np.concatenate([total, np.zeros(len(cols) - c)])])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), *(pa.array(out[:, i]) for i in range(len(cols)))], names=["a", *cols])

        got = items.select("votes").mapInArrow(sums, schema).groupBy("a").agg(*(F.sum(x).alias(x) for x in cols)).collect()  # one row per annotator
        state.destroy()
        got = np.array(sorted(map(tuple, got)), dtype=float)
        body = got[1:, 1:]
        forward, _ = _advance(sigma, body[:, : c * c].reshape(-1, c, c), body[:, c * c :].reshape(-1, c, c), alpha)
        total = got[0, 1 : 1 + c]
        new_share = (total + 1.0) / (total.sum() + c)
        x = np.concatenate([sigma.ravel(), np.log(share)])
        move = np.concatenate([forward.ravel(), np.log(new_share)]) - x
        moved = float(np.abs(move).max())
        x = ahead.next(x, move)
        sigma, share = x[:-c].reshape(sigma.shape), np.exp(x[-c:]) / np.exp(x[-c:]).sum()
        if moved < tol:
            break
    _report(moved, tol, step)
    return model | {"names": names, "sigma": sigma, "share": share, "moved": moved, "iterations": step}


def _report(moved: float, tol: float, step: int) -> None:
    if moved >= tol:
        warnings.warn(f"tilts still move by {moved:.2g} after {step} iterations", RuntimeWarning, stacklevel=3)


def _joined(items: DataFrame, table: DataFrame) -> DataFrame:
    """(item, votes array<struct<a, k, s>>): votes with their annotators' tilts; annotators of very many votes are spread over salts."""
    v = items.select("item", F.explode("votes").alias("v")).select("item", F.col("v.a").alias("a"), F.col("v.k").alias("k"))
    rows = salted_join(v, table.select("a", "s", "n"), "a", "n", F.col("item"))
    return rows.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("a", "k", "s"))).alias("votes"))


def _flat_joined(pdf: pd.DataFrame, c: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Item number, annotator, label and tilts of every vote of a batch."""
    flat = [(n, v["a"], v["k"], v["s"]) for n, votes in enumerate(pdf["votes"]) for v in votes]
    tilts = np.array([f[3] for f in flat], dtype=float).reshape(-1, c, c)
    return np.array([f[0] for f in flat], dtype=np.int64), [f[1] for f in flat], np.array([f[2] for f in flat], dtype=np.int64), tilts


def _fit_joined(items: DataFrame, per: DataFrame, model: dict, alpha: float, iterations: int, tol: float) -> dict:
    """The same iterations with the tilts as a table."""
    c = len(model["classes"])
    beta, rounds = model["beta"], model["rounds"]
    start = F.array(*(F.lit(float(x)) for x in _start(c).ravel()))
    table, share = cut(per.select("a", "n", start.alias("s"))), model["share"]
    cols = [f"s{i}" for i in range(2 * c * c)]
    schema = "a string, " + ", ".join(f"{x} double" for x in cols)
    moved, step = 0.0, 0
    for step in range(1, iterations + 1):
        now = share

        def sums(it: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for pdf in it:
                j, a, k, tilts = _flat_joined(pdf, c)
                if len(j):
                    g, e, t = _batch_sums(len(pdf), j, k, np.arange(len(j)), tilts, now, beta, rounds)
                    out = pd.DataFrame(np.hstack([g.reshape(len(j), -1), e.reshape(len(j), -1)]), columns=cols)
                    out.insert(0, "a", a)
                    yield out.groupby("a", as_index=False).sum()
                    yield pd.DataFrame([[None, *t, *[0.0] * (len(cols) - c)]], columns=["a", *cols])

        got = cut(_joined(items, table).mapInPandas(sums, schema).groupBy("a").agg(*(F.sum(x).alias(x) for x in cols)), loop=True)

        def ascend(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                body = pdf[cols].to_numpy(dtype=float)
                old = np.array(pdf["s"].tolist(), dtype=float).reshape(-1, c, c)
                new, _ = _advance(old, body[:, : c * c].reshape(-1, c, c), body[:, c * c :].reshape(-1, c, c), alpha)
                yield pd.DataFrame({"a": pdf["a"], "n": pdf["n"], "s": list(new.reshape(-1, c * c)), "moved": np.abs(new - old).max((1, 2))})

        total = np.array([got.where("a is null").first()[x] for x in cols[:c]], dtype=float)
        stepped = cut(table.join(got.where("a is not null"), "a").mapInPandas(ascend, "a string, n bigint, s array<double>, moved double"), got, table, loop=True)
        new_share = (total + 1.0) / (total.sum() + c)
        moved = max(stepped.agg(F.max("moved")).first()[0] or 0.0, np.abs(new_share - share).max())
        table, share = stepped, new_share
        if moved < tol:
            break
    _report(moved, tol, step)
    return model | {"table": table.select("a", "n", "s"), "share": share, "moved": moved, "iterations": step}


def consensus(items: DataFrame, model: dict) -> DataFrame:
    """(item, label, confidence, agreement, n_votes): agreement is the share of agreeing pairs of votes, null for under two."""
    c = len(model["classes"])
    table = model.get("table")
    state = items.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "table"})
    joined = table is not None
    rows = items.select("item", "votes")
    if joined:
        rows = items.select("item").join(_joined(items, table), "item", "left")

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = state.value
        values = None if joined else pa.array(m["names"], pa.string())
        for batch in it:
            n_rows = batch.num_rows
            if joined:
                pdf = batch.to_pandas()
                pdf["votes"] = [v if v is not None else [] for v in pdf["votes"]]
                j, names, k, tilts = _flat_joined(pdf, c)
                a = np.arange(len(names))
            else:
                j, a, k = _flat(batch, values)
                tilts = m["sigma"]
            post = np.tile(m["share"], (n_rows, 1))
            counts = np.zeros((n_rows, c))
            if len(j):
                got, _ = _solve_items(n_rows, j, a, k, tilts, m["share"], m["beta"], m["rounds"])
                has = np.unique(j)
                post[has] = got[has]
                counts = _sums(j, np.eye(c)[k], n_rows)
            n = counts.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                agree = (counts * (counts - 1)).sum(1) / (n * (n - 1))
            best = post.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(np.array(m["classes"], dtype=object)[best], pa.string()), pa.array(post[np.arange(n_rows), best]), pa.array(agree, mask=n < 2), pa.array(n.astype(np.int64))],
                names=["item", "label", "confidence", "agreement", "n_votes"],
            )

    return rows.mapInArrow(label, "item string, label string, confidence double, agreement double, n_votes bigint")


def reliability(items: DataFrame, model: dict) -> DataFrame:
    """(annotator, reliability, n_votes): chance that the annotator names the true class of an item without a tilt of its own."""
    c = len(model["classes"])
    share = model["share"]

    def chance(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(2, keepdims=True))
        return np.einsum("icc,c->i", p / p.sum(2, keepdims=True), share)

    if "table" in model:

        def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                z = np.array(pdf["s"].tolist(), dtype=float).reshape(-1, c, c)
                yield pd.DataFrame({"annotator": pdf["a"], "reliability": chance(z), "n_votes": pdf["n"]})

        return model["table"].mapInPandas(score, "annotator string, reliability double, n_votes bigint")
    acc = chance(model["sigma"]) if model["names"] else np.zeros(0)
    rows = items.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(model["names"], acc, strict=True)], "annotator string, reliability double")
    votes = items.select(F.explode("votes").alias("v")).groupBy(F.col("v.a").alias("annotator")).agg(F.count("*").alias("n_votes"))
    return rows.join(votes, "annotator")


def judgments_model(judgments: DataFrame) -> tuple[DataFrame, dict]:
    failed = F.coalesce(F.trim("error") != "", F.lit(False)) | F.col("verdict").isNull()
    spark = judgments.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = cut(gather(judgments, "pair_id", "judge_name", "verdict", failed, VERDICTS).repartition(tasks))  # every iteration is bound by CPU, not by bytes
    return items, fit(items, VERDICTS)


def found(judgments: DataFrame) -> DataFrame:
    """(pair_id, verdict)."""
    items, model = judgments_model(judgments)
    return consensus(items, model).select(F.col("item").alias("pair_id"), F.col("label").alias("verdict"))

"""Registry of model-backed steps with deterministic stand-ins (O-250..O-256)."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Batch = Callable[[list[str]], list[str]]
_GENERATORS: dict[str, Callable[[], Batch]] = {}


def register_generator(name: str, factory: Callable[[], Batch]) -> None:
    """``factory`` is called once per partition and returns a function from prompts to answers."""
    _GENERATORS[name] = factory


def _extract() -> Batch:
    """Stand-in: the first context line of a prompt, with its marker."""

    def run(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            line = next((x for x in p.split("\n") if x.startswith("[1]")), "")
            out.append(f"{line[3:].strip()} [1]" if line else "No context was given.")
        return out

    return run


register_generator("extract", _extract)


PairBatch = Callable[[list[str], list[str]], list[float]]
_SCORERS: dict[str, Callable[[], PairBatch]] = {}
_JUDGES: dict[str, Callable[[], Batch]] = {}


def register_scorer(name: str, factory: Callable[[], PairBatch]) -> None:
    """A re-ranker: ``factory`` is called once per partition and returns a function from pairs of texts to scores."""
    _SCORERS[name] = factory


def register_judge(name: str, factory: Callable[[], Batch]) -> None:
    """A judge: ``factory`` is called once per partition and returns a function from prompts to raw answers."""
    _JUDGES[name] = factory


def _overlap() -> PairBatch:
    """Stand-in: share of the first text's words that stand in the second."""

    def run(first: list[str], second: list[str]) -> list[float]:
        out = []
        for a, b in zip(first, second, strict=True):
            wa, wb = set(re.findall(r"[a-z0-9]+", a.lower())), set(re.findall(r"[a-z0-9]+", b.lower()))
            out.append(round(len(wa & wb) / len(wa), 6) if wa else 0.0)
        return out

    return run


def _longer() -> Batch:
    """Stand-in: the longer of two responses wins; JSON as a judge would write it."""

    def run(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            a, b = p.split(RESPONSE_B, 1)
            a = a.split(RESPONSE_A, 1)[1]
            v = "tie" if len(a.strip()) == len(b.strip()) else "A" if len(a.strip()) > len(b.strip()) else "B"
            out.append('```json\n{"verdict": "%s", "confidence": "low"}\n```' % v)
        return out

    return run


#: Marks before the two responses of a judge's prompt.
RESPONSE_A, RESPONSE_B = "\nResponse A:\n", "\nResponse B:\n"
register_scorer("overlap", _overlap)
register_judge("longer", _longer)


def score_pairs(df: DataFrame, first: str, second: str, name: str = "overlap", out: str = "reranker_score") -> DataFrame:
    """Adds the scores of a registered re-ranker, Arrow batch by batch."""
    factory = _SCORERS[name]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in it:
            a, b = pdf[first].fillna("").tolist(), pdf[second].fillna("").tolist()
            yield pdf.assign(**{out: with_retries(lambda a=a, b=b: client(a, b))})

    return df.mapInPandas(run, f"{_ddl(df)}, `{out}` double")


def judge_pairs(df: DataFrame, question: str, a: str, b: str, swapped: Column, names: list[str]) -> DataFrame:
    """One row per row and judge: judge_name, raw_response, verdict; responses are shown in the order ``swapped`` says and verdicts turned back."""
    from foliospark.operators.dataset import unswap, verdict_of

    shown = lambda x, y: F.coalesce(F.when(swapped, F.col(y)).otherwise(F.col(x)), F.lit(""))
    prompt = F.concat(F.lit("Question: "), F.coalesce(F.col(question), F.lit("")), F.lit(RESPONSE_A), shown(a, b), F.lit(RESPONSE_B), shown(b, a))
    rows = df.withColumn("__swapped", swapped).withColumn("__prompt", prompt).withColumn("judge_name", F.explode(F.array(*(F.lit(n) for n in names))))
    factories = {n: _JUDGES[n] for n in names}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = {n: f() for n, f in factories.items()}
        for pdf in it:
            raw = pd.Series("", index=pdf.index, dtype=object)
            for n, part in pdf.groupby("judge_name"):
                raw[part.index] = with_retries(lambda n=n, p=part["__prompt"].tolist(): clients[n](p))
            yield pdf.assign(raw_response=raw)

    judged = rows.mapInPandas(run, f"{_ddl(rows)}, raw_response string")
    return judged.withColumn("verdict", unswap(verdict_of(F.col("raw_response")), F.col("__swapped"))).drop("__swapped", "__prompt")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def with_retries(call: Callable[[], list], attempts: int = 3, base: float = 0.5, cap: float = 300.0) -> list:
    """Call again after growing pauses; the last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if i == attempts - 1:
                raise
            time.sleep(min(cap, base * 2**i))
    raise RuntimeError("unreachable")


def generate(df: DataFrame, prompt: str, name: str = "extract", out: str = "answer") -> DataFrame:
    """Adds the answers of a registered generator, Arrow batch by batch."""
    factory = _GENERATORS[name]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in it:
            texts = pdf[prompt].fillna("").tolist()
            yield pdf.assign(**{out: with_retries(lambda t=texts: client(t))})

    return df.mapInPandas(run, f"{_ddl(df)}, `{out}` string")

"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's text is cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
QUOTED_LINE = re.compile(r"^[ \t]*>.*$", re.M)


@lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str = DEFAULT_TOKENIZER) -> list[int]:
    return [len(x) for x in encoder(path).encode_ordinary_batch(texts, num_threads=1)]


def context_ranges(text: str, path: str = DEFAULT_TOKENIZER) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of a text, and the ranges of tokens that lie in lines quoted with '>'."""
    tokens = encoder(path).encode_ordinary(text)
    if ">" not in text:
        return len(tokens), []
    ends = np.cumsum([len(b) for b in encoder(path).decode_tokens_bytes(tokens)])
    out: list[tuple[int, int]] = []
    for m in QUOTED_LINE.finditer(text):
        first, last = len(text[: m.start()].encode()), len(text[: m.end()].encode())
        s, e = int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, last, side="left")) + 1
        s = max(s, out[-1][1]) if out else s
        if s < min(e, len(tokens)):
            out.append((s, min(e, len(tokens))))
    return len(tokens), out


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id_col, *extra, tokens, loss_tokens, context) of every document with an id; null text has none.

    Lines quoted with '>' are context that bears no loss; ``context`` holds their
    ranges of tokens, so that the loss of any piece can be counted.
    """
    keep = [id_col, *extra]
    rows = docs.where(F.col(id_col).isNotNull()).select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint, loss_tokens bigint, context array<struct<s:bigint,e:bigint>>"

    def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf["__text"].tolist()
            total = count_tokens(texts, tokenizer)
            ranges = [context_ranges(t, tokenizer)[1] if ">" in t else [] for t in texts]
            out = pdf[keep].copy()
            out["tokens"] = total
            out["loss_tokens"] = [n - sum(e - s for s, e in r) for n, r in zip(total, ranges, strict=True)]
            out["context"] = [[{"s": s, "e": e} for s, e in r] for r in ranges]
            yield out

    return rows.mapInPandas(measure, schema)

"""Citation markers, contexts and grounding (O-064..O-069, O-087..O-091, O-070 prompts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import bound, words

# Wording of the prompts.
RAG_INSTRUCTIONS = "Answer the question using the provided context. Cite the sources inline as [#] based on the order of the snippets. If the answer is not in the context, say you don't know."
NO_CONTEXT_INSTRUCTIONS = "Answer the following question based on your knowledge. Do not include citations or source references as no sources are provided. Provide a clear and concise response."


def markers(answer: Column) -> Column:
    """Sorted distinct numbers of the [n] markers of a text."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())))


def _numbers(contexts: Column) -> Column:
    n = F.size(contexts)
    return F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def marker_presence(answer: Column, contexts: Column) -> Column:
    """Share of the markers [1]..[n] that the answer holds; null without contexts."""
    n = F.size(contexts)
    return F.when(n > 0, F.size(F.array_intersect(markers(answer), _numbers(contexts))) / n)


def number_contexts(contexts: Column) -> Column:
    """Contexts as they are if every one starts with a marker, else all numbered."""
    return F.when(F.forall(contexts, lambda x: x.rlike(r"^\s*\[\d+\]")), contexts).otherwise(F.transform(contexts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)))


def context_header(section: Column, page: Column) -> Column:
    """'Section: s | Page n', without what is missing."""
    return F.concat_ws(" | ", F.when(F.coalesce(F.trim(section), F.lit("")) != "", F.concat(F.lit("Section: "), section)), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("Page "), page.cast("string"))))


def source_ref(path: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(path, F.lit("#page="), page.cast("string"))).otherwise(path)


def _vocabulary(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9'\[\]]+"), F.lit(0)), lambda w: F.length(w) >= 4))


def verify(answer: Column, contexts: Column) -> dict[str, Column]:
    """Referenced, missing and extra markers; coverage per context is the share of the answer's words (4 letters or more, as a set) found in it."""
    ref, valid = markers(answer), _numbers(contexts)
    cover = bound({"a": _vocabulary(F.coalesce(answer, F.lit(""))), "c": contexts}, lambda s: F.transform(s["c"], lambda c: F.when(F.size(s["a"]) > 0, F.size(F.array_intersect(s["a"], _vocabulary(c))) / F.size(s["a"])).otherwise(0.0)))
    return {"referenced": F.array_intersect(ref, valid), "missing": F.array_except(valid, ref), "extra": F.array_except(ref, valid), "coverage": cover}


def evaluate(answer: Column, contexts: Column) -> dict[str, Column]:
    """As :func:`verify`, with coverage as the share of a context's word occurrences that the answer uses, markers stripped."""
    ref, valid = markers(answer), _numbers(contexts)
    strip = lambda t: F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(t, r"\[\d+\]", " ")), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.length(w) >= 4)
    found = lambda s, t: F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.array_contains(s["a"], w))) / F.size(t)).otherwise(0.0)
    cover = bound({"a": F.array_distinct(strip(F.coalesce(answer, F.lit("")))), "c": F.transform(contexts, strip)}, lambda s: F.transform(s["c"], lambda t: found(s, t)))
    return {"referenced": ref, "missing": F.array_except(valid, ref), "extra": F.array_except(ref, valid), "coverage": cover}


def precision(answer: Column, contexts: Column) -> Column:
    """Share of referenced markers that exist; 1 where nothing is referenced and nothing could be."""
    ref, valid = markers(answer), _numbers(contexts)
    return F.when(F.size(ref) == 0, F.when(F.size(valid) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(ref, valid)) / F.size(ref))


def recall(answer: Column, contexts: Column) -> Column:
    ref, valid = markers(answer), _numbers(contexts)
    return F.when(F.size(valid) == 0, F.when(F.size(ref) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(ref, valid)) / F.size(valid))


def grounded_fraction(answer: Column, contexts: Column, min_length: int = 3) -> Column:
    """Share of the answer's word occurrences that stand in some context; 0 without words or contexts."""
    toks = lambda t: F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9']+"), F.lit(0)), lambda w: F.length(w) >= min_length)
    values = {"a": toks(F.coalesce(answer, F.lit(""))), "c": F.array_distinct(F.flatten(F.transform(contexts, toks)))}
    share = bound(values, lambda s: F.size(F.filter(s["a"], lambda w: F.array_contains(s["c"], w))) / F.greatest(F.lit(1), F.size(s["a"])))
    return F.when(F.size(contexts) > 0, share).otherwise(0.0)


def context_jaccard(live: Column, stored: Column, prefix: int = 200) -> Column:
    """Jaccard similarity of two sets of contexts, compared by their first characters."""
    key = lambda a: F.array_distinct(F.transform(a, lambda x: F.substring(F.lower(F.trim(x)), 1, prefix)))
    both = F.size(F.array_union(key(live), key(stored)))
    return F.when(both > 0, F.size(F.array_intersect(key(live), key(stored))) / both).otherwise(0.0)


def rag_prompt(question: Column, contexts: Column, extra: str = "") -> Column:
    head = f"{RAG_INSTRUCTIONS} {extra.strip()}".strip()
    trimmed = F.transform(F.array_compact(contexts), lambda x: F.trim(x))
    block = F.when(F.size(contexts) > 0, F.array_join(number_contexts(trimmed), "\n\n")).otherwise("(No contexts provided)")
    return F.when(F.trim(question) != "", F.concat(F.lit(f"{head}\n\nContext:\n"), block, F.lit("\n\nQuestion: "), F.trim(question), F.lit("\nAnswer:")))


def instruction_prompt(question: Column) -> Column:
    return F.when(F.trim(question) != "", F.concat(F.lit("Question: "), F.trim(question), F.lit("\n\nAnswer:")))


def no_context_prompt(question: Column) -> Column:
    return F.when(F.trim(question) != "", F.concat(F.lit(f"{NO_CONTEXT_INSTRUCTIONS}\n\nQuestion: "), F.trim(question), F.lit("\n\nAnswer:")))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("bigint")

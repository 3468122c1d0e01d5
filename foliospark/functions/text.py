"""Column functions on text: words, normal forms, excerpts, coercions, paths (O-050..O-063, O-073, O-097, O-098)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other spellings of task types.
TASK_TYPE_ALIASES = {"question": "qa", "question_answer": "qa", "qna": "qa", "summary": "summaries", "summarization": "summaries", "citation": "citations", "contextual": "contextualizations", "contextualization": "contextualizations"}
TRUE_WORDS = ("true", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "no", "n", "0", "off")


def bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of values that are computed once, however often it names them."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use)[0]


def words(text: Column) -> Column:
    """Array of the words between any Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def normalise(text: Column) -> Column:
    """Trimmed, lower case, white space runs as one space."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(?U)\s+", " ")


def normalise_instruction(text: Column) -> Column:
    """As :func:`normalise`, without final question, full and exclamation marks."""
    return F.regexp_replace(normalise(text), "[?.!]+$", "")


def preview(text: Column, limit: int = 120) -> Column:
    """One line of at most ``limit`` characters, with an ellipsis where it is cut."""
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


def excerpt(text: Column, limit: int = 200) -> Column:
    """As :func:`preview`, but only line breaks become spaces."""
    s = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


def head_and_tail(text: Column, limit: int) -> Column:
    """The whole text, or its first and last halves of the limit."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n\n...\n\n"), F.right(text, F.lit(half))))


def canonical_id(canonical: Column, arxiv_id: Column) -> Column:
    """The canonical id, else the arXiv id up to its version."""
    return F.coalesce(F.nullif(F.trim(canonical), F.lit("")), F.nullif(F.split_part(F.trim(arxiv_id), F.lit("v"), F.lit(1)), F.lit("")))


def version(arxiv_id: Column) -> Column:
    """What follows the first 'v' of an arXiv id, '1' where nothing does."""
    return F.coalesce(F.nullif(F.regexp_extract(arxiv_id, "^[^v]*v(.*)$", 1), F.lit("")), F.lit("1"))


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(path_name(path), r"(.)\.[^.]*$", "$1")


def as_int(text: Column) -> Column:
    """Integer or null."""
    return F.trim(text).try_cast("int")


def as_int_via_float(text: Column) -> Column:
    """Integer part of a number, or null."""
    return F.trim(text).try_cast("double").try_cast("bigint")


def as_text(value: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def as_texts(values: Column) -> Column:
    """Trimmed texts of an array without blanks."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def as_ints(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.trim(x.cast("string")).try_cast("int")), lambda x: x.isNotNull())


def as_bool(value: Column, default: bool) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*TRUE_WORDS), True).when(v.isin(*FALSE_WORDS), False).otherwise(default)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")


def task_type(raw: Column) -> Column:
    """Clean name of a task type."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    alias = F.create_map(*(F.lit(x) for kv in TASK_TYPE_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(alias, clean), clean)


def chat_messages(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """Array of role and content; the system message is left out where blank."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    base = F.array(msg("user", user), msg("assistant", assistant))
    if system is None:
        return base
    return F.when(F.coalesce(F.trim(system), F.lit("")) != "", F.concat(F.array(msg("system", system)), base)).otherwise(base)


def stop_at(text: Column, stops: list[str]) -> Column:
    """The text up to the first of each stop sequence; trailing space goes only where something was cut."""
    for s in stops:
        text = F.when(F.instr(text, s) > 0, F.rtrim(F.substring_index(text, s, 1))).otherwise(text)
    return text


def paper_id(rag_path: Column, task_id: Column) -> Column:
    """Stem of the retrieved path, else what precedes the last two parts of a task id, else its first part, else 'unknown'."""
    t = F.trim(F.coalesce(task_id, F.lit("")))
    by_task = F.coalesce(F.nullif(F.regexp_extract(t, "^(.*)_[^_]*_[^_]*$", 1), F.lit("")), F.nullif(F.split_part(t, F.lit("_"), F.lit(1)), F.lit("")))
    return F.coalesce(F.nullif(path_stem(F.trim(rag_path)), F.lit("")), by_task, F.lit("unknown"))

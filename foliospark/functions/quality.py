"""Extraction quality, text features, error and model classes (O-079..O-086)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import words

# Characters counted as punctuation, and the terms of each error class in order.
PUNCTUATION = r"""[.,;:!?"'\-()\[\]{}/]"""
ERROR_TERMS = [
    ("network", "connection network timeout http socket refused unreachable".split()),
    ("parsing", ["json", "parse", "decode", "syntax", "invalid format", "malformed"]),
    ("model", ["model", "api", "rate limit", "quota", "unauthorized", "forbidden", "401", "403", "429"]),
    ("validation", ["validation", "invalid", "missing", "required", "valueerror"]),
]
# Section names that need no number.
SECTION_NAMES = """
abstract|introduction|background|related work|related works|literature review|methodology|methods|materials and methods|method|approach|proposed method|proposed approach|model|models
|architecture|system|framework|implementation|experiments|experiment|experimental setup|experimental settings|experimental results|results|results and discussion|analysis|evaluation
|discussion|limitations|future work|conclusion|conclusions|concluding remarks|summary|acknowledgments|acknowledgements|references|bibliography|appendix|appendices|supplementary material
|supplementary materials|supplemental material|data availability|code availability|author contributions|competing interests|conflict of interest|funding|ethics|ethical considerations
""".replace("\n", "").split("|")
NOT_TITLE = r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"


def quality_columns(text: Column, pages_attempted: Column | None = None, pages_extracted: Column | None = None) -> dict[str, Column]:
    """Counts, ratios, structure flags and the confidence score of a text; one page unless counts are given."""
    q = quality_struct(text, pages_attempted, pages_extracted)
    return {name: q[name] for name in QUALITY_FIELDS}


QUALITY_FIELDS = ("char_count", "word_count", "line_count", "success_rate", "has_paragraphs", "has_sentences", "avg_line_length", "whitespace_ratio", "alphabetic_ratio", "digit_ratio", "punctuation_ratio", "special_ratio", "confidence")


def quality_struct(text: Column, pages_attempted: Column | None = None, pages_extracted: Column | None = None) -> Column:
    """The columns of :func:`quality_columns` as one struct; every pass over the text is bound once."""
    t = F.coalesce(text, F.lit(""))
    tried = F.lit(1) if pages_attempted is None else pages_attempted
    got = (F.trim(t) != "").cast("int") if pages_extracted is None else pages_extracted
    lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"(?U)^\s*$"))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    passes = F.struct(
        F.length(t).cast("bigint").alias("c"),
        F.size(words(t)).cast("bigint").alias("w"),
        F.aggregate(lines, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("l")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["l"] + F.length(x)).alias("l"))).alias("lines"),
        count(r"\p{L}").alias("alpha"),
        count(r"\p{Nd}").alias("digit"),
        count(r"(?U)\s").alias("space"),
        count(PUNCTUATION).alias("punct"),
        F.contains(t, F.lit("\n\n")).alias("par"),
        t.rlike(r"[.!?]\s+[A-Z]").alias("sen"),
        F.when(tried > 0, got / tried).otherwise(0.0).alias("rate"),
    )

    def score(b: Column) -> Column:
        share = lambda k: F.when(b["c"] > 0, b[k] / b["c"]).otherwise(0.0)
        alpha, digit, space, punct = share("alpha"), share("digit"), share("space"), share("punct")
        line = F.when(b["lines"]["n"] > 0, b["lines"]["l"] / b["lines"]["n"]).otherwise(0.0)
        volume = (F.least(b["c"] / 1000, F.lit(1.0)) + F.least(b["w"] / 100, F.lit(1.0))) / 2
        mix = (F.when(alpha.between(0.6, 0.9), 1.0).otherwise(alpha) + F.when(space.between(0.1, 0.3), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(space - 0.2) / 0.2))) / 2
        width = F.when(line.between(30, 100), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(line - 65) / 65))
        confidence = 0.3 * b["rate"] + 0.2 * volume + 0.2 * (b["par"].cast("double") + b["sen"].cast("double")) / 2 + 0.2 * mix + 0.1 * width
        special = F.when(b["c"] > 0, 1 - alpha - digit - space - punct).otherwise(0.0)
        values = (b["c"], b["w"], b["lines"]["n"], b["rate"], b["par"], b["sen"], line, space, alpha, digit, punct, special, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
        return F.struct(*(v.alias(n) for n, v in zip(QUALITY_FIELDS, values, strict=True)))

    return F.transform(F.array(passes), score)[0]


def feature_columns(text: Column) -> dict[str, Column]:
    """Mathematical and tabular traits of a text."""
    t = F.coalesce(text, F.lit(""))
    toks = words(t)
    n = F.size(toks)
    digits = lambda w: F.regexp_count(w, F.lit(r"\p{Nd}"))
    math = F.filter(toks, lambda w: w.rlike(r"[=±∑∏√∞∂∀∃≤≥×÷∫∇≃≈≠≡⊕⊗⊥⇒⇔→←↔†‡]") | w.rlike(r"\\[A-Za-z]|[A-Za-z]*_[A-Za-z0-9]") | (digits(w) >= F.greatest(F.lit(2), F.floor(F.length(w) / 2))))
    inline = F.filter(toks, lambda w: w.rlike(r"(?i)\\(frac|sum|int|sqrt|mathbb|mathrm|mathbf|alpha|beta|gamma|delta|lambda|pi|phi|psi|theta)"))
    lines = F.split(t, "\n")
    table = F.filter(lines, lambda x: (F.trim(x) != "") & (F.trim(x).rlike(r"^[+|].*[+|]$") | (F.regexp_count(x, F.lit(r"\|")) >= 3) | x.rlike(r"(?i)\\begin\{tabular\}|\\hline|\\toprule|\\midrule|\\bottomrule|&")))
    some = lambda c: F.when(n > 0, c).otherwise(0.0)
    return {
        "math_token_ratio": some(F.size(math) / n),
        "inline_math_hits": F.when(n > 0, F.size(inline)).otherwise(0).cast("bigint"),
        "latex_env_hits": F.when(n > 0, F.regexp_count(t, F.lit(r"(?i)\\begin\{(align\*?|equation\*?|gather\*?|multline\*?|cases|tabular|array)\}"))).otherwise(0).cast("bigint"),
        "table_line_ratio": some(F.size(table) / F.greatest(F.lit(1), F.size(lines))),
        "dollar_hits": F.when(n > 0, F.regexp_count(t, F.lit(r"\$"))).otherwise(0).cast("bigint"),
    }


def error_class(message: Column, kind: Column | None = None) -> Column:
    """Class of an error by its message and type name: timeout, network, parsing, model, validation or unknown."""
    s = F.lower(F.concat_ws(" ", F.coalesce(message, F.lit("")), F.coalesce(kind, F.lit("")) if kind is not None else F.lit("")))
    out = F.when(F.contains(s, F.lit("timeout")), "timeout")
    for name, terms in ERROR_TERMS:
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(s, F.lit(term))
        out = out.when(hit, name)
    return out.otherwise("unknown")


def model_class(config_name: Column, model_name: Column, explicit: Column | None = None) -> Column:
    """instruction_only, rag_trained or base: explicit first, then the configuration's name, then the model's."""
    c, m = F.lower(F.coalesce(config_name, F.lit(""))), F.lower(F.coalesce(model_name, F.lit("")))
    out = F.when(c.rlike("rag[_-]trained"), "rag_trained").when(c.rlike("instruction[_-]only"), "instruction_only").when(F.contains(c, F.lit("hybrid")) & ~F.contains(c, F.lit("instruction")), "rag_trained")
    out = out.when(m.rlike("instruction[_-]only"), "instruction_only").when(F.contains(m, F.lit("lora_science")) & ~F.contains(m, F.lit("instruction")), "rag_trained").otherwise("base")
    return out if explicit is None else F.coalesce(F.nullif(F.trim(explicit), F.lit("")), out)


def section_title(page_text: Column) -> Column:
    """The first line of a page that looks like a heading, or null.

    A heading is a known section name, a numbered or lettered one, short capitals, or a short line in title case.
    """
    lines = F.transform(F.split(F.coalesce(page_text, F.lit("")), r"\R"), lambda x: F.trim(x))

    def is_heading(x: Column) -> Column:
        n = F.size(words(x))
        letters = x.rlike(r"\p{L}")
        return (x != "") & (F.length(x) <= 120) & (
            F.lower(x).isin(*SECTION_NAMES)
            | x.rlike(r"^[A-Z]?\d+(\.\d+)*\.?\s+.+$")
            | (x.rlike(r"^[A-Z]\s+[A-Z].+$") & (n <= 8))
            | (letters & (F.upper(x) == x) & ~x.rlike(r"\p{Ll}") & (n <= 12) & (F.length(x) > 3))
            | (letters & ~x.rlike(NOT_TITLE) & (n <= 10) & ~x.rlike(r"[.?!:]$"))
        )

    first = F.try_element_at(F.filter(lines, is_heading), F.lit(1))
    known = F.lower(first).isin(*SECTION_NAMES) & (F.lower(first) == first)
    return F.when(known, F.initcap(first)).otherwise(first)

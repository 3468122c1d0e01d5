"""Canonical forms of short records: labelled fields, multiset fingerprints.

All of it is native column code; nothing here sorts or leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that may part labelled fields, and what a label looks like.
FIELD_START = r"(?:^|[;|\n\r•·])[^\p{L}\p{N};|\n\r]*(\p{L}[\p{L}\p{N} _\-]{0,39}?)\s*[:：]"
NOT_CONTENT = r"[^\p{L}\p{N}\p{M}]+"
#: Sums of two hashes below this mask can't overflow a bigint.
MASK = (1 << 60) - 1


def squeeze(text: Column) -> Column:
    """Letters, digits and marks of a text in lower case, nothing between them; null is ''."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("ß"), F.lit("ss")), NOT_CONTENT, "")


def words_of(text: Column) -> Column:
    """A text in lower case with one space between its words; null is ''."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("ß"), F.lit("ss")), NOT_CONTENT, " "))


def field_pairs(text: Column, whole: str) -> Column:
    """Array of 'name=value' of a text with labelled fields, each squeezed.

    A text counts as labelled if it starts with a label and has two or more;
    a piece without a label belongs to the field before it. Any other text is
    one field called ``whole``.
    """
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\u0001\u0002]", " ")
    marked = F.regexp_replace(F.trim(t), FIELD_START, "\u0001$1\u0002")
    pieces = F.split(marked, "\u0001")
    labelled = (F.size(pieces) > 2) & (squeeze(pieces[0]) == "")
    pairs = F.transform(
        F.filter(pieces, lambda p: F.contains(p, F.lit("\u0002"))),
        lambda p: F.concat(squeeze(F.split_part(p, F.lit("\u0002"), F.lit(1))), F.lit("="), squeeze(F.split_part(p, F.lit("\u0002"), F.lit(2)))),
    )
    return F.when(labelled, pairs).otherwise(F.array(F.concat(F.lit(f"{whole}="), squeeze(t))))


def multiset_hash(items: Column) -> Column:
    """Order-free 120-bit fingerprint of an array of strings: two sums of hashes."""

    def total(salt: int) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: (a + F.xxhash64(x, F.lit(salt)).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK)))

    return F.concat_ws("-", F.hex(total(1)), F.hex(total(2)))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same strings equally often, in any order; by counting, not sorting."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.size(F.filter(a, lambda y: y == x)) == F.size(F.filter(b, lambda y: y == x)))

"""Problem 6: records of the evaluation splits that also stand in the training split.

Exact stage, by the method named: question and answer are canonicalised (case,
punctuation, white space, order of labelled fields, citation marks) and hashed;
records with the same hash pair form a class, and evaluation classes meet
training classes by joining the hashes.

Near stage, on classes instead of records, so that copies are never compared
with each other: two classes become candidates when they share a key of the
question and one of the answer. Keys don't depend on where a word stands, and are
so many that two texts which the check below lets pass have one in common (prefix
filter): the rarest words of the question down to the first name, which the other
one must hold too, each with all digits of it; all words of the answer; the sorted
numbers of a sentence; the rarest words of a sentence without numbers. A name that is
written apart in one question and together in the other has keys of its own. Every candidate is then checked word by word: nothing but common
words may differ in the question, and the sentences of the shorter answer must be
found in the other with the same numbers. The candidate join has no cap.

The result is links between classes and the membership of records; pairs of
records are listed only where they are asked for, and counted as products. Keys
and classes of very many rows are spread over salts.

Word rarity is counted over all classes; the broadcasts hold only words found
in more than 1/COMMON of the questions, or 1/COMMON_ANSWER of the answers, of
which there can be at most so many times the mean number of distinct words.

Defined results: null question or answer counts as empty; a pair in which the
question is empty is no case; rows without id or with an unknown split are left
out; rows delivered twice are one record; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.canon import field_pairs, multiset_hash, squeeze
from foliospark.plans.scale import cut, packed, release, skew_join

COMMON = 1000
COMMON_ANSWER = 30
#: Share of the words of a question, or of a sentence, that may be changed.
SHARE = 0.25
#: Words written apart in one text and together in the other, which the check doesn't count as changes.
JOINED = 2
#: A name may be written apart in so many words.
APART = 3
#: So many keys of names written apart may be shared with all tasks; if there are more, each record gives all of its own.
MAX_APART = 1 << 20
# What a citation mark and a sentence end look like.
CITATION = r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]"
SENTENCE_END = r"(?<=[.!?。！？])\s+|(?<=[。！？])|[\n\r]+"


def _answer_text(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), CITATION, " ")


def _tokens(text: Column) -> Column:
    """Numbers and words in lower case, as :func:`_split_words` cuts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{Nl}\p{No}]+"), F.lit(0))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def _rarest(words: list[str], common: dict[str, int], most: int) -> list[str]:
    return sorted(set(words), key=lambda w: (common.get(w, 0), _hash(w)))[:most]


@lru_cache(maxsize=200_000)
def _letters(word: str) -> str:
    """The same for two words of which one is the other with neighbours swapped."""
    return "".join(sorted(word))


def _by_letters(common: dict[str, int]) -> dict[str, int]:
    out: Counter[str] = Counter()
    for w, n in common.items():
        out[_letters(w)] += n
    return dict(out)


def _prefix(words: list[str], names: set[str], common: dict[str, int]) -> tuple[list[str], str | None]:
    """Words, as their letters, from the rarest down to the first name, which is returned too; ``common`` is by letters."""
    named = {_letters(w): w for w in words if w in names}
    out = []
    for x in _rarest(list(map(_letters, words)), common, max(2, int(SHARE * len(words))) + 1 + JOINED):
        out.append(x)
        if x in named:
            return out, named[x]
    return out, None


def question_keys(question: str, common: dict[str, int]) -> list[str]:
    """Strings of which two questions share one if :func:`same_question` can hold for them.

    It lets at most SHARE of the words of either, or two, be changed, and no digit,
    but for two that trade places; so one more of the rarest words is shared, and
    the digits are the same in any order. Names may not be changed at all, but for
    letters that trade places: no word before the rarest shared one is in the other
    text, hence none of them is a name, unless words were joined (:func:`apart_keys`).
    """
    digits = "".join(sorted(c for c in question if c.isdigit()))
    return [f"{digits} {x}" for x in _prefix(_split_words(question), _names(question), common)[0]]


def _runs(words: list[str], at: int, least: int = 2) -> set[str]:
    """Up to APART words from ``at`` on as one."""
    return {"".join(words[at : at + k]) for k in range(least, APART + 1) if at + k <= len(words)}


def apart_keys(question: str, common: dict[str, int]) -> tuple[set[str], set[str]]:
    """Strings (of the name at which :func:`question_keys` ends, of all words): where that name is written apart in one of two questions and together in the other, one of either's first and one of the other's second are the same."""
    words = _split_words(question)
    name = _prefix(words, _names(question), common)[1]
    own: set[str] = set()
    if name:
        own.add(f"whole {name}")
        for i in (i for i, w in enumerate(words) if w == name):
            own |= {f"parts {r}" for k in range(max(0, i - APART + 1), i + 1) for r in _runs(words, k, max(2, i - k + 1))}
    return own, {f"parts {w}" for w in words} | {f"whole {r}" for i in range(len(words)) for r in _runs(words, i)}


def answer_keys(answer: str, common: dict[str, int]) -> set[str]:
    """Strings of which two answers share one if :func:`same_answer` can hold for them.

    Sentences with a number agree in all their numbers. Of the words of a sentence
    of n without numbers, the check lets at most n / 4 of the shorter answer, hence
    n / 3 of the longer one, or two, be missing in the other; so one more of the
    rarest holds a shared word. Such words are needed only where these sentences are
    half of the answer, as else a sentence with numbers must be found.
    """
    sentences = _sentences(answer)
    out = {"all " + " ".join(sorted(w for s in sentences for w in s))}
    plain = []
    for s in sentences:
        numbers = sorted(w for w in s if w[0].isdigit())
        if numbers:
            out.add("numbers " + " ".join(numbers))
        else:
            plain.append(s)
    if 2 * sum(map(len, plain)) >= sum(map(len, sentences)):
        for s in plain:
            out.update(_rarest(s, common, max(2, len(s) // 3) + 1 + JOINED))
    return out


def _edit_one(a: str, b: str) -> bool:
    """Whether one letter was changed, added or dropped, or two neighbours were swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(x) == len(y) and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _swapped(a: str, b: str) -> bool:
    return len(a) == len(b) and sorted(a) == sorted(b) and _edit_one(a, b)


WORD = re.compile(r"\w+(?:[.,-]\w+)*")


def _names(text: str) -> set[str]:
    """Words in lower case that look like names: capitals inside, or a capital that starts no sentence of an ordinarily cased text."""
    found = WORD.findall(text)
    letters = [w for w in found if w[0].isalpha()]
    plain = bool(letters) and sum(w[0].isupper() for w in letters) < 0.5 * len(letters)
    out = set()
    for m in WORD.finditer(text):
        w = m.group()
        inner = any(c.isupper() for c in w[1:]) and any(c.islower() for c in w)
        before = text[: m.start()].rstrip(" \t\n\"'“”«»(*-")
        if plain and (inner or (w[0].isupper() and before and before[-1] not in ".!?:;|")):
            out.add(w.lower())
    return out


def _alter(a: list[str], b: list[str], names: set[str]) -> tuple[int, bool]:
    """Words that differ between two texts, and whether a number or name is among them."""
    changed, bad = 0, False
    for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        x, y = a[i1:i2], b[j1:j2]
        if "".join(x) == "".join(y):
            continue
        if len(x) == len(y):
            for p, q in zip(x, y, strict=True):
                if p == q or _swapped(p, q):
                    changed += p != q
                    continue
                changed += 1
                bad |= any(c.isdigit() for c in p + q) or p in names or q in names
        else:
            changed += max(len(x), len(y))
            bad |= any(any(c.isdigit() for c in w) or w in names for w in x + y)
    return changed, bad


def _split_words(text: str) -> list[str]:
    return re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text.lower())


def _sentences(text: str) -> list[list[str]]:
    return [w for s in re.split(SENTENCE_END, re.sub(CITATION, " ", text)) if (w := _split_words(s))]


def same_question(qa: str, qb: str, share: float = SHARE) -> bool:
    """Whether two questions differ by a few common words only."""
    a, b = _split_words(qa), _split_words(qb)
    if sorted(a) == sorted(b):
        return True
    changed, bad = _alter(a, b, _names(qa) | _names(qb))
    return not bad and changed <= max(2, share * min(len(a), len(b)))


def same_answer(aa: str, ab: str, share: float = SHARE) -> bool:
    """Whether the sentences of the shorter answer stand in the other one, but for a few common words.

    Sentences may be moved, and up to half of the longer answer may be additions.
    """

    a, b = _sentences(aa), _sentences(ab)
    if sorted(x for s in a for x in s) == sorted(x for s in b for x in s):
        return True
    if not a or not b:
        return False
    if sum(map(len, a)) > sum(map(len, b)):
        a, b = b, a
    names = _names(re.sub(CITATION, " ", aa)) | _names(re.sub(CITATION, " ", ab))
    left, found, total, used = list(b), 0, sum(map(len, a)), 0
    for s in sorted(a, key=len, reverse=True):
        best, at = 1e9, -1
        numbers = Counter(w for w in s if w[0].isdigit())
        for k, t in enumerate(left):
            if Counter(w for w in t if w[0].isdigit()) == numbers and sum((Counter(s) & Counter(t)).values()) >= 0.5 * min(len(s), len(t)):
                changed, bad = _alter(s, t, names)
                if not bad and changed < best:
                    best, at = changed, k
        if at >= 0 and best <= max(2, share * len(s)):
            found += len(s)
            used += len(left.pop(at))
    return found >= 0.66 * total and used >= 0.5 * sum(map(len, b))


@lru_cache(maxsize=50_000)
def _question(text: str) -> tuple[list[str], Counter[str], frozenset[str]]:
    words = _split_words(text)
    return words, Counter(words), frozenset(_names(text))


def may_be_same_question(qa: str, qb: str, share: float = SHARE) -> bool:
    """A cheap condition that :func:`same_question` can't hold without: few words on one side only, and of names and numbers none that isn't misspelt or joined."""
    (a, ca, na), (b, cb, nb) = _question(qa), _question(qb)
    if ca == cb:
        return True
    most = max(2, share * min(len(a), len(b))) + JOINED
    names = na | nb
    for more, words in ((ca - cb, b), (cb - ca, a)):
        if sum(more.values()) > most:
            return False
        for w in more:
            if (w in names or any(c.isdigit() for c in w)) and not any(v != w and (w in v or v in w or _swapped(w, v)) for v in words):
                return False
    return True


def _verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        keep = [may_be_same_question(r.q_e, r.q_t) and same_question(r.q_e, r.q_t) and same_answer(r.a_e, r.a_t) for r in pdf.itertuples()]
        yield pdf.loc[keep, ["e1", "e2", "t1", "t2"]]


def classes(df: DataFrame, id_col: str, question: str, answer: str, split_col: str) -> DataFrame:
    """(id, side, split, c1, c2, q, a): c1 and c2 are 128 bits of hash of canonical question and answer; side is train or eval."""
    split = F.lower(F.trim(F.col(split_col)))
    hashes = [multiset_hash(field_pairs(F.col(question), "q")), multiset_hash(F.array(F.concat(F.lit("a="), squeeze(_answer_text(F.col(answer))))))]
    return (
        df.where(F.col(id_col).isNotNull() & split.isin("train", "validation", "test") & (squeeze(F.col(question)) != ""))
        .select(F.col(id_col).alias("id"), split.alias("split"), F.when(split == "train", "train").otherwise("eval").alias("side"), *(h.alias(n) for h, n in zip(hashes, ("qh", "ah"), strict=True)), F.coalesce(F.col(question), F.lit("")).alias("q"), F.coalesce(F.col(answer), F.lit("")).alias("a"))
        .select("id", "side", "split", F.xxhash64("qh", "ah").alias("c1"), F.xxhash64("ah", "qh", F.lit(1)).alias("c2"), "q", "a")
    )


def _common(reps: DataFrame, words: Column, share: int) -> dict[str, int]:
    """Words found in more than 1/share of the texts, of bounded number, and in how many."""
    counts = reps.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") * share > reps.agg(F.count("*")).scalar())
    return {r["w"]: r["df"] for r in counts.collect()}


def representatives(recs: DataFrame) -> DataFrame:
    """(rep, c1, c2, side, q, a): one text per class and side, numbered."""
    reps = recs.groupBy("c1", "c2", "side").agg(F.min_by(F.struct("q", "a"), "id").alias("r"))
    return packed(reps.select(F.monotonically_increasing_id().alias("rep"), "c1", "c2", "side", "r.q", "r.a"))


def _names_apart(reps: DataFrame, common: dict[str, int]) -> set[int] | None:
    """Keys of names that are written apart somewhere and together elsewhere; None if there are too many to share."""

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            own: set[str] = set()
            of_all: set[str] = set()
            for q in pdf["q"]:
                x, y = apart_keys(q, common)
                own |= x
                of_all |= y
            yield pd.DataFrame([(_hash(w), w in own, w in of_all) for w in own | of_all], columns=["key", "own", "rest"])

    both = reps.select("q").mapInPandas(keys, "key bigint, own boolean, rest boolean").groupBy("key").agg(F.bool_or("own").alias("own"), F.bool_or("rest").alias("rest")).where("own and rest").select("key")
    found = cut(both.limit(MAX_APART + 1))
    out = {r["key"] for r in found.collect()}
    release(found)
    return out if len(out) <= MAX_APART else None


def class_links(reps: DataFrame) -> DataFrame:
    """(e1, e2, t1, t2): evaluation classes and training classes that are the same or nearly so."""
    spark = reps.sparkSession
    both = reps.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n = 2")
    exact = both.select(F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    of_questions = _by_letters(_common(reps, _tokens(F.col("q")), COMMON))
    state = spark.sparkContext.broadcast((of_questions, _common(reps, _tokens(_answer_text(F.col("a"))), COMMON_ANSWER), _names_apart(reps, of_questions)))

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common_q, common_a, apart = state.value
        for pdf in it:
            rows = []
            for rep, train, q, a in zip(pdf["rep"], pdf["train"], pdf["q"], pdf["a"], strict=True):
                of_answer = answer_keys(a, common_a)
                rows += [(rep, train, _hash(w, s)) for w in question_keys(q, common_q) for s in of_answer]
                if apart is None or apart:
                    own, of_all = apart_keys(q, common_q)
                    # A name of one side meets all words of the other one only.
                    rows += [(rep, train, _hash("name", side, w)) for side, ws in (("train", own if train else of_all), ("eval", of_all if train else own)) for w in ws if apart is None or _hash(w) in apart]
            yield pd.DataFrame(rows, columns=["rep", "train", "key"])

    keyed = packed(reps.select("rep", (F.col("side") == "train").alias("train"), "q", "a").mapInPandas(keys, "rep bigint, train boolean, key bigint"))
    e = keyed.where("not train").select("key", F.col("rep").alias("rep_e"))
    t = keyed.where("train").select("key", F.col("rep").alias("rep_t"))
    pairs = packed(skew_join(t, e, ["key"], "rep_t").select("rep_e", "rep_t").distinct(), keyed)
    text_e = reps.where("side = 'eval'").select(F.col("rep").alias("rep_e"), F.col("q").alias("q_e"), F.col("a").alias("a_e"), F.col("c1").alias("e1"), F.col("c2").alias("e2"))
    text_t = reps.where("side = 'train'").select(F.col("rep").alias("rep_t"), F.col("q").alias("q_t"), F.col("a").alias("a_t"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    checked = pairs.join(text_e, "rep_e").join(text_t, "rep_t").where("e1 <> t1 or e2 <> t2")
    near = checked.select("e1", "e2", "t1", "t2", "q_e", "q_t", "a_e", "a_t").mapInPandas(_verify, "e1 bigint, e2 bigint, t1 bigint, t2 bigint")
    return cut(exact.unionByName(near), pairs)


def linked_classes(df: DataFrame, id_col: str = "task_id", question: str = "instruction", answer: str = "expected_response", split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of classes (e1, e2, t1, t2), and every record (id, side, split, c1, c2) of the classes."""
    recs = packed(classes(df, id_col, question, answer, split_col))  # read once
    reps = representatives(recs)
    members = cut(recs.select("id", "side", "split", "c1", "c2").distinct(), recs)
    links = class_links(reps)
    release(reps)
    return links, members


def overlaps(df: DataFrame, id_col: str = "task_id", question: str = "instruction", answer: str = "expected_response", split_col: str = "split") -> DataFrame:
    """(eval_id, train_id, eval_split): all pairs of an evaluation and a training record that are the same or nearly so."""
    links, members = linked_classes(df, id_col, question, answer, split_col)
    ev = members.where("side = 'eval'").select(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("c1").alias("e1"), F.col("c2").alias("e2"))
    tr = members.where("side = 'train'").select(F.col("id").alias("train_id"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    some = skew_join(ev, links, ["e1", "e2"], "eval_id")
    return skew_join(tr, some, ["t1", "t2"], "train_id").select("eval_id", "train_id", "eval_split")


def found(df: DataFrame) -> DataFrame:
    """(task_id_a, task_id_b): each overlapping pair once, the smaller id first."""
    o = overlaps(df)
    return o.select(F.least("eval_id", "train_id").alias("task_id_a"), F.greatest("eval_id", "train_id").alias("task_id_b")).distinct()


def exact_counts(df: DataFrame, id_col: str = "task_id", question: str = "instruction", answer: str = "expected_response", split_col: str = "split") -> DataFrame:
    """(split, n_records, n_overlaps): the exact stage alone, counted by class."""
    members = classes(df, id_col, question, answer, split_col).select("id", "side", "split", "c1", "c2").distinct()
    n = members.groupBy("c1", "c2").agg(F.count_if(F.col("side") == "train").alias("n_train")).where("n_train > 0")
    per = members.where("side = 'eval'").groupBy("c1", "c2", "split").agg(F.count("*").alias("n"))
    return per.join(n, ["c1", "c2"]).groupBy("split").agg(F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("n_train")).alias("n_overlaps"))


def report(df: DataFrame, sources: Column, id_col: str = "task_id") -> DataFrame:
    """(split, source, n_records, n_overlaps): evaluation records found in training and their pairs, per split and source.

    Pairs are counted as products of class sizes and never listed. ``sources`` is
    an array column of ``df``; a record with several sources counts for each, one
    with none for 'none'.
    """
    links, members = linked_classes(df, id_col)
    sizes = members.where("side = 'train'").groupBy(F.col("c1").alias("t1"), F.col("c2").alias("t2")).agg(F.count("*").alias("n"))
    k = links.distinct().join(sizes, ["t1", "t2"]).groupBy(F.col("e1").alias("c1"), F.col("e2").alias("c2")).agg(F.sum("n").alias("k"))
    ev = skew_join(members.where("side = 'eval'"), k, ["c1", "c2"], "id").select("id", "split", "k")
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode_outer(F.array_distinct(sources)).alias("source")).distinct()
    return (
        ev.join(src, "id", "left")
        .groupBy("split", F.coalesce("source", F.lit("none")).alias("source"))
        .agg(F.count("*").alias("n_records"), F.sum("k").alias("n_overlaps"))
    )

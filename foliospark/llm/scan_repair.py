"""Problem 3: noise in text from scanned pages, found by kind and repaired.

Lines are labelled body, header, page (number) or break (blank, heading, list,
table, formula) by a hidden Markov model over layout features; its tables start
from lines that carry a seed label and are refined by expectation maximisation,
on ``sample_rows`` chunks chosen by hash (a documented bound). Every chunk is
then decoded. Text is reassembled from body lines across headers and page
numbers; breaks stay on lines of their own.

Corpus statistics cover all chunks: which lines return in other texts of the same
source (running headers; compared after folding characters that recognition
confuses), and how often each word occurs. A word is misrecognised if undoing one
or two known confusions gives a word at least RATIO times as frequent; a hyphen at
a line's end divides a word unless the corpus writes it with the hyphen.

Scale: lines and words are counted with map-side combining; a source with a third
of all chunks is one of at most HOT_SHARE hot keys and joined in salts; header
keys of a source must occur in 1/HEADER_SHARE of its texts, which bounds their
number whatever the source's size; the broadcast word list, of words that needn't
be checked chunk by chunk, holds words that make up more than 1/COMMON of all, so
at most COMMON of them, without those that are misrecognised.

Defined results: null and empty texts have no noise and stay as they are; chunks
with a null or blank source have no running headers; chunks without id are left
out; a chunk delivered twice comes out once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.plans.scale import cut, hash_sample, is_small, salted_join

SAMPLE_ROWS = 5000
COMMON = 20_000
RATIO = 8
HEADER_SHARE = 40
STATES = ("body", "header", "page", "break")

# What recognition makes of a character (left) and what it was (right).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("¢", "e"), ("¢", "c"), ("(", "c"), ("|", ""), ("|", "l"), ("|", "i"), ("|", "t"), ("!", "i"), ("!", "l"), ("1", "l"), ("1", "i"), ("l", "i"),
    ("i", "l"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("$", "s"), ("$", "S"), ("†", "t"), ("ä", "a"), ("¥", "y"), ("8", "B"), ("6", "b"), ("9", "g"), ("€", "e"),
    ("£", "f"), ("@", "a"), ("ö", "o"), ("ü", "u"), ("é", "e"), ("í", "i"), ("cl", "d"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("ii", "n"), ("li", "h"), ("h", "li"), ("vv", "w"), ("nn", "m"), ("u", "n"), ("n", "u"),
    ("h", "b"), ("b", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("t", "f"), ("f", "t"), ("I", "l"), ("ri", "n"), ("tl", "d"), ("°", "o"), ("§", "s"), ("µ", "u"),
]
ODD = "¢(|!10$5†ä¥86€£@öüéí°§µﬁﬂﬀﬃﬄ9"
HYPHENS = "-‐‑¬­"
ALWAYS_DIVIDES = "¬­"
SECTION_NAMES = "abstract introduction background related work data materials methods method experimental setup results evaluation protocol ablations discussion error analysis limitations conclusion conclusions appendix references acknowledgements"

PAGE_ONLY = re.compile(r"^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|(?:p\.?|pp\.?|page|pg\.?|seite|página|pagina|стр\.?)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*(?:of|/)\s*\d{1,4}|\d{1,4}|[ivxlc]{1,7}|第?\s*\d{1,4}\s*页)\s*$", re.I)
ROMAN = re.compile(r"^(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
PAGE_MARK = r"(?:[-–—]\s*)?(?:\[\s*)?(?:(?:p\.?|page)\s*)?(?:\d{1,4}(?:\s*of\s*\d{1,4})?|[ivxlc]{1,7})(?:\s*\])?(?:\s*[-–—])?"
PAGE_BESIDE = re.compile(rf"^(.*\S)(?:\s{{2,}}|\t)({PAGE_MARK})\s*$", re.I)
PAGE_BEFORE = re.compile(rf"^\s*({PAGE_MARK})(?:\s{{2,}}|\t)(\S.*)$", re.I)
HEADING = re.compile(r"^\s*(?:#+\s*)?(?:\d+(?:\.\d+)*\.?|[A-Z]\.|[IVX]+\.)\s+[A-Z][\w ,:&-]{2,60}$")
LISTED = re.compile(r"^\s*(?:[-*•–]\s+\S|\(?\d{1,2}[.)]\s|\(?[ivx]{1,4}\)\s|\(?[a-z]\)\s)")
TABLE = re.compile(r"\S(?:\s{2,}|\t|\s*\|\s*)\S+(?:\s{2,}|\t|\s*\|\s*)\S")
FORMULA = re.compile(r"^\s*\S.{0,80}[=≤≥∑∫^_\\].{0,80}(?:\(\d+\))?\s*$")
# Words of running headers.
HEADER_WORDS = re.compile(r"\bet\W{0,2}al\b|\bvol\.|^\W*(?:preprint|proc|trans|journal|workshop|conference|proceedings)\b", re.I)
END = re.compile(r"[.!?:;][\"'”»)\]]*\s*$")


def _keep_page(line: str) -> bool:
    if len(line) > 40 or not PAGE_ONLY.match(line):
        return False
    core = re.sub(r"[^A-Za-z]", "", line)
    return not re.fullmatch(r"[ivxlcIVXLC]+", core) or bool(ROMAN.match(core)) or bool(re.search(r"\d", line))


def beside(line: str) -> tuple[str, bool]:
    """A line without a page number standing beside it, and whether there was one."""
    if len(line) > 160 or ("  " not in line and "\t" not in line):
        return line, False
    m = PAGE_BESIDE.match(line)
    if m and re.search(r"[A-Za-z]{3}", m.group(1)) and not TABLE.search(m.group(1)) and _keep_page(m.group(2)):
        return m.group(1), True
    m = PAGE_BEFORE.match(line)
    if m and re.search(r"[A-Za-z]{3}", m.group(2)) and not TABLE.search(m.group(2)) and _keep_page(m.group(1)):
        return m.group(2), True
    return line, False


# Single characters merged, then wide letters written out as what they are confused with.
MERGED = ("¢(e!1lí05$†äöü¥", "ccciiiiosstaouy")
WIDE = [("m", "rn"), ("w", "vv"), ("d", "ci"), ("u", "ii"), ("h", "ii"), ("n", "ii")]
LIGATURES = [("|", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]


def fold(text: str) -> str:
    """Letters of a line after merging what recognition confuses, for comparing damaged lines."""
    t = text.lower()
    for a, b in LIGATURES:
        t = t.replace(a, b)
    t = re.sub(r"[^a-z\d]+", "", t.translate(str.maketrans(*MERGED)))
    for a, b in WIDE:
        t = t.replace(a, b)
    return t


def fold_column(line: Column) -> Column:
    """The same as :func:`fold`, as a column."""
    t = F.lower(line)
    for a, b in LIGATURES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.translate(t, *MERGED), r"[^a-z\d]+", "")
    for a, b in WIDE:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# --- returning lines ---------------------------------------------------------


def returning_lines(chunks: DataFrame) -> DataFrame:
    """(source, keys array<string>, n): per source, folded lines found in at least two of its different texts and in 1/HEADER_SHARE of them."""
    lines = chunks.where("trim(source) <> ''").select("source", F.xxhash64("text").alias("h"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", rf"(?i)(\S)(?:\s{{2,}}|\t){PAGE_MARK}\s*$", "$1"), rf"(?i)^\s*{PAGE_MARK}(?:\s{{2,}}|\t)", ""))
    fit = (
        lines.select("source", "h", bare.alias("line"))
        .where(F.length("line").between(6, 90) & (~F.col("line").rlike(r"[.;,]$") | F.col("line").rlike(r"(?i)\bet\W{0,2}al\W*$")) & ~F.col("line").rlike(r"^\s*(?:[-*•–(]|\d|[a-z])") & ~F.col("line").rlike(r"\s{2,}|\t|\|.*\|"))
        .select("source", "h", fold_column(F.col("line")).alias("key"))
        .where(F.length("key") >= 5)
        .distinct()
    )
    per = fit.groupBy("source", "key").agg(F.count("*").alias("texts")).where("texts >= 2")
    size = chunks.where("trim(source) <> ''").groupBy("source").agg(F.approx_count_distinct("text").alias("of"), F.count("*").alias("n"))
    kept = per.join(size, "source").where(F.col("texts") * HEADER_SHARE >= F.col("of"))
    return size.select("source", "n").join(kept.groupBy("source").agg(F.array_sort(F.collect_list("key")).alias("keys")), "source", "left").select("source", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), "n")


# --- the line model ----------------------------------------------------------

#: Features of a line and how many values each has.
SIZES = (2, 3, 3, 4, 3, 27, 2)
#: What a state can't have, whatever the counts say: (state, feature, value).
NEVER = ((1, 1, 0), (1, 0, 1), (1, 2, 2), (2, 0, 0), (0, 2, 2), (3, 2, 0))


NO_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉ")
NO_LOWER = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzäöüßé")


def _may_be_damaged(lines: list[str], i: int, bare: str, before: dict[int, int], after: dict[int, int]) -> bool:
    """Whether a line that isn't known to return stands where headers stand: first, or cutting into a sentence, or with a header's words."""
    if bare[:1].islower():
        return False
    if HEADER_WORDS.search(bare):
        return True
    if END.search(bare):
        return False
    p, q = before.get(i), after.get(i)
    return p is None or (not END.search(lines[p]) and q is not None and lines[q].lstrip()[:1].islower())


def _near(k: str, keys: list[str]) -> bool:
    """Whether some key is nearly the same string."""
    m = SequenceMatcher(autojunk=False)
    m.set_seq2(k)
    for x in keys:
        if abs(len(k) - len(x)) <= 6:
            m.set_seq1(x)
            if m.quick_ratio() >= 0.86 and m.ratio() >= 0.86:
                return True
    return False


def features(lines: list[str], keys: list[str], section: str | None) -> np.ndarray:
    """One row per line: page shape, returning, break (shape, blank), length, case, place with the flow before and after, header words."""
    n = len(lines)
    out = np.zeros((n, len(SIZES)), dtype=np.int8)
    widths = sorted(len(x) for x in lines if x.strip())
    width = widths[(3 * len(widths)) // 4] if widths else 1
    known = set(keys)
    plain_section = re.sub(r"[\W\d_]+", "", section.lower()) if section else ""
    names = set(SECTION_NAMES.split())
    full = [i for i, x in enumerate(lines) if x.strip() and not _keep_page(x)]
    before = {b: a for a, b in pairwise(full)}
    after = {a: b for a, b in pairwise(full)}
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            out[i, 2] = 2
            continue
        page = _keep_page(line)
        out[i, 0] = page
        bare, marked = (s, False) if page else beside(line)
        bare = bare.strip()
        if not page and len(s) <= 160:
            k = fold(bare)
            if k in known:
                out[i, 1] = 2
            elif keys and 8 <= len(k) <= 150 and _may_be_damaged(lines, i, bare, before, after) and _near(k, keys):
                out[i, 1] = 1
            named = False
            if len(s) <= 60 and not END.search(s):
                words = re.findall(r"[a-z]+", s.lower())
                named = bool(words) and len(words) <= 4 and all(w in names for w in words) or bool(section) and re.sub(r"[\W\d_]+", "", s.lower()) == plain_section
            shape = (
                (len(s) <= 75 and HEADING.match(line))
                or LISTED.match(line)
                or (not marked and ("  " in s or "\t" in s or "|" in s) and TABLE.search(line))
                or (any(c in s for c in "=≤≥∑∫^_\\") and FORMULA.match(line) and len(re.findall(r"[A-Za-z]{4,}", s)) <= 4)
            )
            out[i, 2] = bool(shape) or named
        r = len(s) / max(1, width)
        out[i, 3] = 0 if r < 0.4 else 1 if r < 0.75 else 2 if r < 1.08 else 3
        upper = len(s) - len(s.translate(NO_UPPER))
        lower = len(s) - len(s.translate(NO_LOWER))
        out[i, 4] = 2 if upper > 4 * lower else 1 if s[:1].isupper() else 0
        p, q = before.get(i), after.get(i)
        out[i, 6] = bool(HEADER_WORDS.search(bare)) if not out[i, 0] else 0
        place = 0 if p is None else 2 if q is None else 1
        flow = 0 if p is None else 1 if END.search(lines[p]) else 2
        follow = 0 if q is None else 1 if re.match(r"\s*[(\d]?[a-z\d]", lines[q]) and not LISTED.match(lines[q]) else 2
        out[i, 5] = 9 * place + 3 * flow + follow
        if not out[i, 2] and not page and not out[i, 1] and r < 0.6 and len(s) <= 60 and s[:1].isupper() and not END.search(s) and flow != 2 and follow == 2:
            out[i, 2] = 1  # stands alone like a title
    return out


def seed(f: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """First labels of lines, from which the model's tables are counted."""
    lab = np.zeros(len(f), dtype=np.int8)
    lab[f[:, 2] > 0] = 3
    lab[f[:, 0] == 1] = 2
    place, flow, follow = f[:, 5] // 9, f[:, 5] % 9 // 3, f[:, 5] % 3
    cuts_in = (place == 0) & (follow == 2) | (flow == 2) & (follow == 1)
    head = (f[:, 1] > 0) & (f[:, 0] == 0) & (f[:, 2] == 0) & (f[:, 4] > 0) & ((f[:, 6] == 1) | ~ended & cuts_in)
    lab[head] = 1
    return lab


class LineModel:
    """Hidden Markov model with independent categorical features."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> None:
        self.start, self.move, self.emit = np.log(start), np.log(move), [np.log(e) for e in emit]

    def scores(self, f: np.ndarray) -> np.ndarray:
        return sum(e[:, f[:, k]].T for k, e in enumerate(self.emit))

    def _padded(self, f: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        s = self.scores(f)
        grid = np.zeros((len(lengths), max(lengths), len(STATES)))
        mask = np.arange(max(lengths))[None, :] < np.array(lengths)[:, None]
        grid[mask] = s
        return grid, mask

    def decode(self, f: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Most probable labels of all lines; texts follow each other in ``f``."""
        if not lengths:
            return np.zeros(0, dtype=np.int8)
        grid, mask = self._padded(f, lengths)
        b, t, k = grid.shape
        back = np.zeros((b, t, k), dtype=np.int8)
        v = self.start + grid[:, 0]
        for i in range(1, t):
            step = v[:, :, None] + self.move
            back[:, i] = step.argmax(1)
            v = np.where(mask[:, i, None], step.max(1) + grid[:, i], v)
            back[:, i] = np.where(mask[:, i, None], back[:, i], np.arange(k))
        out = np.zeros((b, t), dtype=np.int8)
        out[:, -1] = v.argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(b), i, out[:, i]]
        return out[mask]

    def posteriors(self, f: np.ndarray, lengths: list[int]) -> np.ndarray:
        grid, mask = self._padded(f, lengths)
        b, t, k = grid.shape
        fwd, bwd = np.zeros_like(grid), np.zeros_like(grid)
        fwd[:, 0] = self.start + grid[:, 0]
        for i in range(1, t):
            fwd[:, i] = np.where(mask[:, i, None], np.logaddexp.reduce(fwd[:, i - 1][:, :, None] + self.move, axis=1) + grid[:, i], fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.where(mask[:, i + 1, None], np.logaddexp.reduce(self.move[None] + (grid[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2), 0.0)
        g = fwd + bwd
        g = np.exp(g - np.logaddexp.reduce(g, axis=2, keepdims=True))
        return g[mask]


def _count(f: np.ndarray, weight: np.ndarray, lengths: list[int]) -> LineModel:
    k = len(STATES)
    start, move = np.full(k, 0.5), np.full((k, k), 0.5)
    at = 0
    for n in lengths:
        w = weight[at : at + n]
        start += w[0]
        move += w[:-1].T @ w[1:]
        at += n
    emit = []
    for j, size in enumerate(SIZES):
        e = np.full((k, size), 0.1)
        for v in range(size):
            e[:, v] += weight[f[:, j] == v].sum(0)
        for state, feature, value in NEVER:
            if feature == j:
                e[state, value] = 1e-9
        emit.append(e / e.sum(1, keepdims=True))
    return LineModel(start / start.sum(), move / move.sum(1, keepdims=True), emit)


def fit_lines(texts: list[tuple[list[str], list[str], str | None]], rounds: int = 2) -> LineModel:
    """The model of (lines, keys, section) triples: seeded, then refined; seeds keep half their weight."""
    feats, lengths, ended = [], [], []
    for lines, keys, section in texts:
        feats.append(features(lines, keys, section))
        lengths.append(len(lines))
        ended += [bool(END.search(x)) for x in lines]
    if not feats:
        lines = ["A line of text", "", "- 1 -"]
        return fit_lines([(lines, [], None)], rounds)
    f = np.vstack(feats)
    seeds = np.eye(len(STATES))[seed(f, np.array(ended))]
    model = _count(f, seeds, lengths)
    for _ in range(rounds):
        model = _count(f, 0.5 * seeds + 0.5 * model.posteriors(f, lengths), lengths)
    return model


# --- words -------------------------------------------------------------------

# Private characters around a hyphen whose sense is still open.
CUT, CUT_END = "\ue000", "\ue001"
STRIP_LEFT = "\"'“”‘’«»([{<*_`~"
STRIP_RIGHT = "\"'“”‘’«»)]}>.,;:!?*_`~…"


def split_words(text: str) -> list[str]:
    """Words with a letter, outer punctuation off, compounds also in parts."""
    out = []
    for w in text.split():
        w = w.lstrip(STRIP_LEFT).rstrip(STRIP_RIGHT)
        if len(w) > 1 and w.lower() != w.upper():
            out.append(w)
            if "-" in w:
                out += [p for p in w.split("-") if len(p) > 1 and p.lower() != p.upper()]
    return out


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n) over all chunks, in the JVM; the same words as :func:`split_words`, in lower case."""
    bare = F.regexp_replace(F.regexp_replace("w", r"^[\"'“”‘’«»(\[{<*_`~]+", ""), r"[\"'“”‘’«»)\]}>.,;:!?*_`~…]+$", "")
    words = chunks.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).select(bare.alias("w"))
    parts = words.select(F.explode(F.when(F.contains("w", F.lit("-")), F.concat(F.array("w"), F.split("w", "-"))).otherwise(F.array("w"))).alias("word"))
    return parts.where(F.col("word").rlike(r"\p{L}") & (F.length("word") > 1)).groupBy("word").agg(F.count("*").alias("n"))


def undo(word: str, depth: int = 2) -> set[str]:
    """Words from which recognition may have made this one, by one confusion, or two if it holds odd characters."""
    odd = any(c in ODD for c in word)
    seen, front = {word}, {word}
    for _ in range(depth if odd else 1):
        new = set()
        for w in front:
            for a, b in CONFUSIONS:
                i = w.find(a)
                while i >= 0:
                    new.add(w[:i] + b + w[i + len(a) :])
                    i = w.find(a, i + 1)
        front = {x for x in new - seen if len(x) > 1}
        seen |= front
        if len(seen) > 5000:
            break
    return seen - {word}


def misread_words(suspects: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, fix): words of ``suspects`` that some known confusion made from a word RATIO times as frequent."""

    def fixes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(w, f) for w in pdf["word"] for f in undo(w)]
            yield pd.DataFrame(rows, columns=["word", "fix"])

    pairs = suspects.select("word").distinct().mapInPandas(fixes, "word string, fix string")
    n_fix = counts.select(F.col("word").alias("fix"), F.col("n").alias("n_fix")).where(f"n_fix >= {RATIO}")
    n_own = counts.select("word", F.col("n").alias("n_own"))
    hit = pairs.join(n_fix, "fix").join(n_own, "word", "left").where(F.col("n_fix") >= RATIO * F.coalesce("n_own", F.lit(1)))
    return hit.groupBy("word").agg(F.max_by("fix", F.struct("n_fix", "fix")).alias("fix"))


# --- reading a chunk -----------------------------------------------------------


def reading(lines: list[str], labels: np.ndarray) -> list[tuple[str, str]]:
    """Blocks of a chunk: (kind, text); body lines are joined across headers and page numbers.

    A divided word is written left + U+E000 + hyphen + U+E001 + right, to be settled later.
    """
    blocks: list[list[str]] = []
    kind = ""
    for line, lab in zip(lines, labels, strict=True):
        if lab in (1, 2):
            continue
        if lab == 3:
            if line.strip():
                blocks.append(["break", line.strip()])
            kind = "break"
            continue
        s = line.strip(" \t\r")
        if kind == "body" and blocks:
            prev = blocks[-1][1]
            if prev[-1:] and prev[-1] in HYPHENS and prev[-2:-1].isalpha() and s[:1].isalpha():
                blocks[-1][1] = prev[:-1] + CUT + prev[-1] + CUT_END + s
            else:
                blocks[-1][1] = prev + " " + s
        else:
            blocks.append(["body", s])
        kind = "body"
    return [(a, b) for a, b in blocks]


DIVIDED = re.compile(rf"(\S*){CUT}(.){CUT_END}(\S*)")


def _core(word: str) -> str:
    return word.lstrip(STRIP_LEFT).rstrip(STRIP_RIGHT)


def _labelled(pdf: pd.DataFrame, model: LineModel) -> Iterator[tuple[object, list[str], np.ndarray]]:
    split = [re.split(r"\r?\n", t) for t in pdf["text"]]
    feats = [features(ln, list(k) if k is not None else [], s) for ln, k, s in zip(split, pdf["keys"], pdf["section"], strict=True)]
    if not split:
        return
    lab = model.decode(np.vstack(feats), [len(x) for x in split])
    at = 0
    for cid, ln in zip(pdf["chunk_id"], split, strict=True):
        yield cid, ln, lab[at : at + len(ln)]
        at += len(ln)


def prepare(chunks: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, LineModel, DataFrame, set[str]]:
    """Chunks with their source's returning lines, the fitted line model, word counts, and the common words that no confusion made."""
    base = chunks.where("chunk_id is not null and length(trim(text)) > 0").select("chunk_id", F.coalesce(F.trim("source_path"), F.lit("")).alias("source"), F.col("section_title").alias("section"), "text")
    base = cut(base)  # read once
    heads = cut(returning_lines(base), loop=True)
    with_keys = base.join(heads.drop("n"), "source", "left") if is_small(heads) else cut(salted_join(base, heads, "source", "n", F.col("chunk_id"), "left"))
    sample = hash_sample(with_keys.where(F.contains("text", F.lit("\n"))), sample_rows, "chunk_id", "text", salt=3)
    model = fit_lines([(re.split(r"\r?\n", r["text"]), list(r["keys"] or []), r["section"]) for r in sample.select("text", "keys", "section").collect()])
    counts = cut(word_counts(base))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * COMMON > F.lit(total)).select("word")  # at most COMMON words
    bad = misread_words(often, counts).select("word").where(~F.col("word").rlike(ROMAN.pattern))  # numerals this frequent are list marks
    often = often.join(bad, "word", "left_anti")
    return with_keys, model, counts, {r["word"] for r in often.collect() if not any(c in ODD for c in r["word"])}


def line_findings(with_keys: DataFrame, model: LineModel, common: set[str]) -> DataFrame:
    """(chunk_id, kind, a, b): headers, page numbers, suspect words (a) and divided words (a joined, b with hyphen)."""
    spark = with_keys.sparkSession
    state = spark.sparkContext.broadcast((model, common))

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, usual = state.value
        for pdf in it:
            rows = []
            for cid, lines, lab in _labelled(pdf, m):
                if (lab == 1).any():
                    rows.append((cid, "header", "", ""))
                if (lab == 2).any() or any(lab[i] == 1 and beside(lines[i])[1] for i in range(len(lines))):
                    rows.append((cid, "page_no", "", ""))
                for kind, text in reading(lines, lab):
                    if kind != "body":
                        continue
                    for d in DIVIDED.finditer(text):
                        left, h, right = d.groups()
                        if left.lstrip(STRIP_LEFT) and right.rstrip(STRIP_RIGHT) and CUT not in left + right:
                            rows.append((cid, "sure" if h in ALWAYS_DIVIDES else "divided", _core(left + right).lower(), _core(left + "-" + right).lower()))
                    whole = DIVIDED.sub(lambda d: d.group(1) + d.group(3), text)
                    for w in {x.lower() for x in split_words(whole)}:
                        if w not in usual:
                            rows.append((cid, "word", w, ""))
            yield pd.DataFrame(rows, columns=["chunk_id", "kind", "a", "b"])

    return with_keys.select("chunk_id", "section", "text", "keys").mapInPandas(scan, "chunk_id bigint, kind string, a string, b string")


def divided_words(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``findings`` whose hyphen divides a word: the corpus doesn't write it with a hyphen, or more often without."""
    d = findings.where("kind in ('divided', 'sure')")
    joined = counts.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    hyphened = counts.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return d.join(joined, "a", "left").join(hyphened, "b", "left").where((F.col("kind") == "sure") | (F.coalesce("n_a", F.lit(0)) >= F.coalesce("n_b", F.lit(0)))).select("chunk_id", "a", "b")


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise): one row per chunk and kind of noise: hyphen, char, header, page_no."""
    with_keys, model, counts, common = prepare(chunks)
    findings = cut(line_findings(with_keys, model, common))
    lines = findings.where("kind in ('header', 'page_no')").select("chunk_id", F.col("kind").alias("noise"))
    hyphens = divided_words(findings, counts).select("chunk_id", F.lit("hyphen").alias("noise"))
    words = findings.where("kind = 'word'").select("chunk_id", F.col("a").alias("word"))
    bad = misread_words(words, counts)
    chars = words.join(bad, "word").select("chunk_id", F.lit("char").alias("noise"))
    return lines.unionByName(hyphens).unionByName(chars).distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): the chunk in continuous paragraphs, headers and page numbers out, words joined and put right."""
    spark = chunks.sparkSession
    with_keys, model, counts, common = prepare(chunks)
    findings = cut(line_findings(with_keys, model, common))
    joins = divided_words(findings, counts).groupBy("chunk_id").agg(F.collect_set("b").alias("joins"))
    words = findings.where("kind = 'word'").select("chunk_id", F.col("a").alias("word"))
    fixes = words.join(misread_words(words, counts), "word").groupBy("chunk_id").agg(F.collect_set(F.struct("word", "fix")).alias("fixes"))
    state = spark.sparkContext.broadcast(model)

    def rebuild(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = state.value
        for pdf in it:
            extra = {r.chunk_id: (set(r.joins) if r.joins is not None else set(), {x["word"]: x["fix"] for x in r.fixes} if r.fixes is not None else {}) for r in pdf.itertuples()}
            rows = [(cid, write(reading(lines, lab), *extra[cid])) for cid, lines, lab in _labelled(pdf, m)]
            yield pd.DataFrame(rows, columns=["chunk_id", "text"])

    full = with_keys.join(joins, "chunk_id", "left").join(fixes, "chunk_id", "left")
    done = full.mapInPandas(rebuild, "chunk_id bigint, text string")
    rest = chunks.where("chunk_id is not null and coalesce(length(trim(text)), 0) = 0").select("chunk_id", "text")
    return done.unionByName(rest).groupBy("chunk_id").agg(F.min("text").alias("text"))


def write(blocks: list[tuple[str, str]], joins: set[str], fixes: dict[str, str]) -> str:
    """Blocks as text: divided words settled, misread words replaced in the case of the original."""

    def settle(d: re.Match) -> str:
        left, h, right = d.groups()
        sure = h in ALWAYS_DIVIDES or _core(left + "-" + right).lower() in joins
        return left + right if sure else left + "-" + right

    def put_right(w: re.Match) -> str:
        raw = w.group()
        core = _core(raw)
        whole = fixes.get(core.lower())
        if whole is None and "-" in core:
            whole = "-".join(fixes.get(p.lower(), p) for p in core.split("-"))
        if whole is None or not core:
            return raw
        whole = whole.capitalize() if core[:1].isupper() and not core.isupper() else whole.upper() if core.isupper() else whole
        return raw.replace(core, whole, 1)

    parts = []
    for kind, text in blocks:
        if kind == "body":
            while DIVIDED.search(text):
                text = DIVIDED.sub(settle, text, count=1)
            text = re.sub(r"\S+", put_right, text)
        parts.append(text)
    return "\n\n".join(parts)

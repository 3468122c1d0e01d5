"""Problems 2, 4, 5, 6 and 7 on small tables, against brute force where there is one."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import format_duplicates, label_consensus, linked_splits, luce_ranking, split_overlap

QA = "task_id string, task_type string, instruction string, expected_response string, split string, kept string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- problem 7 ---


def test_format_duplicates(spark):
    t = spark.createDataFrame(
        [
            ("a", "qa", "Topic: X-ray; Request: What is it?", None, None, "x"),
            ("b", "QA.", "REQUEST: what  is it\nTOPIC: xray", None, None, "x"),
            ("b", "QA.", "REQUEST: what  is it\nTOPIC: xray", None, None, "x"),
            ("c", "qa", "Topic: X-ray; Request: What was it?", None, None, "x"),
            ("d", "summaries", "Topic: X-ray; Request: What is it?", None, None, "x"),
            ("e", "qa", None, None, None, "x"),
            ("f", "qa", " ?! ", None, None, "x"),
            ("g", None, "only text", None, None, "x"),
            ("h", "", "«Only  TEXT»", None, None, "x"),
            (None, "qa", "Topic: X-ray; Request: What is it?", None, None, "x"),
        ],
        QA,
    )
    assert rows(format_duplicates.copies(t)) == [("a", "b"), ("g", "h")]
    assert rows(format_duplicates.collapsed(t)) == [("a", 2), ("c", 1), ("d", 1), ("g", 2)]


def test_format_duplicates_piece_without_label_and_empty(spark):
    t = spark.createDataFrame([("a", "qa", "Topic: T; Request: one, two", "", "", ""), ("b", "qa", "Request: one; two | Topic: T", "", "", "")], QA)
    assert rows(format_duplicates.copies(t)) == [("a", "b")]
    assert rows(format_duplicates.copies(t.where("false"))) == []


def test_format_duplicates_hot_group(spark):
    n = 3000
    t = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("task_id"), F.lit("qa").alias("task_type"), F.when(F.col("id") % 3 == 0, "The same!").otherwise(F.concat(F.lit("q "), F.col("id").cast("string"))).alias("instruction"))
    assert format_duplicates.copies(t).count() == n // 3 - 1


# --- problem 6 ---


def test_split_overlap(spark):
    a = "Grofunet reaches 41.5% F1 on DeltaSet [1]. The margin over the plain ranker is 3.2 points. Reviewers asked whether the cache is reused."
    t = spark.createDataFrame(
        [
            ("1", "qa", "How well does Grofunet do on DeltaSet?", a, "train", ""),
            ("2", "qa", "HOW WELL DOES GROFUNET DO ON DELTASET", a.upper(), "test", ""),
            ("3", "qa", "How well does Grofunet do on DeltaSet?", "The margin over the plain ranker is 3.2 points. Grofunet reaches 41.5% F1 on DeltaSet. Reviewers asked wether the cache is reused.", "validation", ""),
            ("4", "qa", "How well does Grofunet do on DeltaSet?", a.replace("41.5", "52.5").replace("3.2", "8.8"), "test", ""),
            ("5", "qa", "How well does Trapunet do on DeltaSet?", a.replace("Grofunet", "Trapunet"), "test", ""),
            ("6", "qa", None, a, "test", ""),
            ("7", "qa", "How well does Grofunet do on DeltaSet?", None, "test", ""),
            ("8", "qa", "How well does Grofunet do on DeltaSet?", a, None, ""),
            (None, "qa", "How well does Grofunet do on DeltaSet?", a, "test", ""),
            ("2", "qa", "HOW WELL DOES GROFUNET DO ON DELTASET", a.upper(), "test", ""),
        ],
        QA,
    )
    assert rows(split_overlap.found(t)) == [("1", "2"), ("1", "3")]
    assert rows(split_overlap.report(t, F.array(F.lit("p")))) == [("test", "p", 1, 1), ("validation", "p", 1, 1)]
    assert rows(split_overlap.found(t.where("false"))) == []


def test_split_overlap_words_added_and_moved(spark):
    q = "Why does Grofunet fail on long tables?"
    plain = "The model loses track of the header cells once the table spans several printed pages"
    numbers = "With 12 layers the margin is 3 points, but on the clean half it grows to 7 points"
    t = spark.createDataFrame(
        [
            ("1", "qa", q, plain + ".", "train", ""),
            ("2", "qa", q, plain.replace("The model", "The large model").replace("several", "many") + ".", "test", ""),
            ("3", "qa", q, "Once the table spans several printed pages, the model loses track of the header cells.", "test", ""),
            ("4", "qa", q, "Annotators disagree about cells that were merged by the extraction of the page.", "test", ""),
            ("5", "qa", q, numbers + ".", "train", ""),
            ("6", "qa", q, "On the clean half it grows to 7 points, but with 12 layers the margin is 3 points.", "validation", ""),
            ("7", "qa", q, None, "train", ""),
            ("8", "qa", "Why does Grofunet fail on very long tables?", "", "test", ""),
        ],
        QA,
    )
    assert rows(split_overlap.found(t)) == [("1", "2"), ("1", "3"), ("5", "6"), ("7", "8")]


def test_split_overlap_counts_groups_of_copies_as_products(spark):
    n = 400
    t = spark.range(2 * n).select(F.col("id").cast("string").alias("task_id"), F.lit("qa").alias("task_type"), F.lit("Why does Grofunet fail on long tables?").alias("instruction"), F.when(F.col("id") < n, "It loses the header cells.").otherwise("IT LOSES THE HEADER CELLS").alias("expected_response"), F.when(F.col("id") < n, "train").otherwise("test").alias("split"))
    assert rows(split_overlap.report(t, F.array(F.lit("p")))) == [("test", "p", n, n * n)]
    links, members = split_overlap.linked_classes(t)
    assert links.count() == 1 and members.count() == 2 * n
    assert rows(split_overlap.exact_counts(t)) == [("test", n, n * n)]
    assert split_overlap.found(t).count() == n * n


def test_split_overlap_rare_words_all_changed(spark):
    """No key may hang on the rarest words alone: here all of those carry typos."""
    q = "Does Grofunet keep its lead over the plain ranker on DeltaSet once the context window is cut to half of its length"
    a = "The lead shrinks to 3 points."
    t = spark.createDataFrame([("1", "qa", q, a, "train", ""), ("2", "qa", q.replace("shrinks", "shrinsk").replace("ranker", "rankre").replace("context", "cotnext").replace("window", "widnow"), a, "test", "")] + [(f"x{i}", "qa", "Does it keep its lead over the plain one on a set once the text is cut to half of its length?", f"{i}", "train", "") for i in range(30)], QA)
    assert rows(split_overlap.found(t)) == [("1", "2")]


def test_split_overlap_names_apart(spark):
    """A question's keys end at its rarest name, which may be written apart in the other one."""
    a = "The lead shrinks to 3 points."
    q = "Does Grofunet keep its lead over the plain ranker once the context window is cut"
    apart = [q, q.replace("Grofunet", "Gro funet"), q.replace("Grofunet", "gro fu net"), q.replace("Grofunet", "Gorfunet"), q.upper().replace("PLAIN", "OLD"), q.replace("Grofunet", "Trapunet")]
    for x, y in ((0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (0, 4), (4, 0), (1, 2), (3, 4), (0, 5)):
        t = spark.createDataFrame([("1", "qa", apart[x], a, "train", ""), ("2", "qa", apart[y], a, "test", "")], QA)
        same = split_overlap.may_be_same_question(apart[x], apart[y]) and split_overlap.same_question(apart[x], apart[y])
        assert rows(split_overlap.found(t)) == ([("1", "2")] if same else []), (x, y)


def test_split_overlap_keys_grow_with_names_not_words():
    """Many keys of common words made many candidates: 51 keys a record, and 90 candidates for each true pair."""
    q = "In the study of phase picking with Foflenet, which pass rate is reached on RookTransit once the seed is varied over five runs?"
    keys = split_overlap.question_keys(q, {split_overlap._letters(w): 9 for w in split_overlap._split_words(q) if w != "foflenet"})
    assert keys == [" " + split_overlap._letters("foflenet")]


def test_steps_between_are_packed_and_released(spark):
    import os

    from foliospark.plans import scale

    df = spark.range(20_000).select(F.lit("the same text " * 20).alias("t"), "id").repartition(4)
    p = scale.packed(df)
    assert p.dtypes == df.dtypes and p.count() == 20_000
    path = p._packed.removeprefix("file:")
    assert sum(os.path.getsize(os.path.join(path, x)) for x in os.listdir(path)) < 20_000 * 280 / 10
    scale.release(p)
    assert not os.path.exists(path)


def test_word_checks():
    assert split_overlap.same_question("Why does it fall?", "Why does it flal?")
    assert not split_overlap.same_question("Is the F1 of Grofunet 3?", "Is the F1 of Grofunet 4?")
    assert not split_overlap.same_answer("Table 3", "Table 4")
    assert split_overlap.same_answer("", "")


# --- problem 4 ---


def union_find(recs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, paths in recs:
        find(("r", i))
        for p in paths or []:
            for m in re.findall(linked_splits.ARXIV_NUMBER, (p or "").lower()):
                parent[find(("p", m))] = find(("r", i))
    best = {}
    for i, _ in recs:
        k = find(("r", i))
        best[k] = min(best.get(k, i), i)
    return {i: best[find(("r", i))] for i, _ in recs}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    recs = [(f"t{i:03d}", [f"x/2501.{rng.randrange(10000, 10060)}v{rng.randrange(1, 4)}.pdf" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]) for i in range(150)]
    recs += [("n1", None), ("n2", [None, ""]), recs[0]]
    df = spark.createDataFrame(recs, "id string, paths array<string>")
    got = {r.task_id: r.group_id for r in linked_splits.found(df).collect()}
    assert got == union_find(recs)


def test_long_chain(spark):
    recs = [(f"t{i:03d}", [f"2501.{10000 + i}", f"2501.{10001 + i}"]) for i in range(70)]
    df = spark.createDataFrame(recs, "id string, paths array<string>")
    assert {r.group_id for r in linked_splits.found(df).collect()} == {"t000"}


def test_incremental_splits(spark):
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    first = linked_splits.records(spark.createDataFrame([(f"a{i:03d}", [f"2501.{20000 + i}"]) for i in range(200)], "id string, paths array<string>"))
    table, splits = linked_splits.assign_splits(first, targets)
    n = {r.split: r.n for r in splits.groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    assert abs(n["train"] - 160) <= 2 and sum(n.values()) == 200
    known = {r.component: r.split for r in splits.collect()}
    by = {s: [c for c, x in sorted(known.items()) if x == s] for s in ("train", "test")}
    both = [by["train"][0], by["test"][0]]
    more = linked_splits.records(spark.createDataFrame([("z1", both), ("z2", [by["train"][1]]), ("z3", ["2501.99999"])], "id string, paths array<string>"))
    _, again = linked_splits.assign_splits(more, targets, table, splits)
    got = {r.component: (r.split, r.state) for r in again.collect()}
    assert got[min(both)] == (None, "quarantined")
    assert got[by["train"][1]] == ("train", "kept")
    assert got["2501.99999"][1] == "new" and got["2501.99999"][0] in ("train", "test")


def test_incremental_splits_count_earlier_batches(spark):
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    schema = "id string, paths array<string>"
    known = spark.createDataFrame([(f"2501.{20000 + i}", f"2501.{20000 + i}") for i in range(3)], "entity string, component string")
    splits = spark.createDataFrame([("2501.20000", "train", 60), ("2501.20001", "test", 38), ("2501.20002", "train", 1), ("id:lone", "test", 1)], "component string, split string, n_records bigint")
    batch = [(f"b{i:03d}", [f"2501.{30000 + i}"]) for i in range(100)] + [("again", ["2501.20000"]), ("more", ["2501.20000"]), ("lone", None), ("bridge", ["2501.20000", "2501.20002"])]
    seen = spark.createDataFrame([("again",)], "id string")
    _, after = linked_splits.assign_splits(linked_splits.records(spark.createDataFrame(batch, schema)), targets, known, splits, seen)
    got = {r.component: (r.split, r.n_records, r.state) for r in after.collect()}
    assert got["2501.20000"] == ("train", 63, "kept")
    assert got["2501.20001"] == ("test", 38, "kept") and got["id:lone"] == ("test", 1, "kept")
    n = {r.split: r.n for r in after.groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    assert sum(n.values()) == 202 and abs(n["test"] - 40.4) <= 1.5


def test_batch_splits(spark):
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    one = linked_splits.records(spark.createDataFrame([(f"a{i:02d}", [f"2501.{20000 + i}"]) for i in range(20)] + [("x", None)], "id string, paths array<string>"))
    two = linked_splits.records(spark.createDataFrame([(f"b{i:02d}", [f"2501.{20000 + i}"]) for i in range(0, 40, 2)] + [("a00", ["2501.20000"]), ("x", None)], "id string, paths array<string>"))
    got = {r.id: (r.component, r.split) for r in linked_splits.batch_splits([one, two], targets).collect()}
    assert len(got) == 41 and all(got[f"a{i:02d}"] == got[f"b{i:02d}"] for i in range(0, 20, 2))
    assert abs(sum(s == "train" for _, s in got.values()) - 20.5) <= 1.5


def test_record_that_names_a_paper_later_keeps_its_split(spark, tmp_path):
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    schema = "id string, paths array<string>"
    path = str(tmp_path / "state")
    assert linked_splits.load(spark, path) is None
    linked_splits.advance(linked_splits.records(spark.createDataFrame([(f"a{i}", None) for i in range(8)], schema)), targets, path)
    before = {r.component: r.split for r in linked_splits.load(spark, path)[1].collect()}
    linked_splits.advance(linked_splits.records(spark.createDataFrame([(f"a{i}", [f"2501.{20000 + i}"]) for i in range(4)] + [("b", ["2501.20000"])], schema)), targets, path)
    _, splits, ids = linked_splits.load(spark, path)
    after = {r.component: (r.split, r.n_records, r.state) for r in splits.collect()}
    assert after["2501.20000"] == (before["id:a0"], 2, "kept") and after["2501.20001"] == (before["id:a1"], 1, "kept")
    assert after["id:a7"] == (before["id:a7"], 1, "kept") and ids.count() == 9


# --- problem 5 ---


def test_ilsr_finds_maximum_likelihood():
    rng = np.random.default_rng(1)
    s = np.exp(rng.normal(size=6))
    wins = np.zeros((6, 6))
    for i, j in itertools.permutations(range(6), 2):
        wins[i, j] = 200 * s[i] / (s[i] + s[j]) * rng.uniform(0.5, 1)
    got = luce_ranking.ilsr(wins)
    grad = [sum(wins[i, j] / got[i] - (wins[i, j] + wins[j, i]) / (got[i] + got[j]) for j in range(6) if j != i) for i in range(6)]
    assert np.abs(np.array(grad) * got).max() < 1e-5


M = "match_id bigint, winner string, model_a string, model_b string, model_name string"


def test_ranking_cases(spark):
    cards = spark.createDataFrame([("m-1",), ("m-2",), ("m-3",), (None,)], "model_name string")
    games = spark.createDataFrame(
        [(1, "A", "m-1", "M_2", ""), (1, "A", "m-1", "M_2", ""), (2, " b", "m-2", "m-1", ""), (3, "tie", "m-1", "m-2", ""), (4, "A", "m-2", "m-2", ""), (5, None, "m-2", "m-1", ""), (6, "A", "unknown", "m-1", "")], M
    )
    got = {r.model_name: r for r in luce_ranking.rank(games, cards).collect()}
    assert [got[m].model_rank for m in ("m-1", "m-3", "m-2")] == [1, 2, 3]
    assert got["m-1"].games == 3 and got["m-3"].games == 0
    empty = rows(luce_ranking.found(games.where("false"), cards))
    assert empty == [("m-1", 1), ("m-2", 2), ("m-3", 3)]


def test_ranking_on_cluster_agrees(spark):
    """1,000 items, one of them in a third of all games: the same ranks and log strengths as the exact solution."""
    n, rng = 1000, np.random.default_rng(0)
    strong = np.exp(rng.normal(size=n))
    i = np.where(rng.random(12000) < 1 / 3, 0, rng.integers(n, size=12000))
    j = rng.integers(n, size=12000)
    a_wins = rng.random(12000) < strong[i] / (strong[i] + strong[j])
    games = spark.createDataFrame([(k, "A" if w else "B", f"m{x:04d}", f"m{y:04d}", "") for k, (w, x, y) in enumerate(zip(a_wins.tolist(), i.tolist(), j.tolist(), strict=True))], M)
    cards = spark.createDataFrame([(f"m{k:04d}",) for k in range(n)], "model_name string")
    one = {r.model_name: r for r in luce_ranking.rank(games, cards).collect()}
    two = {r.model_name: r for r in luce_ranking.rank(games, cards, dense_items=0).collect()}
    assert max(abs(np.log(one[m].strength) - np.log(two[m].strength)) for m in one if one[m].strength > 1e-3) < 1e-6
    assert {m: r.model_rank for m, r in one.items()} == {m: r.model_rank for m, r in two.items()}
    assert {m: r.games for m, r in one.items()} == {m: r.games for m, r in two.items()}


# --- problem 2 ---

J = "pair_id string, judge_name string, verdict string, error string, label string"


def test_consensus_beats_majority(spark):
    rng = random.Random(5)
    labels = ["win_a", "win_b", "tie"]
    data, truth = [], {}
    for i in range(300):
        y = rng.choice(labels)
        truth[f"p{i}"] = y
        for j in range(3):
            data.append((f"p{i}", f"good{j}", y if rng.random() < 0.85 else rng.choice(labels), None, ""))
        for j in range(3):
            data.append((f"p{i}", f"bad{j}", "win_a", None, ""))
    data += [data[0], ("lone", "good0", "TIE ", "", ""), ("none", "good0", None, "boom", ""), (None, "good0", "tie", None, ""), ("p1", None, "tie", None, "")]
    items, model = label_consensus.judgments_model(spark.createDataFrame(data, J))
    got = {r.item: r for r in label_consensus.consensus(items, model).collect()}
    assert set(got) == set(truth) | {"lone", "none"}
    assert np.mean([got[p].label == y for p, y in truth.items()]) > 0.9
    assert got["none"].n_votes == 0 and got["none"].agreement is None and got["lone"].agreement is None
    rel = {r.annotator: r.reliability for r in label_consensus.reliability(items, model).collect()}
    assert min(rel[f"good{j}"] for j in range(3)) > max(rel[f"bad{j}"] for j in range(3))


def test_consensus_empty(spark):
    t = spark.createDataFrame([("p", "a", "tie", None, "")], J)
    assert rows(label_consensus.found(t.where("false"))) == []


def test_consensus_with_tilts_as_table(spark):
    rng = random.Random(6)
    data = []
    for i in range(60):
        y = rng.choice(label_consensus.VERDICTS)
        data += [(f"p{i}", f"j{j}", y if rng.random() < 0.4 + 0.12 * j else rng.choice(label_consensus.VERDICTS), None, "") for j in range(5)]
    data.append(("none", "j0", None, "boom", ""))
    items = label_consensus.gather(spark.createDataFrame(data, J), "pair_id", "judge_name", "verdict", F.col("verdict").isNull(), label_consensus.VERDICTS).cache()
    a = label_consensus.fit(items, label_consensus.VERDICTS)
    b = label_consensus.fit(items, label_consensus.VERDICTS, max_annotators=1)
    assert a["moved"] < 1e-3 and b["moved"] < 1e-3 and a["iterations"] <= b["iterations"]
    assert np.allclose(a["share"], b["share"], atol=0.01) and "table" in b
    one = {r.item: (r.label, round(r.confidence, 1)) for r in label_consensus.consensus(items, a).collect()}
    two = {r.item: (r.label, round(r.confidence, 1)) for r in label_consensus.consensus(items, b).collect()}
    assert one == two and len(one) == 61
    ra, rb = ({r.annotator: r.reliability for r in label_consensus.reliability(items, m).collect()} for m in (a, b))
    assert ra.keys() == rb.keys() and all(abs(ra[j] - rb[j]) < 0.01 for j in ra)

"""Problems 1, 3, 8, 9 and 10 on small tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import mixing, packing, pair_defects, residue, scan_repair, token_sizes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- problem 1 ---

Q = "How does the calibration error of Grofunet change on DeltaSet when the batch size is doubled?"
GOOD = "The error drops from 41.5% to 38.2% on DeltaSet [1]. The margin over the plain ranker is 3.2 points."


def test_pair_defects(spark):
    cases = [
        ("ok", Q, GOOD, None),
        ("null", Q, None, "empty"),
        ("blank", Q, "  \n", "empty"),
        ("tags", Q, "<p></p>", "empty"),
        ("dash", Q, "—", "empty"),
        ("short", Q, "Table 7", None),
        ("no", Q, "No", None),
        ("cut", Q, GOOD + " The margin over the", "truncated"),
        ("comma", Q, "The error drops from 41.5% to 38.2%,", "truncated"),
        ("item", Q, "- DeltaSet: 41.5% of the plain ranker\n- EtaSet: 38.2 points", None),
        ("refuse", Q, "I'm sorry, but I cannot answer this question.", "refusal"),
        ("report", Q, 'Replies such as "I cannot answer" make up 22.0% of the output on DeltaSet.', None),
        ("copy", Q, "You ask: " + Q.lower(), "copies_question"),
        ("restated", Q, Q + " " + GOOD, None),
        ("german", Q, "Die Methode erreicht auf DeltaSet einen Wert von 41.5 Prozent und liegt damit über dem Vergleichssystem.", "other_language"),
        ("asked", "Please reply in German. " + Q, "Die Methode erreicht auf DeltaSet einen Wert von 41.5 Prozent und liegt damit über dem Vergleichssystem.", None),
        ("noq", None, GOOD, None),
    ]
    extra = [(f"g{i}", Q, GOOD, None) for i in range(30)]
    df = spark.createDataFrame([("t", i, q, a) for i, q, a, _ in cases + extra + cases[:2]], "table_name string, record_id string, q string, a string")
    got = {r.record_id: r.defect for r in pair_defects.defects(df).collect()}
    assert got == {i: d for i, _, _, d in cases if d}
    assert pair_defects.defects(df.where("false")).count() == 0


def test_pair_defects_counts_every_answer(spark):
    """Each of these ends is whole by one answer alone, wherever it stands among more than 20,000 pairs; a sample held about half."""
    words = ["quorble", "zentrify", "plavish", "mordax", "trindle", "fescule", "wambert", "yostrel"]
    schema = "table_name string, record_id string, q string, a string"
    filler = spark.range(40_000).select(F.lit("t").alias("table_name"), F.concat(F.lit("f"), "id").alias("record_id"), F.lit(None).cast("string").alias("q"), F.lit("Yes.").alias("a"))
    known = [("t", f"k{w}", Q, f"Nothing else was ever called a {w}.") for w in words]
    asks = [("t", f"a{w}", Q, f"In the end all of the readers preferred a {w}") for w in words]
    cut = [("t", "cut", Q, "In the end all of the readers preferred an unseenw")]
    df = filler.unionByName(spark.createDataFrame(known + asks + cut, schema))
    assert rows(pair_defects.defects(df)) == [("t", "cut", "truncated")]
    # In parts, if more contexts are asked for than the driver may hold.
    small = spark.createDataFrame(known + asks + cut, schema)
    assert rows(pair_defects.defects(small, max_contexts=3)) == [("t", "cut", "truncated")]


def test_pair_defects_long_text(spark):
    df = spark.createDataFrame([("t", "long", Q, "Grofunet gains 3.2 points. " * 20000)], "table_name string, record_id string, q string, a string")
    assert pair_defects.defects(df).count() == 0


def test_pair_defects_without_length_limits():
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(50_000))
    assert pair_defects.is_copy(long, long.upper())  # beyond 300,000 characters
    assert pair_defects.is_copy(Q, (Q + " ") * 4)
    assert not pair_defects.is_copy(long, long[:4000])
    assert pair_defects.is_empty("<" + "b" * 500 + ">") and not pair_defects.is_refusal('The reply "' + "so it is, " * 60 + 'I cannot answer" was counted.')


def test_refusals_by_combination():
    declines = [
        "Unfortunately that falls outside what this assistant may discuss.",
        "Sorry, no can do.",
        "The error falls. It is 41.5 there. I cannot answer this question. I do not know.",
        "This assistant is not able to comment on the paper.",
        "Your question cannot be answered with what I was given.",
        "No answer can be provided here.",
        "It is impossible for me to tell.",
        "I'm not permitted to share that.",
        "Leider darf ich dazu nichts sagen.",
        "Je ne suis malheureusement pas en mesure de répondre.",
        "Lo siento, pero no puedo ayudar con eso.",
        "Jag kan tyvärr inte svara på frågan.",
        "Desværre kan jeg ikke svare på det.",
    ]
    reports = ["We could not reproduce the published pass rate of 49.9% with these settings.", "The model cannot use the table when cells are merged.", "Refusals such as 'I cannot answer' make up 4% of the output.", "No reply exceeds 200 words."]
    assert [x for x in declines if not pair_defects.is_refusal(x)] == []
    assert [x for x in reports if pair_defects.is_refusal(x)] == []


def test_languages_beyond_the_sample():
    en = ["The model reads the table from left to right and then asks for the next page of it.", GOOD] * 20
    _, profiles = pair_defects.fit([(Q, x) for x in en])
    assert pair_defects.is_other_language(Q, "Metoden når ett värde på 41,5 procent och ligger därmed över den andra modellen, men bara när tabellen är kort.", profiles)
    assert pair_defects.is_other_language(Q, "Metoden når en værdi på 41,5 procent og ligger dermed over den anden model, men kun når tabellen er kort.", profiles)
    assert pair_defects.language("The table spans pages; readers lose headers quickly.", profiles) in ("en", None)
    assert not pair_defects.is_other_language(Q, "- Petrichor-S: 69.8% accuracy\n- Petrichor-S: 48.5% rank correlation", profiles)
    assert pair_defects.language("«Under which setting does the model fall behind?»", profiles) == "en"


# --- problem 3 ---

WORDS = "the method reaches higher accuracy because every passage carries number labels which annotators checked twice before training began again without further changes".split()


def page_text(rng, header, number, hyphen=False, char=False):
    words = [rng.choice(WORDS) for _ in range(60)]
    if char:
        words[20] = "trainin9"
        words[21] = "acc!racy".replace("!", "u¢"[0])
        words[22] = "p¢ssage".replace("¢", "a")
        words[23] = "ch¢cked"
    lines = [" ".join(words[i : i + 10]) for i in range(0, 60, 10)]
    lines[0] = lines[0].capitalize()
    lines[-1] += "."
    if hyphen:
        lines[1] = lines[1] + " accu-"
        lines[2] = "racy " + lines[2]
    if header:
        lines.insert(0, header)
    if number:
        lines.append(f"- {number} -")
    return "\n".join(lines)


def scan_table(spark):
    rng = random.Random(1)
    data = []
    for i in range(60):
        data.append((i, "p/one.txt", page_text(rng, "Lorem et al." if i % 3 == 0 else None, i + 1 if i % 5 == 0 else None, hyphen=i % 7 == 0, char=i % 11 == 0), None))
    data += [(100, "p/one.txt", None, None), (101, None, "One line only.", None), (102, "", "", None), (103, "p/two.txt", "Table 4\nbase   56.8   94.0\n2 Methods\nThe method reaches higher accuracy.", "x"), (None, "p/two.txt", "- 3 -", None), data[0]]
    return spark.createDataFrame(data, "chunk_id bigint, source_path string, text string, section_title string").withColumn("n", F.lit(1))


def test_scan_noise(spark):
    got = rows(scan_repair.found(scan_table(spark)))
    assert len(got) == len(set(got))
    by = lambda k: {c for c, n in got if n == k}
    assert by("header") == {i for i in range(60) if i % 3 == 0}
    assert by("page_no") == {i for i in range(60) if i % 5 == 0}
    assert by("hyphen") == {i for i in range(60) if i % 7 == 0}
    assert by("char") == {i for i in range(60) if i % 11 == 0}


def test_scan_repair(spark):
    t = scan_table(spark)
    got = {r.chunk_id: r.text for r in scan_repair.repaired(t).collect()}
    assert set(got) == {*range(60), 100, 101, 102, 103}
    assert "accuracy" in got[0] and "accu-" not in got[0] and "Lorem" not in got[0] and "- 1 -" not in got[0] and "\n" not in got[0]
    assert "trainin9" not in got[11] and "checked" in got[0]
    assert got[100] is None and got[101] == "One line only." and got[102] == ""
    assert got[103].split("\n\n")[:3] == ["Table 4", "base   56.8   94.0", "2 Methods"]
    assert rows(scan_repair.found(t.where("false"))) == []


def test_fold_and_undo():
    assert scan_repair.fold("Lorem et al.") == scan_repair.fold("L0rcrn et a1.")
    assert "model" in scan_repair.undo("modcl") and "volume" in scan_repair.undo("voliime")


def test_frequent_misread_word(spark):
    text = "The passage was checked with care by all in turn " * 60 + "(iii) and then witli care again."
    df = spark.createDataFrame([(i, "p/a.pdf", None, text) for i in range(8)], "chunk_id bigint, source_path string, section_title string, text string")
    assert sorted(map(tuple, scan_repair.found(df).collect())) == [(i, "char") for i in range(8)]
    assert all("witli" not in r.text and "then with care again" in r.text for r in scan_repair.repaired(df).collect())


# --- problem 8 ---

D = "doc_id bigint, text string, source string, piece int"
BINS = "bin_name string, capacity_tokens int"


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 120)), "s", 9) for i in range(400)] + [(900, "> quoted line\n" + "word " * 30, "s", 9), (901, None, "s", 9), (902, "", "s", 9), (903, "word " * 1000, "s", 9), (None, "word", "s", 9)]
    t = spark.createDataFrame(docs, D)
    bins = spark.createDataFrame([("small", 100), ("big", 512), ("bad", None)], BINS)
    p = packing.pack(t, bins, block_items=64).cache()
    sizes = {r.doc_id: r.tokens for r in token_sizes.sizes(t).collect()}
    per = p.groupBy("bin_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"), F.count("container_id").alias("c")).collect()
    assert len(per) == 2 * 404 and all(r.t == sizes[r.doc_id] for r in per)
    caps = {"small": 100, "big": 512}
    assert all((r.k == 1) or sizes[r.doc_id] > caps[r.bin_name] for r in per)
    assert all((r.c == 0) == (sizes[r.doc_id] == 0) for r in per)
    fill = p.where("container_id is not null").groupBy("bin_name", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k")).collect()
    assert all(r.t <= caps[r.bin_name] and r.k <= max(1, caps[r.bin_name] // packing.TOKENS_PER_SEGMENT) for r in fill)
    report = {r.bin_name: r.fill for r in packing.fill_report(p, bins).collect()}
    assert min(report["small"], report["big"]) > 0.9
    assert packing.pack(t.where("false"), bins).count() == 0 and packing.pack(t, bins.where("false")).count() == 0


def test_packing_under_tight_limits(spark):
    rng = random.Random(7)
    texts = [" ".join(["word"] * rng.randrange(1, 110)) for _ in range(200)] + ["> " + "quoted " * 60 + "\nreply " * 30] * 20 + ["> " + "quoted " * 150 + "\n" + "reply " * 200] * 5
    t = spark.createDataFrame([(i, x, "s", 0) for i, x in enumerate(texts)], D)
    bins = spark.createDataFrame([("small", 100)], BINS)
    tight = {"tokens_per_segment": 45, "loss_share": 0.8}
    p = packing.pack(t, bins, block_items=64, **tight).cache()
    assert rows(packing.breaches(p, t, bins, **tight)) == [("small", 225, 0, 0, 0, 0, 0)]
    report = packing.fill_report(p, bins, **tight).first()
    assert report.at_loss > 0 and report.at_segments > 0


def test_context_ranges_count_quoted_tokens():
    n, r = token_sizes.context_ranges("first line\n> a quoted line of words\nlast line")
    assert n == token_sizes.count_tokens(["first line\n> a quoted line of words\nlast line"])[0]
    assert len(r) == 1 and 5 <= r[0][1] - r[0][0] <= 8
    assert token_sizes.context_ranges("no quotation")[1] == []


def test_pack_block_obeys_every_limit():
    rng = np.random.default_rng(0)
    tokens = np.sort(rng.integers(1, 90, 300))[::-1]
    loss = np.minimum(tokens, rng.integers(0, 60, 300))
    slot = packing.pack_block(tokens, loss, 100, 4, 60)
    for k in range(slot.max() + 1):
        m = slot == k
        assert tokens[m].sum() <= 100 and m.sum() <= 4 and loss[m].sum() <= 60
    assert (slot >= 0).all()


# --- problem 9 ---


def test_mixing(spark):
    docs = [(i, "word " * (20 + i % 30), "Big-Source" if i % 3 else "small source", 0) for i in range(600)]
    docs += [(7000, None, "small_source", 0), (7001, "word", None, 0), (7002, "word", "other", 0), (None, "word", "big_source", 0)]
    t = spark.createDataFrame(docs, D)
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.5, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(t, targets).cache()
    got = {r.source: r for r in mixing.share_report(m, targets).collect()}
    assert abs(got["big_source"].actual_share - 0.5) < 0.01 and got["big_source"].max_used == 1 and got["small_source"].max_used <= 4
    r = m.collect()
    assert [x.position for x in r] == sorted(x.position for x in r) and 0 <= r[0].position and r[-1].position <= 1
    used = m.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("c")).collect()
    assert all(x.n == x.c for x in used)
    assert mixing.mixture(t.where("false"), targets).count() == 0


def test_schedule_changes_over_time(spark):
    t = spark.createDataFrame([(i, "word " * 30, "a" if i % 2 else "b", 0) for i in range(1000)], D)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(t, targets, slopes={"a": 0.5, "b": -0.5})
    early = m.where("position < 0.25").groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in early}
    assert n["b"] > 1.5 * n["a"]


# --- problem 10 ---


def test_residue(spark):
    prose = "Gateway logs were read by hand, and every table carries a page number. " * 5
    cases = [
        (1, prose, None),
        (2, prose + "\n\nPage not found. Try again later.", "message"),
        (3, "Bitte aktivieren Sie JavaScript, um den Inhalt anzuzeigen.", "message"),
        (4, "Dear {{name}}, your review of {{title}} is due.", "template"),
        (5, 'Each record is rendered with the pattern "{{title}} ({{year}})", where both fields come from the catalogue.', None),
        (6, 'An answer built on a "page not found" message was preferred in 10.2% of the cases that we looked at.', None),
        (7, "Lorem ipsum dolor sit amet consectetur.", "filler"),
        (8, "We write $x_{i}$ for the score of item i and [1, 2] for the interval, so that \\frac{a}{b} is bounded.", None),
        (9, "", None),
        (10, None, None),
        (11, "xxxx xxxxx xxxx test test test", "filler"),
    ]
    t = spark.createDataFrame([(i, x, "s", 0) for i, x, _ in cases] + [(4, cases[3][1], "s", 0), (None, "Page not found.", "s", 0)], D)
    got = {r.doc_id: r.kind for r in residue.residue(t).collect()}
    assert got == {i: k for i, _, k in cases if k}
    assert rows(residue.found(t)) == sorted([(i,) for i, _, k in cases if k], key=repr)
    assert {r.doc_id for r in residue.clean(t).collect()} == {None, *(i for i, _, k in cases if not k)}
    assert residue.residue(t.where("false")).count() == 0

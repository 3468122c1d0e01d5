"""Column functions and operators on small fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import citations as C
from foliospark.functions import plugins, quality, text
from foliospark.operators import catalog, chunking, compare, dataset, pairwise, reports, retrieval, scoring
from foliospark.plans import scale
from foliospark.sources import readers, writers
from foliospark.streaming import incremental as inc


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], schema).select(expr.alias("x")).first()["x"]


def s(spark, expr, t):
    return one(spark, expr, t=("string", t))


T = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """Columns need a session."""
    global T
    T = F.col("t")


def test_words_and_normal_forms(spark):
    assert s(spark, text.words(T), " a b\tc ") == ["a", "b", "c"]
    assert s(spark, text.words(T), None) == []
    assert s(spark, text.normalise_instruction(T), "  What  is X?! ") == "what is x"
    assert s(spark, text.preview(T, 10), "abcdefghijkl") == "abcdefg..."
    assert s(spark, text.path_stem(T), "a/b/2501.12345.pages.txt") == "2501.12345.pages"
    assert s(spark, text.slug(T), "A  Paper: One!") == "a-paper-one"
    assert s(spark, text.as_int(T), "x1") is None and s(spark, text.as_int_via_float(T), "3.9") == 3
    assert s(spark, text.as_bool(T, True), "No") is False and s(spark, text.as_bool(T, True), "??") is True
    assert s(spark, text.task_type(T), " Summary. ") == "summaries"
    assert s(spark, text.version(T), "2501.1v12") == "12" and s(spark, text.version(T), "2501.1") == "1"
    assert s(spark, text.stop_at(T, ["END"]), "keep  END rest") == "keep"
    assert s(spark, text.head_and_tail(T, 4), "abcdefgh") == "ab\n\n...\n\ngh"
    assert s(spark, text.paper_id(F.lit(None).cast("string"), T), "paper_name_qa_0") == "paper_name"
    assert len(s(spark, text.chat_messages(T, F.lit("a"), F.lit(" ")), "q")) == 2


def test_word_chunks(spark):
    got = s(spark, chunking.word_chunks(T, 20, 5), " ".join(f"w{i}" for i in range(100)))
    assert len(got) == 7 and len(got[0].split()) == 20 and got[0].split()[-5:] == got[1].split()[:5] and len(got[-1].split()) == 10
    assert s(spark, chunking.word_chunks(T, 20, 5), "") == [] and s(spark, chunking.word_chunks(T, 20, 5), "a b") == ["a b"]
    with pytest.raises(ValueError):
        chunking.check_window(5, 5)


def brute_sentences(t):
    import re

    c = re.sub(r"\s+", " ", t).strip()
    out, open_ = [], ""
    for p in re.findall(r"[^.!?]*[.!?]|[^.!?]+$", c):
        open_ += p
        if open_[-1] in ".!?" and open_.strip() and not any(open_.strip().lower().endswith(a) for a in chunking.ABBREVIATIONS):
            out.append(open_.strip())
            open_ = ""
    if open_.strip():
        out.append(open_.strip())
    merged = []
    for p in out:
        if merged and len(p.split()) < 3:
            merged[-1] += " " + p
        else:
            merged.append(p)
    return merged


def brute_sentence_chunks(t, size, overlap):
    tail, cur, out = [], [], []
    for p in brute_sentences(t):
        w = p.split()
        if not cur or len(tail) + len(cur) + len(w) <= size:
            cur += w
        else:
            full = tail + cur
            out.append(" ".join(full))
            tail, cur = full[len(full) - overlap :] if overlap else [], list(w)
    if cur:
        out.append(" ".join(tail + cur))
    return out


def test_sentences_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["One two three.", "See Fig. 3 for it.", "Yes!", "e.g. this one", "Is it so?", "A b c d e f g h.", "etc.", "Dr. No came in late today."]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", chunking.sentences(T).alias("a"), chunking.sentence_chunks(T, 12, 3).alias("b"), chunking.sentence_chunks(T, 12, 0).alias("c")).collect():
        assert r.a == brute_sentences(r.t)
        assert r.b == brute_sentence_chunks(r.t, 12, 3) and r.c == brute_sentence_chunks(r.t, 12, 0)


def test_sections_and_spans(spark):
    pages = spark.createDataFrame([("d", 1, "1 Introduction", "a"), ("d", 2, None, "b"), ("d", 3, "2 Methods", "c"), ("d", 4, " ", "d")], "doc string, page int, title string, text string")
    got = [tuple(r) for r in chunking.section_groups(pages, "doc", "page", "title", "text").orderBy("section").collect()]
    assert got == [("d", 1, "1 Introduction", 1, 2, "a\n\nb"), ("d", 2, "2 Methods", 3, 4, "c\n\nd")]
    rows = spark.createDataFrame([("A", 0, 1, 0, 50), ("A", 1, 2, None, 90), ("A", 2, 3, 10, 5), ("A", 3, 4, 4, 30), ("B", 0, 5, 0, None)], "source_path string, chunk_index int, chunk_id bigint, token_start int, token_end int")
    kinds = sorted((r.chunk_id, r.kind) for r in chunking.span_issues(rows).collect())
    assert kinds == [(2, "missing_span"), (3, "non_positive_length"), (4, "non_monotonic_start"), (5, "missing_span")]


def test_citations(spark):
    ctx = ["Paris is the capital of France.", "Berlin is the capital of Germany."]
    df = spark.createDataFrame([("The capital of France is Paris. [1]", ctx), ("Refer to [3] and [99] here.", ctx), ("", []), (None, ctx)], "a string, c array<string>")
    v, e = C.verify(F.col("a"), F.col("c")), C.evaluate(F.col("a"), F.col("c"))
    r = df.select(v["referenced"].alias("r"), v["missing"].alias("m"), v["extra"].alias("x"), C.precision(F.col("a"), F.col("c")).alias("p"), C.recall(F.col("a"), F.col("c")).alias("q"), C.grounded_fraction(F.col("a"), F.col("c")).alias("g"), e["referenced"].alias("er")).collect()
    assert r[0].r == [1] and r[0].m == [2] and r[0].x == [] and r[0].p == 1.0 and r[0].q == 0.5 and r[0].g == 1.0
    assert r[1].r == [] and r[1].m == [1, 2] and r[1].x == [3, 99] and r[1].er == [3, 99] and r[1].p == 0.0
    assert r[2].p == 1.0 and r[2].q == 1.0 and r[2].g == 0.0
    assert r[3].p == 0.0 and r[3].q == 0.0
    assert one(spark, C.number_contexts(F.col("c")), c=("array<string>", ["[1] a", "b"])) == ["[1] [1] a", "[2] b"]
    assert one(spark, C.number_contexts(F.col("c")), c=("array<string>", ["[1] a", " [2] b"])) == ["[1] a", " [2] b"]
    assert s(spark, C.rag_prompt(T, F.array().cast("array<string>")), "Q?").endswith("Context:\n(No contexts provided)\n\nQuestion: Q?\nAnswer:")
    assert s(spark, C.context_header(T, F.lit(3)), "Intro") == "Section: Intro | Page 3" and s(spark, C.source_ref(T, F.lit(0)), "p") == "p"


def test_quality(spark):
    good = "This is a paragraph of good prose. It goes on for a while.\n\n" * 30
    q = lambda t: s(spark, quality.quality_columns(T)["confidence"], t)
    assert q(good) > q("§§ @@ 12 ##") and q("") < 0.2
    for msg, want in (("Connection timeout", "timeout"), ("socket refused", "network"), ("bad JSON", "parsing"), ("rate limit", "model"), ("field missing", "validation"), ("odd", "unknown")):
        assert s(spark, quality.error_class(T), msg) == want
    assert s(spark, quality.section_title(T), "some text here.\n2.1 Methods\nmore") == "2.1 Methods"
    assert s(spark, quality.section_title(T), "related work\nx") == "Related Work"
    assert s(spark, quality.section_title(T), "plain text only.") is None
    assert s(spark, quality.model_class(F.lit(None).cast("string"), T), "lora_science_0p5") == "rag_trained"


def test_json_and_verdicts(spark):
    v = lambda t: s(spark, dataset.verdict_of(T), t)
    assert v('```json\n{"verdict": "win_a"}\n```') == "win_a" and v('{"verdict": "B"') == "win_b"
    assert v('Thoughts. {"verdict": "tie"} done') == "tie" and v("<think>win_a</think> I think it is a tie") == "tie" and v(None) is None
    p = spark.createDataFrame([(1, '{"qa": [{"question": "q", "answer": "a"}, {"question": " ", "answer": "b"}], "summaries": [{"instruction": "i", "response": "r"}]}')], "id int, p string")
    assert sorted(tuple(r) for r in dataset.payload_rows(p, "p", ["id"], {}).collect()) == [(1, "qa", 0, "q", "a"), (1, "summaries", 0, "i", "r")]


def test_published_statistics(spark):
    assert round(compare.sign_test_p(62, 51), 4) == 0.3468 and round(compare.sign_test_p(44, 42), 4) == 0.9141 and round(compare.sign_test_p(45, 48), 4) == 0.8357
    assert compare.sign_test_p(50, 50) == 1.0
    df = spark.createDataFrame([(62, 51), (44, 42), (45, 48)], "a bigint, b bigint")
    lo, hi = compare.wilson(F.col("a"), F.col("a") + F.col("b"))
    got = [(round(r.lo, 4), round(r.hi, 4), round(r.p, 4)) for r in df.select(lo.alias("lo"), hi.alias("hi"), compare.sign_test_exact(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [(0.4568, 0.6373, 0.3469), (0.4078, 0.6145, 0.9142), (0.385, 0.584, 0.8358)]


def test_elo_fold(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "d"]
    data = [(i, *rng.sample(names, 2), rng.choice(["win_a", "win_b", "tie"]), i % 2) for i in range(120)]
    g = spark.createDataFrame(data, "match_id int, model_a string, model_b string, outcome string, t int").withColumn("ord", F.col("match_id"))
    want = {}
    for _, a, b, o, _ in data:
        ra, rb = want.get(a, 1500.0), want.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        x = {"win_a": 1.0, "win_b": 0.0, "tie": 0.5}[o]
        want[a], want[b] = ra + 32 * (x - e), rb - 32 * (x - e)
    got = {r.model: r.rating for r in pairwise.elo(g).collect()}
    assert all(math.isclose(got[m], want[m], abs_tol=1e-5) for m in want)
    assert {r.tournament for r in pairwise.elo(g, "t").collect()} == {"0", "1"}
    b = {r.model: (r.lower, r.upper) for r in pairwise.bootstrap(g.groupBy("model_a", "model_b", "outcome").agg(F.count("*").alias("n")), 40).collect()}
    assert set(b) == set(names) and all(lo < hi for lo, hi in b.values())


def test_top_k_equals_brute_force(spark):
    rng = random.Random(1)
    v = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(v, "i int, x array<float>")
    got = retrieval.top_k(df.where("i < 5").withColumnRenamed("i", "q"), df, "q", "i", "x", 3).collect()
    real = {r.i: r.x for r in df.collect() if r.x}

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)) or 1, math.sqrt(sum(x * x for x in b)) or 1
        return sum(x * y for x, y in zip(a, b)) / na / nb

    for q in range(5):
        want = sorted((-round(cos(real[q], real[i]), 9), i) for i in real if i != q)[:3]
        assert [r.i for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == [i for _, i in want]


def test_scale_helpers(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    j = scale.salted_join(rows, lookup, "k", "n", F.col("id"))
    assert j.count() == 2000 and j.columns == ["k", "id", "m"]
    p = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") / 500).alias("p"), F.lit(2).alias("s"), "id")
    assert all(r.o == 2 * r.id for r in scale.prefix_sum(p, ["g"], "p", "s", "o", buckets=16, tie="id").collect())
    n = scale.hash_sample(spark.range(5000), 100, "id").count()
    assert 50 < n <= 200 and scale.hash_sample(spark.range(10), 100, "id").count() == 10


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(f"{p}{i}", p) for p, n in (("a", 10), ("b", 20), ("c", 5), ("d", 2), ("e", 1)) for i in range(n)], "k string, p string")
    n = {r.p: r["count"] for r in dataset.paper_split(df, F.col("p"), "k").where("split = 'eval'").groupBy("p").count().collect()}
    assert n == {"a": 2, "b": 4, "c": 1}
    assert dataset.sample(df, "k", 7).count() == 7 and dataset.sample(df, "k", 99).count() == 38
    st = dataset.stratified_sample(df, "p", "k", 10)
    assert st.count() == 10 and st.select("p").distinct().count() == 5


def test_merge_and_predictions(spark):
    a = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "k string, v double")
    b = spark.createDataFrame([("1", 3.0), ("3", 4.0)], "k string, v double")
    assert sorted((r.k, r.sides) for r in scoring.merge_metrics(a, b, "k", "v").collect()) == [("1", "both"), ("2", "left"), ("3", "right")]
    q = one(spark, scoring.exclusive_quantile(F.col("a"), 0.9), a=("array<double>", [1.0, 2.0, 3.0, 4.0, 5.0]))
    assert q == 5.0
    w = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y"), ("p", "c", "y"), ("q", "a", "x"), ("q", "b", "y")], "i string, j string, v string")
    got = {r.i: (r.verdict, r.agreement) for r in scoring.weighted_consensus(w, "i", F.col("v"), F.lit(1), ["j"]).collect()}
    assert got == {"p": ("y", 0.666667), "q": ("x", 0.5)}


def test_atom(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2501.00001v2</id><title> A
  title </title><summary>s</summary><author><name>X Y</name></author><author><name> </name></author><category term="cs.CL"/><arxiv:primary_category term="cs.CL"/><published>2025-01-02T03:04:05Z</published><updated>2025-01-03T00:00:00Z</updated><link title="pdf" href="http://arxiv.org/pdf/2501.00001v2"/></entry><entry><id>x</id></entry></feed>"""
    r = catalog.parse_atom(spark.createDataFrame([(xml,)], "p string"), "p").collect()
    assert len(r) == 1 and r[0].arxiv_id == "2501.00001" and r[0].version == "2" and r[0].title == "A title" and r[0].authors == ["X Y"] and r[0].pdf_url.startswith("https:")
    assert catalog.category_query(["cs.CL", "cs.AI"], "20250101") == "(cat:cs.CL+OR+cat:cs.AI)+AND+submittedDate:[20250101+TO+*]"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id": "1", "instruction": "q"}\n\nnot json\n{"task_id": "2"}\n')
    assert sorted(r.task_id for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), readers.QA_SCHEMA).collect()) == ["1", "2"]
    assert [(r.line, r.kind) for r in readers.jsonl_issues(spark, str(tmp_path / "a.jsonl")).collect()] == [(3, "invalid_json")]
    (tmp_path / "m.tsv").write_text("id\tsource_path\tpage\tchunk_index\ttoken_start\ttoken_end\ttext\n7\ta.txt\tnone\t\t\tx\thello\n8\t \t1\t1\t0\t5\tno\n")
    r = readers.read_chunk_map(spark, str(tmp_path / "m.tsv")).collect()
    assert len(r) == 1 and r[0].chunk_index == 7 and r[0].page is None and r[0].token_end is None and r[0].text == "hello"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "y.txt").write_text("two\nlines")
    assert [x.text for x in readers.read_text_tree(spark, str(tmp_path / "x")).collect()] == ["two\nlines"]
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>")
    writers.write_catalog(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "catalog.csv")).first()["l"] == "a; b"
    old = spark.createDataFrame([(1, "x"), (2, "y")], "b int, v string")
    assert sorted(tuple(r) for r in writers.upsert_batches(old, spark.createDataFrame([(2, "z"), (3, "w")], "b int, v string"), "b").collect()) == [(1, "x"), (2, "z"), (3, "w")]
    items = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "k int, t string")
    assert sorted((r.batch, r.n) for r in writers.prompt_batches(items, "k", "t", 5).collect()) == [(1, 5), (2, 5), (3, 2)]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "k int, m int").select("k", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    where = str(tmp_path / "log")
    assert inc.run_available(stream, where).count() == 3
    assert inc.run_available(spark.readStream.schema(df.schema).parquet(src), where).count() == 3
    df.write.mode("append").parquet(src)
    assert inc.run_available(spark.readStream.schema(df.schema).parquet(src), where).count() == 6
    assert inc.resume(df, df.where("k = 1"), ["k"]).count() == 1


def test_live_elo_equals_batch(spark, tmp_path):
    data = [(i, "a" if i % 2 else "b", "c", ["win_a", "win_b", "tie"][i % 3]) for i in range(30)]
    g = spark.createDataFrame(data, "match_id int, model_a string, model_b string, outcome string").withColumn("ord", F.col("match_id"))
    fold = inc.live_elo(g)
    fold(g.where("match_id < 11"), 0)
    fold(g.where("match_id >= 11"), 1)
    assert {r.model: round(r.rating, 3) for r in fold.ratings().collect()} == {r.model: round(r.rating, 3) for r in pairwise.elo(g).collect()}


def test_plugins(spark):
    plugins.register_generator("upper", lambda: lambda texts: [t.upper() for t in texts])
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, p string")
    assert [r.answer for r in plugins.generate(df, "p", "upper").orderBy("i").collect()] == ["AB", ""]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("x")
        return ["ok"]

    assert plugins.with_retries(flaky, 3, 0.0) == ["ok"]


def test_t_distribution():
    assert abs(reports.t_two_sided(2.228139, 10) - 0.05) < 1e-6 and abs(reports.t_two_sided(0.0, 5) - 1) < 1e-12
    assert abs(reports.t_quantile(0.975, 10) - 2.228139) < 1e-5
    lo, hi = reports.mean_interval(11, 5.0, 2.0)
    assert abs((hi - lo) / 2 - 2.228139 * 2 / math.sqrt(11)) < 1e-5 and reports.mean_interval(1, 5.0, 0.0) == (5.0, 5.0)


def test_report_pieces(spark):
    assert reports.balance_buckets([("x", 5), ("y", 4), ("z", 3)], {"train": 8, "eval": 4}) == {"x": "train", "y": "eval", "z": "train"}
    m = spark.createDataFrame([(1, "A", "m1", "m1"), (1, "B", "m1", "m1"), (2, "a", "m2", "m1"), (2, "tie", "m2", "m1")], "b int, v string, first string, model_a string")
    got = [r.outcome for r in reports.unblind(m.select("b", "v"), m.select("b", "first", "model_a").distinct(), ["b"], "v", "first", "model_a").orderBy("b", "v").collect()]
    assert got == ["win_a", "win_b", "win_b", "tie"]
    u = [[1.0, 0.0], [0.0, 1.0]]
    f = reports.greedy_match_f1(F.col("a"), F.col("b"))
    assert one(spark, f["f1"], a=("array<array<double>>", u), b=("array<array<double>>", u)) == 1.0
    assert one(spark, reports.windows_of(F.col("t"), 2, 3), t=("string", "abcdefgh")) == ["abc", "fgh"]
    assert one(spark, reports.range_phrase(F.col("a"), F.lit(4), "questions"), a=("int", 3)) == "3 to 4 questions"
    e = spark.createDataFrame([("m", {"generation": "x", "judge": "y"}), ("m", {"judge": "y"}), ("m", {})], "l string, e map<string,string>")
    assert sorted((r.kind, r.n) for r in reports.error_breakdown(e, "l", "e").collect()) == [("both", 1), ("judge", 1)]

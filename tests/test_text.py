import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import parsing
from corvane.functions import text as tx
from corvane.operators import clients, config, markdown, preferences, prompts, retrieval


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("text", ["", " ", "a" * 10, "x" * 25, " " * 9 + "b" * 12, "😀" * 17, "می‌رود " * 4])
def test_windows(spark, text):
    want, out = [], 0
    for s in range(0, len(text), 7):
        if w := text[s : s + 10].strip():
            want.append((out, w))
            out += 1
    got = retrieval.chunk_windows(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", 10, 3).orderBy("idx").collect()
    assert [(r.idx, r.chunk) for r in got] == want
    with pytest.raises(ValueError):
        retrieval.chunk_windows(None, "k", "t", 10, 10)


def test_blanks_and_persian(spark):
    for c in " \t  　\u0085":
        assert one(spark, f"{c}a{c}{c}b{c}", tx.squeeze) == "a b"
    assert one(spark, "‌a‌", tx.strip) == "‌a‌"
    assert one(spark, "كتاب  ٣۴", tx.persian) == "کتاب 34"
    assert one(spark, "a b c a b c", tx.has_repeated_trigram) and not one(spark, "a b", tx.has_repeated_trigram)


@pytest.mark.parametrize(("reply", "strict", "lenient"), [(" 0.5 ", 0.5, 0.5), ("1.00", 1.0, 1.0), ("1.5", None, 1.0), ("score 0.7", None, 0.7), ("none", None, 0.0), ("", None, 0.0), (".5", None, 0.5), ("0", 0.0, 0.0)])
def test_scores(spark, reply, strict, lenient):
    assert one(spark, reply, parsing.strict_unit_score) == strict and one(spark, reply, parsing.lenient_unit_score) == lenient


def test_judge_replies(spark):
    good = {"context_utility": 3, "answer_correctness": 1, "faithfulness": 4, "persona_alignment": 2, "pedagogical_quality": 0}
    bad = ["```json\n" + json.dumps(good) + "\n```", json.dumps({k: good[k] for k in list(good)[:4]}), json.dumps(good | {"x": 1}), json.dumps(good | {"faithfulness": True}), json.dumps(good | {"faithfulness": 3.5}), json.dumps(good | {"faithfulness": 5}), json.dumps(good | {"answer_correctness": 2}), ""]
    assert one(spark, json.dumps(good), parsing.judge_scores).asDict() == good
    assert all(one(spark, b, parsing.judge_scores) is None for b in bad)


def test_verdict_rubric_and_refs(spark):
    assert one(spark, '```json\n{"winner": "A", "reason": "x"}\n```', parsing.verdict) == "A"
    for bad in ('{"winner": "C", "reason": "x"}', '{"winner": "A", "reason": " "}', '{"winner": "A"}', '{"winner": "A", "reason": "x", "z": 1}', "A"):
        assert one(spark, bad, parsing.verdict) is None
    rub = lambda c: parsing.rubric_scores(c, ["a", "b"])
    assert one(spark, '{"a": 0.5, "b": 1, "other": 9}', rub) == {"a": 0.5, "b": 1.0}
    assert one(spark, '{"a": true, "b": 1}', rub) is None and one(spark, '{"a": 2, "b": 1}', rub) is None and one(spark, "x", rub) is None
    assert one(spark, '{"scores": [0.1, 0.2]}', lambda c: parsing.batched_scores(c, 3)) == [0.1, 0.2, 0.0]
    assert one(spark, "0.3 then 0.4 and 0.5", lambda c: parsing.batched_scores(c, 2)) == [0.3, 0.4]
    assert one(spark, "I say 8 of 10", parsing.ten_point_score) == 8.0
    for ref, want in (("e:a:b", ("e", "a:b")), (":x", (None, None)), ("x:", (None, None)), ("x", (None, None))):
        assert (one(spark, ref, lambda c: parsing.reference(c)[0]), one(spark, ref, lambda c: parsing.reference(c)[1])) == want
    assert [one(spark, s, parsing.retryable, "int") for s in (None, 408, 429, 500, 503, 400, 404)] == [True, True, True, True, True, False, False]
    assert one(spark, "درس ۱۲ — بهار", parsing.lesson_id) == "lesson-12" and one(spark, "درس پنجم: باران", parsing.lesson_id) == "lesson-05" and one(spark, "مقدمه", parsing.lesson_id) is None


def test_markdown(spark):
    md = "before\n# درس اول\nx\n\n\n\ny\n## بخش\n\n### درس ۳ — z\nw"
    df = spark.createDataFrame([("s", md)], "source string, t string")
    b = markdown.heading_blocks(df, "source", "t")
    assert [(r.level, r.heading, r.body) for r in b.orderBy("block").collect()] == [(1, "درس اول", "x\n\ny"), (2, "بخش", ""), (3, "درس ۳ — z", "w")]
    c = markdown.carry_lessons(b.withColumn("section", F.lit("poem")), "source", "block", "heading", "section")
    assert [r.chunk_id for r in c.orderBy("block").collect()] == ["s:lesson-01:poem:001", "s:lesson-01:poem:002", "s:lesson-03:poem:001"]
    v = markdown.verse_entries(spark.createDataFrame([(1, "lead\n**a**\n\n**b**\nexplained\n**c**\n")], "k int, t string"), "k", "t").orderBy("entry").collect()
    assert [(r.verse, r.explanation) for r in v] == [("**a**\n**b**", "explained"), ("**c**", "")]
    assert one(spark, "<b>x</b>", markdown.strip_tags) == "x"


def test_prompts(spark):
    df = spark.createDataFrame([("q", [(2, "s2", "t2"), (1, "s1", "t1")], ["x", "y"], None)], "q string, h array<struct<rank: int, source: string, text: string>>, o array<string>, g string")
    p = df.select(prompts.rag_prompt(F.col("q"), F.col("h")).alias("a"), prompts.mcq_prompt(F.col("q"), F.col("h"), F.col("q"), F.col("o")).alias("b"), prompts.judge_prompt(F.col("q"), F.lit("an"), F.col("g"), F.col("g")).alias("c"), prompts.answer_prompt(F.col("q"), F.array().cast("array<struct<rank: int, source: string, text: string>>"), F.lit("")).alias("d")).first()
    assert "[1] (source: s1) t1\n[2] (source: s2) t2" in p.a and "1. x\n2. y" in p.b and "Reference" not in p.c and prompts.NO_HITS["en"] in p.d
    with pytest.raises(ValueError):
        prompts.rag_prompt(F.col("q"), F.col("h"), "xx")
    crit = [prompts.Criterion("a", 0.5, "d"), prompts.Criterion("b", 0.5, "e")]
    prompts.check_rubric(crit)
    assert prompts.rubric_schema(crit)["required"] == ["a", "b"] and "weight 0.5" in prompts.rubric_block(crit)
    with pytest.raises(ValueError):
        prompts.check_rubric([prompts.Criterion("a", 0.4, "d")])


def test_clients(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, "other"), (4, None)], "k int, t string")
    v = clients.encode(df, "t", "v", clients.HashEncoder).orderBy("k").collect()
    assert list(v[0].v) == list(v[1].v) != list(v[2].v) and v[3].v is None and abs(sum(x * x for x in v[0].v) - 1) < 1e-5
    got = {r.k: r for r in clients.complete(df.filter("t is not null"), ["k"], "t", lambda: clients.ReplayClient({"hello": "hi"}), attempts=2, wait=0.0).collect()}
    assert got[1].reply == "hi" and got[1].attempts == 1 and got[3].reply is None and got[3].attempts == 2 and "KeyError" in got[3].error
    enc = clients.encode(df.filter("t is not null"), "t", "v", clients.HashEncoder)
    assert clients.encoder_parity(enc, enc, "k", "v").first().least_cosine > 0.999


def test_config():
    assert config.named_value("x=1") == ("x", "1") and config.endpoint("https://h:8/") == "https://h:8"
    for bad in ("x", "tie=1", "a b=1", "=1"):
        with pytest.raises(ValueError):
            config.named_value(bad)
    for bad in ("ftp://h", "http://h/p", "http://a,b", "http://u@h"):
        with pytest.raises(ValueError):
            config.endpoint(bad)
    with pytest.raises(config.ConfigErrors):
        config.RetryPolicy(attempts=True)
    assert config.check_arms([{"name": "x", "personas": ["p", "z"]}, {"name": "x", "rewriter": None}], {"p"}, {"x": {"rewriter": "r"}})[0].startswith("arm x is there 2")
    assert config.manifest_drift({"a": {"b": 1}, "c": [1, 2]}, {"a": {"b": 2}, "c": [1, 3]}) == ["a.b", "c[1]"]
    assert config.accumulation_steps(16, 2, 4) == 2 and config.cost(10, 1e6, 0, 2.0, 0) == 20.0


def test_preferences(spark):
    rows = [("g1", f"d{i}", s) for i, s in enumerate([0.9, 0.8, 0.5, 0.3])] + [("g2", "d1", 0.9)] + [("g3", "d1", 0.9), ("g3", "d2", 0.89)] + [("g4", "d1", 0.3), ("g4", "d2", 0.1)] + [("g5", "d1", 0.9), ("g5", "d2", 0.86)]
    g = preferences.triplet_groups(spark.createDataFrame(rows, "g string, d string, s double"), ["g"], "d", "s", 2, 0.03, 0.5, 0.05)
    got = {r.g: r for r in g.collect()}
    assert got["g1"].positive == "d0" and got["g1"].negatives == ["d2", "d3"] and got["g1"].dropped is None
    assert {k: v.dropped for k, v in got.items()} == {"g1": None, "g2": "too_few_docs", "g3": "positive_margin", "g4": "positive_score", "g5": "no_negatives"}
    n = preferences.drop_counts(g).first()
    assert n.groups_total == 5 == n.groups_retained + n.too_few_docs + n.positive_margin + n.positive_score + n.no_negatives and n.pairs == 2
    cands = spark.createDataFrame([(1, "q", "a!", 0.9, 0), (2, "q", "a", 0.8, 3), (3, "q", " a.", 0.7, 3), (4, "q", "b", 0.1, 3)], "i int, q string, t string, s double, n int")
    f = {r.i: r.filter_reason for r in preferences.candidate_filter(cands, ["q"], "t", "s", "n", 1, "i").collect()}
    assert f == {1: "under_sampled", 2: None, 3: "duplicate", 4: None}
    assert one(spark, "「ａ」", preferences.rewrite_key) == "「a」" and one(spark, None, preferences.rewrite_key) is None


def test_ranking_quality_properties(spark):
    rows = [(1, d, g, r) for d, g, r in [(10, 0.9, 3), (11, 0.5, 1), (12, 0.0, 9)]] + [(2, 10, 0.0, 1), (2, 11, 0.0, 2)]
    q = {r.query_id: r for r in retrieval.ranking_quality(spark.createDataFrame(rows, "query_id int, doc_id int, gain double, rank int"), 5, 1).collect()}
    assert q[2].ndcg5 == 0.0 and q[1].mrr == pytest.approx(1 / 3) and q[1].hit1 == 0 and q[1].hit5 == 1
    assert all(0 <= q[1][f"ndcg{i}"] <= 1 for i in range(1, 6)) and all(q[1][f"hit{i}"] <= q[1][f"hit{i + 1}"] for i in range(1, 5))
    assert one(spark, [0.5, 0.5], lambda c: retrieval.mnrl_loss(c, 1.0), "array<double>") == pytest.approx(0.6931, abs=1e-4)
    assert one(spark, [0.3, 0.9], lambda c: retrieval.kd_loss(c, c, 0.5, 0.5), "array<double>") == pytest.approx(0.0, abs=1e-12)

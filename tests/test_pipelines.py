import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane.operators import clients, markdown, pipelines, prompts, questions
from corvane.sources import readers, sinks


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module


class Fake:
    """Answers by rules on the prompt; ``bad`` prompts fail with a status."""

    def __init__(self, rule, bad=None, status=500):
        self.rule, self.bad, self.status = rule, bad, status

    def complete(self, prompt):
        if self.bad and self.bad in prompt:
            raise clients.CallFailed("no", self.status)
        return self.rule(prompt)


FAST = {"attempts": 2, "wait": 0.0}


def test_calls_are_pooled_in_order_and_fatal_ones_end(spark):
    df = spark.createDataFrame([(i, f"p{i}" if i != 5 else None) for i in range(40)], "k int, p string")
    got = {r.k: r for r in clients.complete(df, ["k"], "p", lambda: Fake(lambda p: p.upper(), "p7"), workers=4, **FAST).collect()}
    assert {k: r.reply for k, r in got.items()} == {i: None if i in (5, 7) else f"P{i}" for i in range(40)}
    assert got[7].attempts == 2 and got[5].error == "no prompt"
    fatal = clients.complete(df, ["k"], "p", lambda: Fake(str, "p7", 404), abort=True, **FAST)
    with pytest.raises(Exception, match="refuses calls"):
        fatal.collect()
    once = {r.k: r.attempts for r in clients.complete(df, ["k"], "p", lambda: Fake(str, "p7", 302), **FAST).collect()}
    assert once[7] == 1  # neither a success nor a server's fault
    refused = clients.complete(df.filter("k = 1"), ["k"], "p", lambda: Fake(lambda p: " "), accept=lambda r: bool(r.strip()), **FAST).first()
    assert refused.reply is None and refused.attempts == 2


def test_child_process():
    program = "import json,sys\nfor line in sys.stdin:\n p = json.loads(line)['prompt']\n print(json.dumps({'reply': p[::-1]} if p != 'x' else {'error': 'bad'}), flush=True)"
    c = clients.ChildProcessClient([sys.executable, "-c", program])
    assert c.complete("abc") == "cba" and c.complete("متن") == "نتم"
    with pytest.raises(clients.CallFailed, match="bad"):
        c.complete("x")
    c.close()
    with pytest.raises((clients.CallFailed, ValueError)):
        c.complete("abc")


def test_candidates_and_their_scores(spark):
    q = spark.createDataFrame([("q1", "first"), ("q2", "fail me")], "question_ref string, query string")
    p = spark.createDataFrame([("a", "short"), ("b", "long")], "persona_id string, profile string")

    def judge(prompt):
        if "bad sample" in prompt:
            return "none"
        return json.dumps({"fit": 1.0 if "short" in prompt else 0.5, "faithful": 0.5, "more": 1})

    prompt = lambda profile, query, rewrite: F.concat_ws("\n", profile, query, rewrite)
    got = pipelines.generate_candidates(q, p, [0.0, 0.7], lambda t: lambda: Fake(lambda x: f"rewritten at {t}", "fail me"), lambda: Fake(judge), prompt, {"fit": 0.5, "faithful": 0.5}, 3, **FAST).collect()
    assert {(r.question_ref, r.persona_id, r.temperature, r.rewrite, r.judge_samples, r.score) for r in got} == {("q1", s, t, f"rewritten at {t}", 3, 0.75 if s == "a" else 0.5) for s in "ab" for t in (0.0, 0.7)}


def test_passages_pairs_and_answers(spark):
    hits = spark.createDataFrame([("q", "p", i, "ask", "prof", t) for i, t in enumerate(["good", "odd", "broken"])], "question_ref string, persona_id string, doc_idx int, query string, profile string, text string")
    say = lambda x: "0.8" if "good" in x else "eight"
    assert {r.text: r.score for r in pipelines.judge_passages(hits, lambda: Fake(say, "broken"), **FAST).collect()} == {"good": 0.8, "odd": None, "broken": None}
    assert {r.text: r.score for r in pipelines.judge_passages(hits, lambda: Fake(lambda x: "I say 7 of 10"), True, **FAST).collect()} == dict.fromkeys(["good", "odd", "broken"], 7.0)
    groups = spark.createDataFrame([("q1", "p", "prof", [("c1", "t1"), ("c2", "t2")]), ("q2", "p", "prof", [("c3", "broken")]), ("q3", "p", "prof", [])], "query string, persona_id string, profile string, docs array<struct<chunk_id: string, text: string>>")
    for zero in (False, True):
        got = {r["query"]: [d.teacher_score for d in r.docs] for r in pipelines.judge_in_one_call(groups, lambda: Fake(lambda x: '{"scores": [0.5]}', "broken"), 4, zero, **FAST).collect()}
        assert got == {"q1": [0.5, 0.0], "q2": [0.0 if zero else None], "q3": []}
    jobs = spark.createDataFrame([("j1", "q", "p", "ask", "x", "y"), ("j2", "q", "p", "ask", "y", "x")], "job_key string, question_ref string, persona_id string, query string, candidate_a string, candidate_b string")
    outputs = spark.createDataFrame([("x", "q", "p", "best"), ("y", "q", "p", "other")], "candidate string, question_ref string, persona_id string, rewrite string")
    win = lambda t: json.dumps({"winner": "A" if t.index("best") < t.index("other") else "B", "reason": "r"}) if "A:\nother" not in t else "?"
    assert {r.job_key: (r.winner, r.status) for r in pipelines.judge_pairs(jobs, outputs, lambda: Fake(win), **FAST).collect()} == {"j1": ("A", "ok"), "j2": (None, "missing")}
    with pytest.raises(Exception, match="refuses calls"):
        pipelines.judge_pairs(jobs, outputs, lambda: Fake(str, "ask", 401), **FAST)
    rows = spark.createDataFrame([(1, "fine"), (2, None), (3, "broken"), (4, "half")], "k int, prompt string")
    five = json.dumps({"context_utility": 4, "answer_correctness": 1, "faithfulness": 3, "persona_alignment": 2, "pedagogical_quality": 0})
    out = {r.k: r for r in pipelines.score_answers(rows, ["k"], lambda: Fake(lambda x: five, "broken"), lambda: Fake(lambda x: five, "half"), "prompt", **FAST).collect()}
    assert {k: (r.status, r.failure_stage, r.secondary is not None) for k, r in out.items()} == {1: ("ok", None, True), 2: ("failed", "generation", False), 3: ("failed", "judge_primary", True), 4: ("ok", None, False)}
    assert out[1].primary.faithfulness == 3
    assert {r.status for r in pipelines.score_answers(rows, ["k"], lambda: Fake(lambda x: five), None, "prompt", **FAST).filter("k = 4").collect()} == {"ok"}


def test_preference_rows_end_to_end(spark):
    q = spark.createDataFrame([("q1", "rain")], "question_ref string, query string")
    p = spark.createDataFrame([("a", "likes rain"), ("b", "likes sun")], "persona_id string, profile string")
    corpus = spark.createDataFrame([("c1", "s", "rain falls"), ("c2", "s", "sun shines")], "chunk_id string, source string, text string")

    class Counting(Fake):
        def __init__(self):
            super().__init__(str)
            self.n = 0

        def complete(self, prompt):
            self.n += 1
            return f"rain version {self.n}"

    answer = lambda x: "answer about rain" if "rain falls" in x else "nothing"
    got = pipelines.preference_rows(q.coalesce(1), p.filter("persona_id = 'a'").coalesce(1), corpus, Counting, lambda: Fake(answer), lambda: Fake(lambda x: "9"), 3, **FAST).collect()
    assert got == []  # all alike
    grades = iter(range(100))
    assert next(grades) == 0

    class Grading(Counting):
        def complete(self, prompt):
            self.n += 1
            return str(self.n)

    rows = pipelines.preference_rows(q.coalesce(1), p.filter("persona_id = 'a'").coalesce(1), corpus, Counting, lambda: Fake(answer), Grading, 3, **FAST).collect()
    assert len(rows) == 1 and rows[0].margin >= 1 and rows[0].chosen != rows[0].rejected


EXAM = {
    "passages": [{"id": "g1", "text": "شعر"}, {"group_id": "g2", "passage": {"b": 1, "a": 2}}, {"id": "g3"}],
    "questions": [
        {"id": "1", "stem": "چه؟", "group_id": "g1", "options": ["a", {"z": 1, "k": "v"}, 3], "answer": 2},
        {"id": "2", "stem": "Match", "group_id": "g2", "pairs": {"left": ["l"], "right": []}, "items": "one", "explanation": "because"},
        {"id": "3", "stem": "x", "group_id": "g3"},
        {"id": "4", "group_id": None},
        {"id": "5", "stem": ["s"], "pairs": [["a", "b"]], "options": [], "answer": "yes"},
        {"id": "5", "stem": "again"},
    ],
}


def test_question_contexts(spark, tmp_path):
    (tmp_path / "e1.json").write_text(json.dumps(EXAM, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "e2.json").write_text('{"passages": {"g9": "told"}, "questions": [{"id": 7, "stem": "q", "group_id": "g9"}]}', encoding="utf-8")
    (tmp_path / "e3.json").write_text("[1", encoding="utf-8")
    found = questions.contexts(readers.exam_files(spark, str(tmp_path)), "exam", "payload")
    got = {(r.exam, r.question_id): r for r in found.collect()}
    assert got["e1", "1"].query == 'Passage:\nشعر\n\nQuestion:\nچه؟\n\nOptions:\n1. a\n2. {"k": "v", "z": 1}\n3. 3' and got["e1", "1"].answer == "2"
    assert got["e1", "2"].query == 'Passage:\n{"a": 2, "b": 1}\n\nQuestion:\nMatch\n\nPairs (left):\n1. l\n\nItems:\n1. one' and got["e1", "2"].explanation == "because"
    assert got["e1", "3"].query is None and "g3" in got["e1", "3"].error and "stem" in got["e1", "4"].error
    assert got["e1", "5"].query == 'Question:\n["s"]\n\nPairs:\n1. ["a", "b"]' and got["e2", "7"].query == "Passage:\ntold\n\nQuestion:\nq" and got["e3", None].error.startswith("payload")
    refs = spark.createDataFrame([("e1", "1"), ("e1", "3"), ("e9", "1")], "exam string, qid string")
    known, lost = questions.resolve_refs(refs, found)
    assert [(r.exam, r.qid) for r in known.collect()] == [("e1", "1")] and {tuple(r) for r in lost.collect()} == {("e1", "3"), ("e9", "1")}
    profiles = spark.createDataFrame([("a", "prose")], "id string, rendered string")
    rows = spark.createDataFrame([("a",), ("z",)], "persona_id string")
    assert questions.with_profiles(rows.filter("persona_id = 'a'"), profiles, "persona_id").first().profile == "prose"
    with pytest.raises(Exception, match="unknown persona: z"):
        questions.with_profiles(rows, profiles, "persona_id").collect()


BOOK = "# کتاب\n### درس یکم: آغاز\n<b>شعر</b>\n#### دانش ادبی\nنکته\n#### دیگر\nx\n### درس ۲\n\n### فرعی\ny\n### درس ۳\nz\n#### دانش ادبی\nw\n### درس هجدهم\nv"
GUIDE = "### معنی لغت\nپیش\n## درس دوم\n### معنی لغت واژه\nآب: ماء\n### معنی ابیات\n**بیت یک**\n**بیت دو**\nشرح\n**بیت سه**\n### دیگر\nx"


def test_three_chunkers(spark):
    doc = lambda t: spark.createDataFrame([("d", t), ("e", None), ("f", "")], "k string, t string")
    book = [(r.chunk_id, r.text) for r in markdown.textbook_chunks(doc(BOOK), "k", "t").collect()]
    assert sorted(book) == sorted([("textbook:lesson-01:poem:001", "شعر"), ("textbook:lesson-01:literary-notes:001", "نکته"), ("textbook:lesson-03:poem:001", "z"), ("textbook:lesson-03:literary-notes:001", "w")])
    guide = [(r.chunk_id, r.text) for r in markdown.study_guide_chunks(doc(GUIDE), "k", "t").collect()]
    assert sorted(guide) == sorted([("study-guide:preamble:vocabulary:001", "پیش"), ("study-guide:lesson-02:vocabulary:001", "آب: ماء"), ("study-guide:lesson-02:verse-explanation:001", "**بیت یک**\n**بیت دو**\nشرح"), ("study-guide:lesson-02:verse-explanation:002", "**بیت سه**")])
    gifted = [(r.chunk_id, r.text) for r in markdown.gifted_chunks(doc(BOOK), "k", "t").collect()]
    assert sorted(gifted) == sorted([("gifted:lesson-01:deep-analysis:001", "شعر"), ("gifted:lesson-02:deep-analysis:001", "y"), ("gifted:lesson-03:deep-analysis:001", "z"), ("gifted:lesson-03:deep-analysis:002", "v")])


def test_prompt_forms(spark):
    df = spark.createDataFrame([("ask", "prof", ["t1", "t2"], None)], "q string, p string, d array<string>, g string")
    x = df.select(
        prompts.batched_judge_prompt(F.col("q"), F.col("p"), F.col("d")).alias("batched"), prompts.passage_prompt(F.col("q"), F.col("p"), F.lit("t"), F.col("g"), F.lit("why")).alias("passage"),
        prompts.persona_prefix(F.col("p"), F.col("q")).alias("prefix"), prompts.persona_prefix(F.col("g"), F.col("q")).alias("bare"), prompts.chat_text(prompts.messages(F.lit("s"), F.col("q"))).alias("chat"),
        *prompts.training_triple(F.col("p"), F.col("q"), F.lit("c"), F.lit("r"), "s", "<{role}>"), prompts.batched_judge_prompt(F.col("q"), F.col("p"), F.array().cast("array<string>")).alias("none"),
    ).first()
    assert "[1] t1\n[2] t2" in x.batched and "exactly 2 numbers" in x.batched and x.none is None
    assert "Gold explanation:\nwhy" in x.passage and "Gold answer" not in x.passage and x.prefix == "prof\n\nask" and x.bare == "ask"
    assert x.chat == "<|system|>\ns\n<|user|>\nask\n<|assistant|>\n" and x.prompt.startswith("<system>s\n<user>") and x.prompt.endswith("<assistant>") and (x.chosen, x.rejected) == ("c", "r")


def test_stored_index_reports_and_runs(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "گل‌برگ سرخ است"), ("d2", "گل و برگ"), ("d3", "Café au lait"), ("d4", "!")], "k string, t string")
    from corvane.operators import retrieval

    path = str(tmp_path / "index")
    for _ in range(2):  # the second write replaces the first
        sinks.write_lexical_index(docs, "k", "t", path, 4)
    index = readers.lexical_index(spark, path)
    assert readers.index_count(index) == 3
    ask = spark.createDataFrame([(1, "گل‌برگ"), (2, "cafe"), (3, "برگ"), (4, "?"), (5, "برگ‌گل")], "q int, t string")
    got = {}
    for r in retrieval.search(ask, "q", "t", index, "k", 5).collect():
        got.setdefault(r.q, set()).add(r.k)
    assert got == {1: {"d1"}, 2: {"d3"}, 3: {"d1", "d2"}}
    sinks.clear_index(spark, path)
    assert not (tmp_path / "index").exists()
    # a job that reads what it replaces, and one that fails
    rows = str(tmp_path / "rows")
    sinks.overwrite_json(spark.range(3), rows)
    sinks.overwrite_json(spark.read.schema("id long").json(rows).filter("id > 0"), rows)
    assert {r.id for r in spark.read.json(rows).collect()} == {1, 2}
    with pytest.raises(Exception, match="boom"):
        sinks.overwrite_json(spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x")), rows)
    assert {r.id for r in spark.read.json(rows).collect()} == {1, 2} and [p.name for p in tmp_path.iterdir()] == ["rows"]
    table = spark.createDataFrame([("a", None, 1)], "arm string, mean double, n int")
    with pytest.raises(ValueError, match="lacks"):
        sinks.report(table, "summary", str(tmp_path / "r"))
    full = table.selectExpr("arm", "'all' persona", "'p' judge", "'u' metric", "mean", "mean sd", "n n_valid", "0 failed")
    sinks.report(full, "summary", str(tmp_path / "r"), {"failed": "n_failed"})
    text = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert text == ["arm,persona,judge,metric,mean,sd,n_valid,n_failed", "a,all,p,u,,,1,0"]
    run = tmp_path / "run"
    (run / "outputs").mkdir(parents=True)
    (run / "manifests").mkdir()
    (run / "outputs" / "base.jsonl").write_text('{"question_ref": "q", "persona_id": "p", "rewrite": "r"}\n')
    (run / "manifests" / "base.json").write_text('{"model": "m"}')
    (run / "summary.json").write_text('{"jobs": 2}')
    judged = [{"job_key": str(i), "model_left": "l", "model_right": "r", "candidate_a": "r", "candidate_b": "l", "winner": w, "status": "ok" if w else "missing"} for i, w in enumerate(["A", "B", "TIE", None])]
    (run / "judgments.jsonl").write_text("\n".join(map(json.dumps, judged)))
    assert readers.tournament_outputs(spark, str(run)).first().candidate == "base" and readers.tournament_manifests(spark, str(run)).count() == 1
    assert [r.result for r in readers.tournament_judgments(spark, str(run)).orderBy("job_key").collect()] == ["loss", "win", "tie", None]
    assert readers.tournament_summary(spark, str(run)).selectExpr("variant_get(summary, '$.jobs', 'int') j").first().j == 2
    dumped = spark.createDataFrame([(1, True, None), (2, False, "duplicate"), (3, False, None)], "i int, kept boolean, filter_reason string")
    sinks.candidate_dumps(dumped, str(tmp_path / "all"), str(tmp_path / "kept"))
    assert {r.i: r.filter_reason for r in spark.read.json(str(tmp_path / "all")).collect()} == {1: None, 2: "duplicate", 3: "unknown"} and spark.read.json(str(tmp_path / "kept")).count() == 1
    (tmp_path / "c.json").write_text('{"seed": 3, "a": {"b": 1}}')
    assert readers.load_config(str(tmp_path / "c.json"), True)["a"] == {"b": 1}
    with pytest.raises(ValueError, match="no mapping"):
        readers.config_mapping("[1]")

"""Pipelines around model calls: candidates and their scores, judged passages, pairwise judgments, whole preference rows.

Each takes clients as factories, so that every task makes its own, and returns tables that say what failed. Results are
written to the shared folder as soon as they are there, as calls cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..session import materialize
from . import preferences, prompts, retrieval
from .clients import ChatClient, complete

Client = Callable[[], ChatClient]


def generate_candidates(
    questions: DataFrame, personas: DataFrame, temperatures: list[float], rewriter: Callable[[float], Client], judge: Client, judge_prompt: Callable[[Column, Column, Column], Column], weights: dict[str, float], samples: int, **calls
) -> DataFrame:
    """One rewrite per question, persona and temperature, each judged ``samples`` times: question_ref, persona_id,
    temperature, rewrite, the mean sub-scores of ``weights``, judge_samples and score.

    ``questions`` has question_ref and query, ``personas`` (a small table) persona_id and profile. ``judge_prompt`` makes a
    prompt of profile, query and rewrite; replies hold one number from 0 to 1 for each criterion. A rewrite that fails or is
    blank, and a candidate without a usable sample, gives no row."""
    jobs = questions.crossJoin(personas).withColumn("prompt", prompts.rewrite_prompt(F.col("profile"), F.col("query")))  # personas are few
    made = None
    for t in temperatures:
        one = complete(jobs, ["question_ref", "persona_id"], "prompt", rewriter(t), accept=lambda r: bool(r.strip()), **calls).withColumn("temperature", F.lit(float(t)))
        made = one if made is None else made.unionByName(one)
    made = materialize(made.filter("reply is not null").select("question_ref", "persona_id", "temperature", F.col("reply").alias("rewrite")))
    key = ["question_ref", "persona_id", "temperature"]
    asked = made.join(jobs.select("question_ref", "persona_id", "query", "profile"), ["question_ref", "persona_id"])
    asked = asked.withColumn("prompt", judge_prompt(F.col("profile"), F.col("query"), F.col("rewrite"))).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    judged = complete(asked, [*key, "sample"], "prompt", judge, **calls)
    scores = parsing.rubric_scores(F.col("reply"), list(weights))
    judged = materialize(judged.withColumn("x", scores).select(*key, "sample", *(F.col("x")[c].alias(c) for c in weights)))
    return made.join(preferences.average_samples(judged, key, weights), key)


def judge_passages(hits: DataFrame, judge: Client, ten_points: bool = False, **calls) -> DataFrame:
    """``hits`` (question_ref, persona_id, doc_idx, query, profile, text) with ``score``, null where the judge failed or said
    nothing usable; such rows are kept. Ten-point judges are asked and read in the older way."""
    prompt = (prompts.ten_point_prompt if ten_points else prompts.passage_prompt)(F.col("query"), F.col("profile"), F.col("text"))
    key = ["question_ref", "persona_id", "doc_idx"]
    said = complete(hits.withColumn("prompt", prompt), key, "prompt", judge, **calls)
    score = (parsing.ten_point_score if ten_points else parsing.strict_unit_score)(F.col("reply"))
    return hits.join(materialize(said.select(*key, score.alias("score"), "error")), key, "left")


def judge_in_one_call(groups: DataFrame, judge: Client, most: int, zero_fill: bool = False, **calls) -> DataFrame:
    """All passages of a group in one prompt: ``groups`` (query, persona_id, profile, docs, an array of structs chunk_id and
    text, at most ``most`` of them) as query, persona_id, docs (chunk_id, text, teacher_score). A failed call leaves scores
    null, or zero with ``zero_fill``, as the older producer did; scores the reply lacks are zero, further ones are ignored."""
    asked = groups.withColumn("prompt", prompts.batched_judge_prompt(F.col("query"), F.col("profile"), F.transform("docs", lambda d: d["text"])))
    said = materialize(complete(asked, ["query", "persona_id"], "prompt", judge, **calls))
    read = F.when(F.col("reply").isNotNull(), parsing.batched_scores(F.col("reply"), most))
    missing = F.lit(0.0 if zero_fill else None).cast("double")
    j = groups.join(said.select("query", "persona_id", read.alias("s")), ["query", "persona_id"], "left")
    scored = F.transform("docs", lambda d, i: F.struct(d["chunk_id"].alias("chunk_id"), d["text"].alias("text"), F.when(F.col("s").isNotNull(), F.get("s", i)).otherwise(missing).alias("teacher_score")))
    return j.select("query", "persona_id", scored.alias("docs"))


def judge_pairs(jobs: DataFrame, outputs: DataFrame, judge: Client, **calls) -> DataFrame:
    """Pairwise judgments: ``jobs`` (job_key, question_ref, persona_id, query, candidate_a, candidate_b) with ``winner`` (A, B,
    TIE or null), ``status`` (ok or missing) and ``attempts``. ``outputs`` has candidate, question_ref, persona_id and
    rewrite. An endpoint that fails for good ends the job."""
    side = lambda c: outputs.select(F.col("candidate").alias(f"candidate_{c}"), "question_ref", "persona_id", F.col("rewrite").alias(f"_{c}"))
    keys = ["question_ref", "persona_id"]
    both = jobs.join(side("a"), ["candidate_a", *keys]).join(side("b"), ["candidate_b", *keys])
    asked = both.withColumn("prompt", prompts.pairwise_prompt(F.col("query"), F.col("_a"), F.col("_b")))
    said = materialize(complete(asked, ["job_key"], "prompt", judge, abort=True, **calls).withColumn("winner", parsing.verdict(F.col("reply"))))
    j = jobs.join(said.select("job_key", "winner", "attempts", "error"), "job_key", "left")
    return j.withColumn("status", F.when(F.col("winner").isNotNull(), "ok").otherwise("missing"))


def score_answers(rows: DataFrame, key: list[str], primary: Client, secondary: Client | None, prompt: str, **calls) -> DataFrame:
    """``rows`` with the scores of two judges, structs of the five fields, ``status`` and ``failure_stage``: without the
    first judge's scores a row has failed, the second judge is optional. Rows without an answer (a null ``prompt``) are sent
    to neither."""
    out = rows
    for name, client in (("primary", primary), ("secondary", secondary)):
        if client is None:
            continue
        said = materialize(complete(rows, key, prompt, client, **calls).select(*key, parsing.judge_scores(F.col("reply")).alias(name)))
        out = out.join(said, key, "left")
    out = out if secondary is not None else out.withColumn("secondary", F.lit(None).cast(out.schema["primary"].dataType))
    stage = F.when(F.col(prompt).isNull(), "generation").when(F.col("primary").isNull(), "judge_primary")
    return out.withColumn("failure_stage", stage).withColumn("status", F.when(stage.isNull(), "ok").otherwise("failed"))


def preference_rows(questions: DataFrame, personas: DataFrame, corpus: DataFrame, rewriter: Client, answerer: Client, judge: Client, rewrites: int, k: int = 5, **calls) -> DataFrame:
    """The older way to preference rows, end to end: ``rewrites`` rewrites of each question for each persona, passages by
    words for each rewrite, an answer from them, a score from 1 to 10, and the best and worst rewrite where they differ:
    question_ref, persona_id, chosen, rejected, margin. A step that fails drops its rewrite."""
    jobs = questions.crossJoin(personas).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(rewrites - 1))))  # personas are few
    key = ["question_ref", "persona_id", "n"]
    jobs = jobs.withColumn("prompt", prompts.rewrite_prompt(F.col("profile"), F.col("query")))
    made = materialize(complete(jobs, key, "prompt", rewriter, **calls).filter("reply is not null").select(*key, F.col("reply").alias("rewrite")))
    made = made.withColumn("id", F.concat_ws("\u0001", *key))
    hits = retrieval.lexical_top_k(made, "id", "rewrite", corpus, "chunk_id", "text", k).join(corpus.select("chunk_id", "source", "text"), "chunk_id")
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("hits"))  # at most k
    asked = made.join(listed, "id", "left").join(jobs.select(*key, "query", "profile"), key).withColumn("prompt", prompts.answer_prompt(F.col("query"), F.col("hits"), F.col("profile")))
    answers = materialize(complete(asked, key, "prompt", answerer, **calls).filter("reply is not null").select(*key, F.col("reply").alias("answer")))
    graded = answers.join(jobs.select(*key, "query", "profile"), key).withColumn("prompt", prompts.ten_point_prompt(F.col("query"), F.col("profile"), F.col("answer")))
    scores = materialize(complete(graded, key, "prompt", judge, **calls).select(*key, parsing.ten_point_score(F.col("reply")).alias("score")).filter("score is not null"))
    return preferences.best_and_worst(made.join(scores, key), ["question_ref", "persona_id"], "rewrite", "score", "n")

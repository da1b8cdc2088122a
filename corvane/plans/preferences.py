"""Queries on labels and preference data: triplets from scored hits, candidates and pairs from stored preference rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, stats
from ..functions import text as tx
from ..operators import markdown, preferences, ranking
from ..session import table

GROUP = ["question_ref", "persona_id"]
SURVIVAL = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5]
TRIPLETS = {"most": 8, "margin": 0.02, "floor": 0.5, "gap": 0.05}


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored groups: each chunk of a question and persona with its highest score."""
    r = table(spark, d, "retrieved_chunks").filter("score is not null and not isnan(score)")
    return r.groupBy(*GROUP, "chunk_id").agg(F.max("score").alias("score"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return preferences.triplet_groups(_scored(spark, d), GROUP, "chunk_id", "score", **TRIPLETS)


def triplets(spark: SparkSession, d: str) -> DataFrame:
    """Positive and negatives of every group that is kept."""
    return _groups(spark, d).filter("dropped is null").select(*GROUP, "positive", F.array_join("negatives", "|").alias("negatives"))


def triplet_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("dropped is null").select(*GROUP, "positive", F.explode("negatives").alias("negative"))


def triplet_drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return preferences.drop_counts(_groups(spark, d))


def negative_margins(spark: SparkSession, d: str) -> DataFrame:
    """All negatives of every group against its positive, summed up per persona."""
    n = preferences.negative_pairs(_scored(spark, d), GROUP, "chunk_id", "score")
    return n.groupBy("persona_id").agg(F.count("*").alias("pairs"), F.round(F.min("margin"), 6).alias("least"), F.round(F.max("margin"), 6).alias("most"))


def label_density(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a score of at least one half per group, averaged per persona."""
    per = _scored(spark, d).groupBy(*GROUP).agg(F.count_if(F.col("score") >= 0.5).alias("good"))
    return per.groupBy("persona_id").agg(F.count("*").alias("groups"), F.round(F.avg("good"), 6).alias("mean_good"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of every preference row as candidates of its question and persona."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "question_ref", "persona_id", "chosen", "rejected", "chosen_score", "rejected_score").distinct()
    side = lambda t, s, i: F.struct(F.col(t).alias("answer"), F.col(s).alias("score"), (F.col("pair_id") * 2 + i).alias("seq"))
    c = p.select("question_ref", "persona_id", F.explode(F.array(side("chosen", "chosen_score", 0), side("rejected", "rejected_score", 1))).alias("c")).select("question_ref", "persona_id", "c.*")
    return c.filter("answer is not null and score is not null").withColumn("samples", (F.col("seq") % 7 % 4).cast("int"))


def candidate_filter(spark: SparkSession, d: str) -> DataFrame:
    c = preferences.candidate_filter(_candidates(spark, d), ["question_ref"], "answer", "score", "samples", 1, "seq")
    return c.select("seq", "question_ref", "filter_reason")


def persona_winners(spark: SparkSession, d: str) -> DataFrame:
    return preferences.winners(_candidates(spark, d), GROUP, "score", "seq").select(*GROUP, "seq", "score")


def _token_similarity(a, b):
    return tx.jaccard(F.array_distinct(tx.words(a)), F.array_distinct(tx.words(b)))


def pair_select_within(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of a question, if it is good enough, with its worst that differs enough."""
    p = preferences.within_pairs(_candidates(spark, d), ["question_ref"], "answer", "score", "seq", 0.05, 0.9, _token_similarity, 0.6)
    return p.select("question_ref", "chosen", "rejected", F.round("chosen_score", 6).alias("chosen_score"), F.round("rejected_score", 6).alias("rejected_score"), F.round("margin", 6).alias("margin"))


def pair_select_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The same with the similarity of normalised texts that production uses."""
    p = preferences.within_pairs(_candidates(spark, d), ["question_ref"], "answer", "score", "seq", 0.05, 0.9, floor=0.6)
    return p.select("question_ref", "chosen", "rejected", F.round("margin", 6).alias("margin"))


def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    """Questions that still yield a pair as the least margin rises."""
    c = preferences.survival_curve(_candidates(spark, d), ["question_ref"], "answer", "score", "samples", 1, "seq", SURVIVAL, 0.9, _token_similarity, 0.6, preferences.plain_key)
    return c.withColumn("rate", F.round("rate", 6))


def best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    p = preferences.best_and_worst(_candidates(spark, d), ["question_ref"], "seq", "score", "seq")
    return p.withColumn("margin", F.round("margin", 6))


def both_orientations(spark: SparkSession, d: str) -> DataFrame:
    return preferences.both_orientations(preferences.winners(_candidates(spark, d), GROUP, "score", "seq"), "question_ref", "persona_id", "seq", "score", 0.05)


def pair_select_cross_texts(spark: SparkSession, d: str) -> DataFrame:
    """Cross pairs whose texts differ enough by their words."""
    best = preferences.winners(_candidates(spark, d), GROUP, "score", "seq")
    personas = table(spark, d, "profiles").select("id").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # twelve rows
    best = best.crossJoin(personas).withColumn("scored_as", F.map_from_entries(F.transform("ids", lambda p: F.struct(p, F.round(F.col("score") * (F.length(p) % 7 + 3) / 10.0, 6)))))
    c = preferences.cross_pairs(best, "question_ref", "persona_id", "answer", "score", "scored_as", 0.05, 0.6, 0.2, _token_similarity)
    return c.select("question_ref", "persona", "rejected_persona", "chosen", "rejected")


def pair_select_cross(spark: SparkSession, d: str) -> DataFrame:
    """Winners of a question against other personas' winners, scored under the own persona by a fixed rule."""
    best = preferences.winners(_candidates(spark, d), GROUP, "score", "seq")
    personas = table(spark, d, "profiles").select("id").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # twelve rows
    foreign = F.map_from_entries(F.transform("ids", lambda p: F.struct(p, F.round(F.col("score") * (F.length(p) % 7 + 3) / 10.0, 6))))
    best = best.crossJoin(personas).withColumn("scored_as", foreign)
    c = preferences.cross_pairs(best, "question_ref", "persona_id", "seq", "score", "scored_as", 0.05, 0.6)
    return c.select("question_ref", "persona", "rejected_persona", "chosen", "rejected", F.round("chosen_score", 6).alias("chosen_score"), F.round("rejected_score", 6).alias("rejected_score"), F.round("margin", 6).alias("margin"))


def pair_validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of all rows, re-delivered ones among them, which count as repeated."""
    p = table(spark, d, "dpo_pairs").drop("created_at")
    personas = [r.id for r in table(spark, d, "profiles").select("id").orderBy("id").collect()]  # twelve rows
    e = preferences.pair_errors(
        p, "pair_id", ["question_ref", "persona_id", "query", "chosen", "rejected"], ["chosen_score", "rejected_score", "margin"], personas, "persona_id", ["within", "cross"], "pair_type", "format_version", 2, "chosen", "rejected",
        ("margin", "chosen_score", "rejected_score"), True,
    )
    return e.select("pair_id", F.array_join("errors", ",").alias("errors"))


def degenerate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose sides are equal once normalised. The tables hold none, so every twentieth row is taken a second time with
    its chosen side, blanks and a stop around it, as the rejected one."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "chosen", "rejected").distinct()
    planted = p.filter("pair_id % 20 = 0").select((-F.col("pair_id")).alias("pair_id"), "chosen", F.concat(F.lit("  "), "chosen", F.lit(" .")).alias("rejected"))
    p = p.unionByName(planted)
    return p.filter(preferences.rewrite_key(F.col("chosen")) == preferences.rewrite_key(F.col("rejected"))).select("pair_id")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prompt_records").select("case_id", "question_ref", "persona_id", "query", "gold_answer").distinct()


def gold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Prompts against the question they refer to: unknown questions, other stems, other answers."""
    gold = table(spark, d, "exam_questions").select("question_ref", "stem", "answer").groupBy("question_ref").agg(F.min(F.struct("stem", "answer")).alias("x")).select("question_ref", "x.*")
    ref = F.when(F.col("case_id") % 50 == 0, F.concat("question_ref", F.lit("?"))).otherwise(F.col("question_ref"))
    return preferences.gold_errors(_prompts(spark, d).withColumn("question_ref", ref), gold, "question_ref", {"query": "stem", "gold_answer": "answer"}).select("case_id", "error")


def cache_errors(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers as a cache for the prompts of the same question and persona."""
    want = _prompts(spark, d).groupBy("question_ref", "persona_id").agg(F.min("query").alias("query"))
    have = table(spark, d, "dpo_pairs").select("pair_id", "question_ref", "persona_id", "query", "chosen").distinct()
    return preferences.cache_errors(want, have, ["question_ref", "persona_id"], "query", "chosen")


def budget_errors(spark: SparkSession, d: str) -> DataFrame:
    """Sides that are too long together with their prompt, at half a token a character, and sides without tokens."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "query", "chosen", "rejected").distinct()
    half = lambda c: F.floor(F.length(F.coalesce(F.col(c), F.lit(""))) / 2).cast("long")
    return preferences.budget_errors(p, {"prompt": half("query"), "chosen": half("chosen"), "rejected": half("rejected")}, 200)


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Questions that both training and test prompts ask."""
    profiles = table(spark, d, "profiles").select(F.col("id").alias("persona_id"), "split")
    r = table(spark, d, "prompt_records").join(profiles, "persona_id")
    return preferences.split_leakage(r.filter("split = 'train'"), r.filter("split = 'test'"), "question_ref")


def split_portable(spark: SparkSession, d: str) -> DataFrame:
    """A split of the questions that depends on each one's hash alone, so it needs no sort."""
    refs = table(spark, d, "exam_questions").select("question_ref").distinct()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), F.col("question_ref")), 256), 1, 8), 16, 10).cast("long") % 1000
    return refs.select("question_ref", F.when(h < 800, "train").when(h < 900, "val").otherwise("test").alias("split"))


def split_exact(spark: SparkSession, d: str) -> DataFrame:
    """A split with exact shares: references that end in 7 are pinned to the test split, the others shuffled by a hash."""
    refs = table(spark, d, "exam_questions").select("question_ref").distinct()
    fixed = refs.filter(F.col("question_ref").endswith("7")).withColumn("split", F.lit("test"))
    return ranking.hash_split(refs, "question_ref", fixed, {"train": 0.8, "val": 0.1, "test": 0.1}, 42)


def sampled_keys(spark: SparkSession, d: str) -> DataFrame:
    """One preference row of each of 100 questions and personas."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "question_ref", "persona_id").distinct()
    return ranking.sample_keys(p, ["question_ref", "persona_id"], "pair_id", 100, 42)


def rank_shards(spark: SparkSession, d: str) -> DataFrame:
    """Prompts dealt out to seven workers."""
    return ranking.round_robin(table(spark, d, "prompt_records").select("case_id").distinct(), "case_id", 7)


def length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in batches of 16 of about one length."""
    p = table(spark, d, "prompt_records").select("case_id", F.length(F.coalesce("query", F.lit(""))).alias("n")).distinct()
    return ranking.length_batches(p, "n", "case_id", 16)


def token_batches(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in batches of at most 2,048 characters, padding counted."""
    p = table(spark, d, "prompt_records").select("case_id", F.length(F.coalesce("query", F.lit(""))).alias("n")).distinct()
    return ranking.token_batches(p, "n", "case_id", 2_048)


def persona_rotation(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rotation(table(spark, d, "profiles").filter("split = 'train'"), "id")


def quantile_variants(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of text lengths per section type in the three definitions in use."""
    c = table(spark, d, "documents").select("section_type", F.length("text").alias("n"))
    return stats.quantiles(c, ["section_type"], "n", {"p25_half_even": ("half_even", 0.25), "p75_half_even": ("half_even", 0.75), "p95_rank": ("nearest_rank", 0.95), "p90_linear": ("linear", 0.9)})


def pair_split_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, questions and query-persona keys per pair type."""
    p = table(spark, d, "dpo_pairs").distinct()
    return p.groupBy("pair_type").agg(F.count("*").alias("rows"), F.countDistinct("question_ref").alias("questions"), F.countDistinct("question_ref", "persona_id").alias("keys"))


def persona_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Mean token Jaccard of the chosen and the rejected answer per persona, and how often they are the same."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "persona_id", "chosen", "rejected").distinct().filter("chosen is not null and rejected is not null")
    sim = _token_similarity(F.col("chosen"), F.col("rejected"))
    return p.groupBy("persona_id").agg(F.count("*").alias("n"), F.round(F.avg(sim), 6).alias("mean_jaccard"), F.count_if(F.col("chosen") == F.col("rejected")).alias("same"))


def similarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "dpo_pairs").select("pair_id", "chosen", "rejected").distinct()
    return p.select("pair_id", F.round(preferences.similarity_ratio(F.col("chosen"), F.col("rejected")), 6).alias("ratio"))


def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normalised answers in their compatibility form."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "chosen").distinct()
    return p.select("pair_id", preferences.rewrite_key(F.col("chosen")).alias("key"))


def question_refs(spark: SparkSession, d: str) -> DataFrame:
    exam, qid = parsing.reference(F.col("question_ref"))
    return table(spark, d, "prompt_records").select("case_id", "question_ref").distinct().select("case_id", exam.alias("exam"), qid.alias("qid"))


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of prompts that no exam question resolves. The tables hold none, so every fortieth prompt's is spoilt."""
    q = table(spark, d, "exam_questions").select("question_ref")
    ref = F.when(F.col("case_id") % 40 == 0, F.concat("question_ref", F.lit("?"))).otherwise(F.col("question_ref"))
    return table(spark, d, "prompt_records").select(ref.alias("question_ref")).distinct().join(q, "question_ref", "left_anti")


def instructed_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries behind their persona's prose as an instruction."""
    profiles = table(spark, d, "profiles").select(F.col("id").alias("persona_id"), "rendered")
    r = table(spark, d, "prompt_records").select("case_id", "persona_id", "query").distinct()
    return r.join(profiles, "persona_id", "left").select("case_id", markdown.instructed_query(F.col("rendered"), F.col("query")).alias("text"))


def star_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by region and nation with subtotals; dimension joins are left to the optimizer's size check."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    j = li.join(o, "l_orderkey").join(c, "c_custkey").join(n, "n_nationkey").join(r, "r_regionkey")
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("items"), F.round(F.sum("rev"), 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (
        triplets, triplet_pairs, triplet_drop_counts, negative_margins, label_density, candidate_filter, persona_winners, pair_select_within, pair_select_ratio, pair_select_cross, pair_select_cross_texts, survival_curve, best_and_worst, both_orientations, gold_errors, cache_errors, budget_errors, split_exact, sampled_keys, rank_shards, length_batches, token_batches, persona_rotation, pair_validation_errors, degenerate_pairs,
        split_leakage, split_portable, quantile_variants, pair_split_summary, persona_divergence, similarity_ratio, answer_keys, question_refs, dangling_refs, instructed_queries, star_rollup,
    )
}

_SCORED = "with sc as (select question_ref, persona_id, chunk_id, max(score) as score from retrieved_chunks where score is not null and not isnan(score) group by 1, 2, 3)"
_GROUPS = (
    _SCORED
    + """, rk as (select *, row_number() over w as place, count(*) over (partition by question_ref, persona_id) as n from sc window w as (partition by question_ref, persona_id order by score desc, chunk_id)),
 tp as (select question_ref, persona_id, any_value(n) as docs, max(case when place = 1 then score end) as top, max(case when place = 2 then score end) as second, max(case when place = 1 then chunk_id end) as positive from rk group by 1, 2),
 ng as (select question_ref, persona_id, chunk_id as negative, place from rk join tp using (question_ref, persona_id) where place > greatest(1, n - 8) and top - score >= 0.05),
 gr as (select tp.*, coalesce(k, 0) as k, case when docs < 2 then 'too_few_docs' when top - second < 0.02 then 'positive_margin' when top < 0.5 then 'positive_score' when coalesce(k, 0) = 0 then 'no_negatives' end as dropped
  from tp left join (select question_ref, persona_id, count(*) as k from ng group by 1, 2) using (question_ref, persona_id))
"""
)
_BL = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SQ = lambda c: f"regexp_replace(regexp_replace({c}, '[{_BL}]+', ' ', 'g'), '^[{_BL}]+|[{_BL}]+$', '', 'g')"
_KEY = lambda c: f"trim({_SQ(c)}, ' .،؛:!?؟\"''«»')"
_TOK = lambda c: f"list_distinct(list_filter(string_split({_SQ(c)}, ' '), lambda x: x != ''))"
_JAC = lambda a, b: f"len(list_intersect({_TOK(a)}, {_TOK(b)})) * 1.0 / greatest(1, len(list_distinct(list_concat({_TOK(a)}, {_TOK(b)}))))"
_CANDS = """
with p as (select distinct pair_id, question_ref, persona_id, chosen, rejected, chosen_score, rejected_score from dpo_pairs),
 c as (select * from (select question_ref, persona_id, chosen as answer, chosen_score as score, pair_id * 2 as seq from p union all select question_ref, persona_id, rejected, rejected_score, pair_id * 2 + 1 from p) where answer is not null and score is not null),
 win as (select * from (select *, row_number() over (partition by question_ref, persona_id order by score desc, seq) as n from c) where n = 1)
"""

ORACLE = {
    "triplets": _GROUPS + "select question_ref, persona_id, any_value(positive) as positive, string_agg(negative, '|' order by place) as negatives from gr join ng using (question_ref, persona_id) where dropped is null group by 1, 2",
    "triplet_pairs": _GROUPS + "select question_ref, persona_id, positive, negative from gr join ng using (question_ref, persona_id) where dropped is null",
    "triplet_drop_counts": _GROUPS
    + "select count(*) as groups_total, count(case when dropped is null then 1 end) as groups_retained, cast(coalesce(sum(case when dropped is null then k end), 0) as bigint) as pairs, "
    + ", ".join(f"count(case when dropped = '{r}' then 1 end) as {r}" for r in ("too_few_docs", "positive_margin", "positive_score", "no_negatives"))
    + " from gr",
    "negative_margins": _SCORED
    + ", b as (select question_ref, persona_id, chunk_id as positive, score as top from (select *, row_number() over (partition by question_ref, persona_id order by score desc, chunk_id) as n from sc) where n = 1) select persona_id, count(*) as pairs, round(min(top - score), 6) as least, round(max(top - score), 6) as most from sc join b using (question_ref, persona_id) where chunk_id != positive group by 1",
    "label_density": _SCORED + ", g as (select question_ref, persona_id, count(case when score >= 0.5 then 1 end) as good from sc group by 1, 2) select persona_id, count(*) as groups, round(avg(good), 6) as mean_good from g group by 1",
    "candidate_filter": _CANDS
    + f", k as (select *, seq % 7 % 4 < 1 as under, {_KEY('answer')} as k from c) select seq, question_ref, case when under then 'under_sampled' when row_number() over (partition by question_ref, k, under order by score desc, seq) > 1 then 'duplicate' end as filter_reason from k",
    "persona_winners": _CANDS + "select question_ref, persona_id, seq, score from win",
    "pair_select_within": _CANDS
    + f""", b as (select * from (select question_ref, answer as chosen, score as chosen_score, seq as s, row_number() over (partition by question_ref order by score desc, seq) as n from c) where n = 1),
 j as (select question_ref, chosen, answer as rejected, chosen_score, score as rejected_score, seq from c join b using (question_ref) where seq != s and chosen_score - score >= 0.05),
 f as (select *, row_number() over (partition by question_ref order by rejected_score, seq desc) as n from j where {_JAC('chosen', 'rejected')} < 0.9 and chosen_score >= 0.6)
 select question_ref, chosen, rejected, round(chosen_score, 6) as chosen_score, round(rejected_score, 6) as rejected_score, round(chosen_score - rejected_score, 6) as margin from f where n = 1""",
    "pair_select_cross": _CANDS
    + """, x as (select a.question_ref, a.persona_id as persona, b.persona_id as rejected_persona, a.seq as chosen, b.seq as rejected, a.score as chosen_score, round(b.score * (length(a.persona_id) % 7 + 3) / 10.0, 6) as rejected_score from win a join win b using (question_ref) where a.persona_id != b.persona_id)
 select question_ref, persona, rejected_persona, chosen, rejected, round(chosen_score, 6) as chosen_score, round(rejected_score, 6) as rejected_score, round(chosen_score - rejected_score, 6) as margin from x where chosen_score - rejected_score >= 0.05 and chosen_score >= 0.6""",
    "pair_select_cross_texts": _CANDS
    + f""", x as (select a.question_ref, a.persona_id as persona, b.persona_id as rejected_persona, a.answer as chosen, b.answer as rejected, a.score as chosen_score, round(b.score * (length(a.persona_id) % 7 + 3) / 10.0, 6) as rejected_score from win a join win b using (question_ref) where a.persona_id != b.persona_id)
 select question_ref, persona, rejected_persona, chosen, rejected from x where chosen_score - rejected_score >= 0.05 and chosen_score >= 0.6 and {_JAC('chosen', 'rejected')} < 0.2""",
    "survival_curve": _CANDS
    + f""", k as (select *, {_KEY('answer')} as k from c where not seq % 7 % 4 < 1), kept as (select * from (select *, row_number() over (partition by question_ref, k order by score desc, seq) as kn from k) where kn = 1),
 b as (select * from (select question_ref, answer as chosen, score as chosen_score, seq as s, row_number() over (partition by question_ref order by score desc, seq) as n from kept) where n = 1 and chosen_score >= 0.6),
 m as (select question_ref, max(chosen_score - score) as widest from kept join b using (question_ref) where seq != s and {_JAC('chosen', 'answer')} < 0.9 group by 1),
 g as (select unnest({SURVIVAL}::double[]) as min_margin), q as (select distinct question_ref from c)
 select min_margin, count(case when widest >= min_margin then 1 end) as groups_with_pair, count(*) as groups, round(count(case when widest >= min_margin then 1 end) * 1.0 / count(*), 6) as rate from g cross join q left join m using (question_ref) group by 1""",
    "best_and_worst": _CANDS
    + """, r as (select *, row_number() over (partition by question_ref order by score desc, seq) as i, row_number() over (partition by question_ref order by score, seq desc) as j from c)
 select a.question_ref, a.seq as chosen, b.seq as rejected, round(a.score - b.score, 6) as margin from r a join r b using (question_ref) where a.i = 1 and b.j = 1 and a.score > b.score""",
    "both_orientations": _CANDS
    + """, j as (select a.question_ref, a.persona_id as pa, b.persona_id as pb, a.seq as ta, b.seq as tb, a.score as sa, b.score as sb from win a join win b using (question_ref) where a.persona_id < b.persona_id and abs(a.score - b.score) > 0.05)
 select question_ref, unnest([pa, pb]) as persona, case when sa > sb then ta else tb end as chosen, case when sa > sb then tb else ta end as rejected from j""",
    "gold_errors": """
 with p as (select distinct case_id, question_ref, persona_id, query, gold_answer from prompt_records), g as (select question_ref, min(row(stem, answer)) as x from exam_questions group by 1)
 select case_id, case when case_id % 50 = 0 or x is null then 'unknown' when query is distinct from x[1] then 'query' when gold_answer is distinct from x[2] then 'gold_answer' end as error from p left join g using (question_ref)""",
    "cache_errors": """
 with w as (select question_ref, persona_id, min(query) as want, true as e from prompt_records group by 1, 2),
 h as (select question_ref, persona_id, count(*) as n, min(query) as p, max(query) as q, min(trim(coalesce(chosen, ''))) as o from (select distinct pair_id, question_ref, persona_id, query, chosen from dpo_pairs) group by 1, 2)
 select * from (select question_ref, persona_id, case when n is null then 'missing' when e is null then 'unexpected' when n > 1 then 'repeated' when p is distinct from want or q is distinct from want then 'other_prompt' when o = '' then 'empty_output' end as error from w full join h using (question_ref, persona_id)) where error is not null""",
    "budget_errors": """
 with p as (select distinct pair_id, query, chosen, rejected from dpo_pairs), s as (select unnest(['chosen', 'rejected']) as side, length(coalesce(query, '')) // 2 as q, unnest([length(coalesce(chosen, '')) // 2, length(coalesce(rejected, '')) // 2]) as own from p)
 select side, count(case when q + own > 200 then 1 end) as over_limit, count(case when own = 0 then 1 end) as without_tokens, max(q + own) as longest from s group by 1""",
    "split_exact": """
 with r as (select distinct question_ref from exam_questions), f as (select question_ref, row_number() over (order by sha256('42' || chr(0) || question_ref), question_ref) as p, count(*) over () as n from r where not ends_with(question_ref, '7'))
 select question_ref, 'test' as split from r where ends_with(question_ref, '7') union all select question_ref, case when p <= floor(n * 0.8::double) then 'train' when p <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'val' else 'test' end from f""",
    "sampled_keys": """
 with p as (select distinct pair_id, question_ref, persona_id from dpo_pairs), f as (select *, sha256('42' || chr(0) || question_ref || chr(0) || persona_id) as k, row_number() over (partition by question_ref, persona_id order by sha256('42' || chr(0) || pair_id), pair_id) as n from p)
 select pair_id, question_ref, persona_id from f where n = 1 order by k limit 100""",
    "rank_shards": "with p as (select distinct case_id from prompt_records) select case_id, (row_number() over (order by sha256(cast(case_id as varchar)), case_id) - 1) % 7 as shard from p",
    "length_batches": "with p as (select distinct case_id, length(coalesce(query, '')) as n from prompt_records), r as (select *, row_number() over (order by n, sha256(cast(case_id as varchar)), case_id) as place from p) select case_id, n, place, (place - 1) // 16 as batch from r",
    "token_batches": """
 with p as (select distinct case_id, length(coalesce(query, '')) as n from prompt_records), c as (select *, cast(pow(2, ceil(log2(greatest(n, 1)))) as bigint) as class from p), r as (select *, row_number() over (partition by class order by sha256(cast(case_id as varchar)), case_id) as i from c)
 select case_id, n, class, (i - 1) // greatest(1, 2048 // class) as batch from r""",
    "persona_rotation": "with p as (select id from profiles where split = 'train') select id, coalesce(lead(id) over (order by id), (select min(id) from p)) as next from p",
    "pair_validation_errors": f"""
 with r as (select * exclude (created_at) from dpo_pairs), p as (select *, count(*) over (partition by pair_id, format_version, question_ref, persona_id, query, chosen, rejected, pair_type, chosen_score, rejected_score, margin, rejected_persona_id) as times from r)
 select pair_id, concat_ws(',', case when format_version is distinct from 2 then 'format_version' end,
  {", ".join(f"case when trim(coalesce({c}, '')) = '' then 'empty:{c}' end" for c in ("question_ref", "persona_id", "query", "chosen", "rejected"))},
  {", ".join(f"case when {c} is null or isnan({c}) then 'number:{c}' end" for c in ("chosen_score", "rejected_score", "margin"))},
  case when not coalesce(persona_id in (select id from profiles), false) then 'persona' end, case when not coalesce(pair_type in ('within', 'cross'), false) then 'pair_type' end,
  case when {_SQ('chosen')} = {_SQ('rejected')} then 'equal_sides' end, case when abs(margin - (chosen_score - rejected_score)) > 1e-6 then 'margin' end, case when times > 1 then 'repeated' end) as errors from p""",
    "degenerate_pairs": f"with p as (select distinct pair_id, chosen, rejected from dpo_pairs), a as (select * from p union all select -pair_id, chosen, '  ' || chosen || ' .' from p where pair_id % 20 = 0) select pair_id from a where {_KEY('chosen')} = {_KEY('rejected')}",
    "split_leakage": "select question_ref from prompt_records r join profiles p on p.id = r.persona_id where split = 'train' intersect select question_ref from prompt_records r join profiles p on p.id = r.persona_id where split = 'test'",
    "split_portable": "with h as (select question_ref, cast(('0x' || substring(sha256('42:' || question_ref), 1, 8)) as bigint) % 1000 as h from (select distinct question_ref from exam_questions)) select question_ref, case when h < 800 then 'train' when h < 900 then 'val' else 'test' end as split from h",
    "quantile_variants": """
 with v as (select section_type, length(text) as n from documents where text is not null),
  l as (select section_type, list_sort(list(n)) as s, count(*) as k from v group by 1)
 select section_type, cast(s[cast(round_even(0.25 * (k - 1), 0) as bigint) + 1] as double) as p25_half_even, cast(s[cast(round_even(0.75 * (k - 1), 0) as bigint) + 1] as double) as p75_half_even,
  cast(s[greatest(cast(ceil(0.95::double * k) as bigint), 1)] as double) as p95_rank, s[cast(floor(0.9::double * (k - 1)) as bigint) + 1] * (1 - (0.9::double * (k - 1) - floor(0.9::double * (k - 1)))) + s[cast(ceil(0.9::double * (k - 1)) as bigint) + 1] * (0.9::double * (k - 1) - floor(0.9::double * (k - 1))) as p90_linear from l""",
    "pair_split_summary": "select pair_type, count(*) as rows, count(distinct question_ref) as questions, count(distinct (question_ref, persona_id)) as keys from (select distinct * from dpo_pairs) group by 1",
    "persona_divergence": f"select persona_id, count(*) as n, round(avg({_JAC('chosen', 'rejected')}), 6) as mean_jaccard, count(case when chosen = rejected then 1 end) as same from (select distinct pair_id, persona_id, chosen, rejected from dpo_pairs where chosen is not null and rejected is not null) group by 1",
    "question_refs": "select case_id, nullif(split_part(question_ref, ':', 1), '') as exam, nullif(substring(question_ref, strpos(question_ref, ':') + 1), '') as qid from (select distinct case_id, question_ref from prompt_records)",
    "dangling_refs": "with r as (select distinct case when case_id % 40 = 0 then question_ref || '?' else question_ref end as question_ref from prompt_records) select question_ref from r where question_ref not in (select question_ref from exam_questions)",
    "instructed_queries": "select case_id, case when coalesce(rendered, '') = '' then query else 'Instruct: ' || rendered || chr(10) || 'Query: ' || query end as text from (select distinct case_id, persona_id, query from prompt_records) r left join profiles p on p.id = r.persona_id",
    "star_rollup": "select r_name, n_name, count(*) as items, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)",
}

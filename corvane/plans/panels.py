"""Queries on evaluation panels: the paired report, judges against each other, retrieval and text panels.

Scores come from the event stream as in ``plans.evaluation``: members are parts of the users, the two judges score two
metrics, one a function of the other's raw number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panels, retrieval
from ..session import table
from .evaluation import _REC, _records

RUNGS = [("views over clicks", "click", "view"), ("purchases over views", "view", "purchase"), ("errors over clicks", "click", "error")]
MEMBERS = {"p0": "train", "p1": "train", "p2": "val", "p3": "test"}
WORDS = ["شعر", "زیرا", "خورشید"]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("member", F.concat(F.lit("p"), (F.col("case_id") % 4).cast("string")))
    one = lambda j, m, v: F.struct(F.lit(j).alias("judge"), F.lit(m).alias("metric"), v.cast("double").alias("score"))
    other = lambda c: (F.col(c) * 3 + F.col("case_id")) % 5
    four = F.array(one("primary", "utility", F.col("score")), one("primary", "quality", other("score")), one("secondary", "utility", F.col("second")), one("secondary", "quality", other("second")))
    return r.select("arm", "case_id", "replicate", "member", F.explode(four).alias("x")).select("arm", "case_id", "replicate", "member", "x.*").filter("score is not null")


def _groups(spark: SparkSession) -> DataFrame:
    """Every member by itself and all together."""
    return spark.createDataFrame([(m, s, m) for m, s in MEMBERS.items()] + [("all", "all", m) for m in MEMBERS], "label string, split string, member string")


def paired_report(spark: SparkSession, d: str) -> DataFrame:
    """Paired differences of every comparison, member group, judge and metric."""
    out = panels.paired_report(_scores(spark, d), RUNGS, _groups(spark), ["case_id", "replicate"], "member")
    return out.withColumns({c: F.round(c, 6) for c in ("before", "after", "delta")})


def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same with resampled intervals and p, adjusted over the whole report."""
    return panels.paired_intervals(_scores(spark, d), RUNGS, _groups(spark), ["case_id", "replicate"], "member")


def judge_agreement_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = panels.judge_agreement(_scores(spark, d), ["case_id", "replicate"], "primary", "secondary")
    return out.select("metric", "arm", "n", *(F.round(c, 6).alias(c) for c in ("exact", "mean_abs_diff", "pearson", "bias")))


def delta_agreement(spark: SparkSession, d: str) -> DataFrame:
    report = panels.paired_report(_scores(spark, d), RUNGS, _groups(spark), ["case_id", "replicate"], "member")
    out = panels.delta_agreement(report, "primary", "secondary")
    return out.select("cells", F.round("pearson", 6).alias("pearson"), F.round("same_sign", 6).alias("same_sign"))


def zero_rates(spark: SparkSession, d: str) -> DataFrame:
    out = panels.zero_rates(_scores(spark, d).filter("judge = 'primary'"), ["arm", "metric"])
    return out.withColumn("zero_rate", F.round("zero_rate", 6))


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    return panels.run_counts(_records(spark, d).withColumn("rank", F.col("event_id") % 2), "rank", "failed", "second")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of every question and persona in each replicate, which stands for the arm."""
    r = table(spark, d, "retrieved_chunks").filter("score is not null and not isnan(score)")
    best = r.groupBy("question_ref", "persona_id", "replicate", "chunk_id").agg(F.max("score").alias("score"))
    from ..operators.heaps import smallest

    entry = F.struct((F.lit(0.0) - F.col("score")).alias("o"), "chunk_id")
    tops = best.groupBy("question_ref", "persona_id", "replicate").agg(smallest(entry, 5).alias("h"))
    return tops.select("question_ref", "persona_id", "replicate", F.explode("h.chunk_id").alias("chunk_id"))


def hit_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of the five best chunks replicates 0 and 1 share."""
    out = retrieval.hit_overlap(_hits(spark, d), ["question_ref", "persona_id"], "replicate", 0, 1, "chunk_id")
    return out.select("n", F.round("overlap", 6).alias("overlap"))


def distinct_hit_sets(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.distinct_hit_sets(_hits(spark, d), "question_ref", "persona_id", "replicate", "chunk_id")
    return out.withColumn("distinct_sets", F.round("distinct_sets", 6))


def hits_vary(spark: SparkSession, d: str) -> DataFrame:
    return panels.hits_vary(_hits(spark, d), "replicate", "question_ref", "persona_id", "chunk_id")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dpo_pairs").select("pair_id", "question_ref", "pair_type", "query", "chosen", "chosen_score").distinct()


def fidelity_split(spark: SparkSession, d: str) -> DataFrame:
    """Scores of answers that keep few, and of those that keep more of the query's content words."""
    a = _answers(spark, d).withColumn("kept", panels.fidelity(F.col("query"), F.col("chosen")))
    return panels.split_by_fidelity(a, "pair_type", "kept", "chosen_score").withColumn("mean_score", F.round("mean_score", 6))


def word_rates(spark: SparkSession, d: str) -> DataFrame:
    return panels.word_rates(_answers(spark, d), "pair_type", "chosen", WORDS).withColumn("rate", F.round("rate", 6))


def text_shape(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of the stored texts per section type, the stems being the texts that may hold gaps."""
    q = table(spark, d, "exam_questions").select("question_ref", "qtype", "stem").distinct()
    p = table(spark, d, "prompt_records").select("question_ref", "query").distinct()
    out = panels.text_shape(q.join(p, "question_ref"), "qtype", "stem", "query")
    return out.withColumns({c: F.round(c, 6) for c in ("words_median", "words_mean", "repeated_trigram_rate", "cloze_kept")})


def confounds(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints are the days of an arm: what goes with its mean score."""
    r = _records(spark, d).groupBy("arm", "day").agg(F.avg("score").alias("recall"), F.avg("second").alias("val_loss"), F.avg(F.col("second").isNotNull().cast("double")).alias("judged"))
    return panels.confounds(r, "recall", ["val_loss", "judged"]).withColumn("pearson", F.round("pearson", 6))


def row_invariants(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("member", F.concat(F.lit("p"), (F.col("case_id") % 4).cast("string"))).withColumn("rank", F.col("event_id") % 2)
    want = {"rows": 9_000, "arms": ["click", "view", "purchase", "error", "signup"], "members": ["p0", "p1", "p2"], "ranks": [0, 1]}
    return panels.row_invariants(r, ["arm", "case_id", "replicate"], "arm", "member", "failed", "score", "second", "rank", want, 0, 3)


QUERIES = {f.__name__: f for f in (paired_report, paired_intervals, judge_agreement_metrics, delta_agreement, zero_rates, run_counts, hit_overlap, distinct_hit_sets, hits_vary, fidelity_split, word_rates, text_shape, confounds, row_invariants)}

_LONG = (
    _REC
    + """, sc as (select arm, case_id, replicate, 'p' || (case_id % 4) as member, judge, metric, cast(v as double) as score from (
  select *, 'primary' as judge, 'utility' as metric, score as v from rec union all select *, 'primary', 'quality', (score * 3 + case_id) % 5 from rec
  union all select *, 'secondary', 'utility', second from rec union all select *, 'secondary', 'quality', (second * 3 + case_id) % 5 from rec) where v is not null),
 rungs as (select * from (values ('views over clicks', 'click', 'view'), ('purchases over views', 'view', 'purchase'), ('errors over clicks', 'click', 'error')) t(comparison, a_arm, b_arm)),
 grp as (select * from (values ('p0', 'train', 'p0'), ('p1', 'train', 'p1'), ('p2', 'val', 'p2'), ('p3', 'test', 'p3'), ('all', 'all', 'p0'), ('all', 'all', 'p1'), ('all', 'all', 'p2'), ('all', 'all', 'p3')) t(label, split, member)),
 rep as (select comparison, label, split, a.judge, a.metric, avg(a.score) as before, avg(b.score) as after, count(*) as n, avg(b.score - a.score) as delta
  from rungs join sc a on a.arm = a_arm join sc b on b.arm = b_arm and b.case_id = a.case_id and b.replicate = a.replicate and b.judge = a.judge and b.metric = a.metric join grp on grp.member = a.member group by 1, 2, 3, 4, 5)
"""
)
_TOPS = """
with sc as (select question_ref, persona_id, replicate, chunk_id, max(score) as score from retrieved_chunks where score is not null and not isnan(score) group by 1, 2, 3, 4),
 hits as (select * from (select *, row_number() over (partition by question_ref, persona_id, replicate order by score desc, chunk_id) as place from sc) where place <= 5),
 sets as (select question_ref, persona_id, replicate, list_sort(list(chunk_id)) as s from hits group by 1, 2, 3)
"""
_ANS = "with a as (select distinct pair_id, question_ref, pair_type, query, chosen, chosen_score from dpo_pairs)"
_CONTENT = "list_distinct(regexp_extract_all(coalesce({}, ''), '[\\x{{600}}-\\x{{6FF}}\\x{{200c}}]{{3,}}'))"
_BL = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE = {
    "paired_report": _LONG + "select comparison, label, split, judge, metric, round(before, 6) as before, round(after, 6) as after, n, round(delta, 6) as delta from rep",
    "judge_agreement_metrics": _LONG
    + ", b as (select x.arm, x.metric, x.score as a, y.score as b from sc x join sc y using (arm, case_id, replicate, metric) where x.judge = 'primary' and y.judge = 'secondary') select metric, arm, count(*) as n, round(avg(case when a = b then 1.0 else 0.0 end), 6) as exact, round(avg(abs(a - b)), 6) as mean_abs_diff, round(corr(a, b), 6) as pearson, round(avg(b - a), 6) as bias from b group by grouping sets ((metric), (metric, arm))",
    "delta_agreement": _LONG + ", x as (select p.delta as x, s.delta as y from rep p join rep s using (comparison, label, metric) where p.judge = 'primary' and s.judge = 'secondary') select count(*) as cells, round(corr(x, y), 6) as pearson, round(avg(case when sign(x) = sign(y) then 1.0 else 0.0 end), 6) as same_sign from x",
    "zero_rates": _LONG + "select arm, metric, count(*) as n, round(avg(case when score = 0 then 1.0 else 0.0 end), 6) as zero_rate from sc where judge = 'primary' group by 1, 2",
    "run_counts": _REC + "select event_id % 2 as rank, count(*) as rows, count(case when failed then 1 end) as failed, count(case when not failed and second is null then 1 end) as secondary_missing from rec group by rollup (event_id % 2)",
    "hit_overlap": _TOPS + "select count(*) as n, round(avg(len(list_intersect(a.s, b.s)) / 5.0), 6) as overlap from sets a join sets b using (question_ref, persona_id) where a.replicate = 0 and b.replicate = 1",
    "distinct_hit_sets": _TOPS + "select replicate, round(avg(n), 6) as distinct_sets from (select replicate, question_ref, count(distinct s) as n from sets group by 1, 2) group by 1",
    "hits_vary": _TOPS + "select replicate, count(*) as questions, count(case when k > 1 then 1 end) as varying from (select replicate, question_ref, count(*) as m, count(distinct s) as k from sets group by 1, 2) where m > 1 group by 1",
    "fidelity_split": _ANS
    + f", f as (select *, len(list_intersect({_CONTENT.format('query')}, {_CONTENT.format('chosen')})) * 1.0 / nullif(len({_CONTENT.format('query')}), 0) as kept from a) select pair_type, case when kept < 0.3 then 'below' else 'at_or_above' end as side, count(*) as n, round(avg(chosen_score), 6) as mean_score from f where kept is not null group by 1, 2",
    "word_rates": _ANS + f", w as (select unnest({WORDS}) as word) select pair_type, word, round(avg(case when contains(chosen, word) then 1.0 else 0.0 end), 6) as rate from a cross join w where chosen is not null group by 1, 2",
    "text_shape": f"""
 with t as (select qtype, stem, query from (select distinct question_ref, qtype, stem from exam_questions) join (select distinct question_ref, query from prompt_records) using (question_ref) where query is not null),
  w as (select *, row_number() over () as id, list_filter(regexp_split_to_array(query, '[{_BL}]+'), lambda x: x != '') as ws from t),
  g as (select id, unnest(range(1, greatest(len(ws) - 1, 1))) as i, ws from w), r as (select id, count(*) as n, count(distinct list_aggregate(ws[i:i + 2], 'string_agg', ' ')) as k from g group by 1)
 select qtype, count(*) as texts, round(cast(median(len(ws)) as double), 6) as words_median, round(avg(len(ws)), 6) as words_mean, round(avg(case when coalesce(k, 0) < coalesce(r.n, 0) then 1.0 else 0.0 end), 6) as repeated_trigram_rate,
  count(case when regexp_matches(stem, '\\.{{3,}}|_{{3,}}|…') then 1 end) as gaps, round(avg(case when regexp_matches(stem, '\\.{{3,}}|_{{3,}}|…') then case when regexp_matches(query, '\\.{{3,}}|_{{3,}}|…') then 1.0 else 0.0 end end), 6) as cloze_kept from w left join r using (id) group by 1""",
    "confounds": _REC
    + ", c as (select arm, day, avg(score) as recall, avg(second) as val_loss, avg(case when second is not null then 1.0 else 0.0 end) as judged from rec group by 1, 2) select 'val_loss' as suspect, count(*) as n, round(corr(val_loss, recall), 6) as pearson from c union all select 'judged', count(*), round(corr(judged, recall), 6) from c",
    "row_invariants": _REC
    + """, ok as (select *, 'p' || (case_id % 4) as member from rec where not failed)
 select 'rows' as invariant, abs(count(*) - 9000) as violations from ok union all select 'arms', 5 - count(distinct arm) from ok union all select 'members', count(distinct member) - 3 from ok union all select 'ranks', 2 - count(distinct event_id % 2) from rec
 union all select 'range', count(case when score not between 0 and 3 then 1 end) + count(case when second not between 0 and 3 then 1 end) from ok
 union all select 'secondary_coverage', greatest(0, cast(ceil(0.9 * 9000) as bigint) - count(second)) from ok
 union all select 'repeated_keys', count(case when n > 1 then 1 end) from (select count(*) as n from ok group by arm, case_id, replicate)""",
}

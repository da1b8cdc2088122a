"""Queries on evaluation runs. The event stream stands for an evaluation log: arms are event types, cases users,
replicates the events of a user in an arm, and scores and a second judge's scores come from the value and the props."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing, stats
from ..operators import contests, runs
from ..session import table

EDGES = [0.0, 1.0, 2.0, 3.0, 4.0]
GRID = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0]


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Arm, case, replicate, both judges' scores (null where the attempt failed), day and config of every attempt."""
    e = table(spark, d, "events")
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    failed = F.col("event_id") % 17 == 0
    score = F.pmod(F.floor("value").cast("long"), F.lit(5))
    second = F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(5))
    return e.select(
        "event_id", F.col("event_type").alias("arm"), F.col("user_id").alias("case_id"), (F.row_number().over(w) - 1).alias("replicate"), failed.alias("failed"),
        F.when(~failed, score).alias("score"), F.when(~failed & (F.col("event_id") % 13 != 0), second).alias("second"), F.when(failed & (F.col("event_id") % 2 == 0), F.lit("generation")).alias("stage"),
        F.concat(F.lit("cfg"), (F.col("event_id") % 10 < 9).cast("int").cast("string")).alias("config"), F.to_date("ts").alias("day"),
    )


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("arm")).distinct()


def _expected(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "events").select(F.col("user_id").alias("case_id")).distinct()
    return runs.expected_keys(_arms(spark, d), cases, 12).select("arm", "case_id", "replicate")


def expected_keys_missing(spark: SparkSession, d: str) -> DataFrame:
    return runs.pending(_expected(spark, d), _records(spark, d), ["arm", "case_id", "replicate"])


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Keys without a successful attempt under the current configuration."""
    done = runs.current_config(_records(spark, d), "cfg1").filter("not failed")
    return runs.pending(_expected(spark, d), done, ["arm", "case_id", "replicate"])


def stale_records(spark: SparkSession, d: str) -> DataFrame:
    return runs.stale_count(_records(spark, d), "cfg1")


def resolve_records(spark: SparkSession, d: str) -> DataFrame:
    """One attempt a day, arm and case: a success if there is one, else the last failure."""
    got = runs.resolve_attempts(_records(spark, d), ["arm", "case_id", "day"], ~F.col("failed"), "event_id")
    return got.select("arm", "case_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "failed", "successes")


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation, valid and failed rows per arm and case group, where groups overlap."""
    r = _records(spark, d).withColumn("part", F.col("case_id") % 4)
    bridge = spark.createDataFrame([("all", i) for i in range(4)] + [("train", i) for i in range(3)] + [("test", 3)] + [(f"part{i}", i) for i in range(4)], "label string, member long")
    s = runs.summarize(runs.with_groups(r, bridge, "part"), ["arm", "label"], "score")
    return s.select("arm", "label", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n_valid", "n_failed")


def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = runs.paired_deltas(_records(spark, d), "arm", "click", "view", ["case_id", "replicate"], "score")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("before"), 6).alias("before"), F.round(F.avg("after"), 6).alias("after"), F.round(F.avg("delta"), 6).alias("delta"))


def _per_arm_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Differences of every arm against the pooled mean score of the case in the same replicate."""
    r = _records(spark, d).filter("score is not null")
    pooled = r.groupBy("case_id", "replicate").agg(F.avg("score").alias("pooled"))
    return r.join(pooled, ["case_id", "replicate"]).select("arm", F.round(F.col("score") - F.col("pooled"), 6).alias("delta"))


def win_tie_loss(spark: SparkSession, d: str) -> DataFrame:
    return runs.win_tie_loss(_per_arm_deltas(spark, d), ["arm"], 1e-9)


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals and permutation p of every arm's differences, Holm-adjusted over the arms."""
    b = stats.bootstrap_by(_per_arm_deltas(spark, d), "arm", "delta", 2_000)
    return stats.holm(b, [], "p", ["arm"]).withColumn("stars", stats.stars(F.col("p_holm")))


def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = runs.judge_agreement(_records(spark, d), "score", "second", "arm")
    return a.select("arm", "n", F.round("exact", 6).alias("exact"), F.round("mean_abs_diff", 6).alias("mean_abs_diff"), F.round("pearson", 6).alias("pearson"))


def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    return runs.failure_histogram(_records(spark, d).filter("failed"), "stage")


def holm_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted p per part of the cases, from a closed form of each arm's counts."""
    r = _records(spark, d).withColumn("part", F.col("case_id") % 4)
    p = r.groupBy("part", "arm").agg(((F.count_if(F.col("score") >= 2) * 37 % 101) / 1010.0).alias("p"))
    return stats.holm(p, ["part"], "p", ["arm"]).select("part", "arm", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    c = _records(spark, d).filter("score is not null").groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 3).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return c.select("arm", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _contests(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of arms on every case and replicate that both scored, as contests of their scores."""
    r = _records(spark, d).filter("score is not null").select("arm", "case_id", "replicate", "score")
    by = r.groupBy("case_id", "replicate").agg(F.map_from_entries(F.collect_list(F.struct("arm", "score"))).alias("m"))  # one entry an arm
    pairs = contests.pairings(_arms(spark, d), "arm", "arm")
    j = by.crossJoin(pairs).withColumn("a", F.try_element_at("m", F.col("left"))).withColumn("b", F.try_element_at("m", F.col("right"))).filter("a is not null and b is not null")
    result = F.when(F.col("a") > F.col("b"), "win").when(F.col("a") == F.col("b"), "tie").otherwise("loss")
    return j.select("left", "right", "case_id", "replicate", result.alias("result")).withColumn("points", stats.outcome_score(F.col("result")))


def tournament_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return contests.round_robin(_contests(spark, d), "left", "right", "points").select("model", F.round("score", 6).alias("score"), "contests")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The contests with a member each; every nineteenth has no verdict."""
    c = _contests(spark, d).withColumn("member", F.col("case_id") % 4)
    lost = (F.col("case_id") + F.col("replicate")) % 19 == 0
    return c.withColumn("result", F.when(~lost, F.col("result"))).withColumn("points", F.when(~lost, F.col("points")))


def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    h = contests.head_to_head(_verdicts(spark, d), ["left", "right"], "result")
    h = stats.holm(h, [], "p", ["left", "right"])
    return h.select("left", "right", "n", "missing", "wins", "ties", "losses", *(F.round(c, 6).alias(c) for c in ("score", "p", "p_holm")))


def head_to_head_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Resampled intervals of the same mean scores."""
    return contests.score_intervals(_verdicts(spark, d), ["left", "right"], "points")


def tournament_members(spark: SparkSession, d: str) -> DataFrame:
    m = contests.member_scores(_verdicts(spark, d), "left", "right", "member", "points")
    return m.withColumn("score", F.round("score", 6))


def variant_selected(spark: SparkSession, d: str) -> DataFrame:
    v = _verdicts(spark, d).filter("points is not null")
    return contests.select_variant(contests.round_robin(v, "left", "right", "points"), contests.head_to_head(v, ["left", "right"], "result"), "view", "click")


def orientation_balance(spark: SparkSession, d: str) -> DataFrame:
    jobs = contests.balanced_orientation(_contests(spark, d).select("left", "right", "case_id", "replicate"), ["left", "right"], ["case_id", "replicate"])
    return contests.orientation_balance(jobs, ["left", "right"])


def orientation_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = contests.balanced_orientation(_contests(spark, d).select("left", "right", "case_id", "replicate"), ["left", "right"], ["case_id", "replicate"])
    return jobs.select("left", "right", "case_id", "replicate", "job_key", "left_first")


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The second judge as a judge of labels: agreement on decided verdicts, shown first in half of the rows."""
    r = _records(spark, d).filter("score is not null and second is not null")
    v = r.select(F.when(F.col("second") == 2, F.lit(None)).otherwise((F.col("second") > 2) == (F.col("score") > 2)).alias("agrees"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("position"))
    out = contests.label_agreement(v, "agrees", "position")
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "low", "high", "p", "position_p")})


def alternating_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Which side every other case shows first, in order of the cases of a pair of arms."""
    c = _contests(spark, d).filter("replicate = 0").select("left", "right", "case_id")
    return contests.alternating_orientation(c, ["case_id"], ["left", "right"])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Judge samples: candidates are arms of a case, replicates their attempts."""
    return _records(spark, d).withColumn("raw", F.col("second").cast("string")).withColumn("score", F.col("score").cast("double"))


def noise_determinism(spark: SparkSession, d: str) -> DataFrame:
    x = contests.determinism(_samples(spark, d), ["case_id", "arm"], "raw", "score")
    return x.select("candidates", F.round("same_reply", 6).alias("same_reply"), F.round("same_score", 6).alias("same_score"))


def noise_spread(spark: SparkSession, d: str) -> DataFrame:
    x = contests.spread_summary(contests.spreads(_samples(spark, d), ["case_id", "arm"], "score"))
    return x.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "max")))


def noise_bands(spark: SparkSession, d: str) -> DataFrame:
    x = contests.spread_by_band(contests.spreads(_samples(spark, d), ["case_id", "arm"], "score"), EDGES)
    return x.withColumn("mean_sd", F.round("mean_sd", 6))


def candidate_deltas(spark: SparkSession, d: str) -> DataFrame:
    x = contests.candidate_deltas(_samples(spark, d).filter("score is not null"), ["case_id"], "arm", "replicate", "score")
    return x.select("case_id", "left", "right", F.round("delta", 6).alias("delta"), F.round("sd", 6).alias("sd"), "n")


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Differences of pairs of arms in single replicates against their mean difference."""
    s = _samples(spark, d).filter("score is not null").select("case_id", "arm", "replicate", "score")
    base = contests.candidate_deltas(s, ["case_id"], "arm", "replicate", "score").select("case_id", "left", "right", F.round("delta", 6).alias("base"))
    a, b = s.withColumnsRenamed({"arm": "left", "score": "a"}), s.withColumnsRenamed({"arm": "right", "score": "b"})
    return base.join(a, ["case_id", "left"]).join(b, ["case_id", "right", "replicate"]).select((F.col("a") - F.col("b")).alias("delta"), "base")


def flip_curve(spark: SparkSession, d: str) -> DataFrame:
    c = contests.flip_curve(_observations(spark, d), "delta", "base", GRID)
    return c.withColumn("rate", F.round("rate", 6))


def recommend_margin(spark: SparkSession, d: str) -> DataFrame:
    return contests.recommended_margin(contests.flip_curve(_observations(spark, d), "delta", "base", GRID), 30, 0.45)


def _replicate_deltas(spark: SparkSession, d: str) -> DataFrame:
    return contests.replicate_deltas(_samples(spark, d).filter("score is not null"), ["case_id"], "arm", "replicate", "score")


def flip_first(spark: SparkSession, d: str) -> DataFrame:
    """Flips against the first replicate, which is what a single judgement would have said."""
    c = contests.flip_curve(_replicate_deltas(spark, d).filter("not is_first"), "delta", "first", GRID)
    return c.withColumn("rate", F.round("rate", 6))


def flip_bins(spark: SparkSession, d: str) -> DataFrame:
    """Flips against the mean difference, by its size."""
    o = _replicate_deltas(spark, d).withColumn("base", F.round("mean", 6))
    return contests.flip_bins(o, "delta", "base", GRID).withColumn("flip_rate", F.round("flip_rate", 6))


def margin_recommendation(spark: SparkSession, d: str) -> DataFrame:
    curve = contests.flip_curve(_replicate_deltas(spark, d).filter("not is_first"), "delta", "first", GRID)
    same = contests.determinism(_samples(spark, d), ["case_id", "arm"], "raw", "score")
    return contests.recommendation(curve, same, 30, 0.6).withColumn("flip_rate", F.round("flip_rate", 6))


def pair_noise(spark: SparkSession, d: str) -> DataFrame:
    spread = contests.spreads(_samples(spark, d), ["case_id", "arm"], "score")
    out = contests.pair_noise(_replicate_deltas(spark, d), ["case_id", "left", "right"], spread)
    return out.select("pairs", *(F.round(c, 6).alias(c) for c in out.columns if c != "pairs"))


def score_parse(spark: SparkSession, d: str) -> DataFrame:
    """Strict, lenient and token parses of replies made of the events' numbers."""
    e = table(spark, d, "events")
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" 0."), (F.col("event_id") % 97).cast("string"), F.lit(" "))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("score: "), (F.col("event_id") % 13).cast("string"))).when(F.col("event_id") % 4 == 2, F.lit("none")).otherwise(F.lit("1.00"))
    return e.select("event_id", parsing.strict_unit_score(reply).alias("strict"), parsing.lenient_unit_score(reply).alias("lenient"), parsing.ten_point_score(reply).alias("ten_point"))


QUERIES = {
    f.__name__: f
    for f in (
        expected_keys_missing, resume_pending, stale_records, resolve_records, arm_summary, paired_deltas, win_tie_loss, paired_bootstrap, judge_agreement, failure_histogram, holm_adjust, wilson_interval,
        tournament_round_robin, head_to_head, head_to_head_intervals, tournament_members, variant_selected, alternating_jobs, flip_first, flip_bins, margin_recommendation, pair_noise, orientation_balance, orientation_jobs, label_agreement, noise_determinism, noise_spread, noise_bands, candidate_deltas, flip_curve, recommend_margin, score_parse,
    )
}

_REC = """
with rec as (
  select event_id, event_type as arm, user_id as case_id, row_number() over (partition by event_type, user_id order by event_id) - 1 as replicate,
   event_id % 17 = 0 as failed,
   case when event_id % 17 != 0 then ((cast(floor(value) as bigint) % 5) + 5) % 5 end as score,
   case when event_id % 17 != 0 and event_id % 13 != 0 then cast(json_extract_string(props, '$.k') as bigint) % 5 end as second,
   case when event_id % 17 = 0 and event_id % 2 = 0 then 'generation' end as stage,
   case when event_id % 10 < 9 then 'cfg1' else 'cfg0' end as config, cast(ts as date) as day
  from events),
 expected as (select arm, case_id, replicate from (select distinct event_type as arm from events) cross join (select distinct user_id as case_id from events) cross join (select unnest(range(0, 12)) as replicate))
"""
_PARTS = ", bridge as (select 'all' as label, unnest([0, 1, 2, 3]) as part union all select 'train', unnest([0, 1, 2]) union all select 'test', 3 union all select 'part' || i, i from (select unnest([0, 1, 2, 3]) as i))"
_DELTAS = ", pooled as (select case_id, replicate, avg(score) as pooled from rec where score is not null group by 1, 2), del as (select arm, round(score - pooled, 6) as delta from rec join pooled using (case_id, replicate) where score is not null)"
_CONTESTS = """, c as (
  select a.arm as left, b.arm as right, case_id, replicate, case when a.score > b.score then 'win' when a.score = b.score then 'tie' else 'loss' end as result
  from rec a join rec b using (case_id, replicate) where a.arm < b.arm and a.score is not null and b.score is not null),
 p as (select *, case result when 'win' then 1.0 when 'tie' then 0.5 else 0.0 end as points from c),
 jobs as (select "left", "right", case_id, replicate, sha256("left" || chr(0) || "right" || chr(0) || case_id || chr(0) || replicate) as job_key from c),
 oriented as (select *, row_number() over (partition by "left", "right" order by job_key) <= count(*) over (partition by "left", "right") // 2 as left_first from jobs)"""
_SPREAD = ", s as (select * from rec), sp as (select case_id, arm, avg(score) as mean, stddev_samp(score) as sd, count(score) as n from s group by 1, 2 having count(score) >= 2)"
_BANDS = " + ".join(f"case when mean >= {lo} then 1 else 0 end" for lo in EDGES[1:-1])
_CAND = _SPREAD + """, cd as (
  select case_id, a.arm as left, b.arm as right, avg(a.score - b.score) as delta, stddev_samp(a.score - b.score) as sd, count(*) as n
  from s a join s b using (case_id, replicate) where a.arm < b.arm and a.score is not null and b.score is not null group by 1, 2, 3 having count(*) >= 2),
 obs as (select a.score - b.score as delta, round(cd.delta, 6) as base from cd join s a on a.case_id = cd.case_id and a.arm = cd.left join s b on b.case_id = cd.case_id and b.arm = cd.right and b.replicate = a.replicate where a.score is not null and b.score is not null),
 grid as (select unnest([0.0, 0.5, 1.0, 1.5, 2.0, 3.0]::double[]) as threshold),
 curve as (select threshold, count(base) as n, count(case when delta = 0 or base = 0 or sign(delta) != sign(base) then base end) as flips from grid left join obs on abs(base) >= threshold group by 1)"""
_VERDICTS = _CONTESTS + """, v as (select *, case when (case_id + replicate) % 19 != 0 then points end as pts, case_id % 4 as member from p),
 h as (select "left", "right", count(pts) as n, count(*) - count(pts) as missing, count(case when pts = 1 then 1 end) as wins, count(case when pts = 0.5 then 1 end) as ties, count(case when pts = 0 then 1 end) as losses, avg(pts) as score from v group by 1, 2),
 rr as (select model, avg(s) as score, count(*) as contests from (select "left" as model, pts as s from v where pts is not null union all select "right", 1 - pts from v where pts is not null) group by 1)"""
#: Two-sided p of k successes in n fair trials.
_EXACT = lambda k, n: f"case when 2 * least({k}, {n} - {k}) >= {n} - 1 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0))))) end"
_RDELTAS = """, rd as (select case_id, a.arm as left, b.arm as right, replicate, a.score - b.score as delta from rec a join rec b using (case_id, replicate) where a.arm < b.arm and a.score is not null and b.score is not null),
 rb as (select *, first_value(delta) over w as first, avg(delta) over g as mean, min(replicate) over g = replicate as is_first, count(*) over g as k from rd window w as (partition by case_id, "left", "right" order by replicate), g as (partition by case_id, "left", "right")),
 rp as (select *, round(mean, 6) as base from rb where k >= 2), grid as (select unnest([0.0, 0.5, 1.0, 1.5, 2.0, 3.0]::double[]) as threshold),
 fc as (select threshold, count(first) as n, count(case when delta = 0 or first = 0 or sign(delta) != sign(first) then first end) as flips from grid left join (select * from rp where not is_first) o on abs(first) >= threshold group by 1)"""
_REPLY = "case event_id % 4 when 0 then ' 0.' || (event_id % 97) || ' ' when 1 then 'score: ' || (event_id % 13) when 2 then 'none' else '1.00' end"

ORACLE = {
    "expected_keys_missing": _REC + "select * from expected anti join rec using (arm, case_id, replicate)",
    "resume_pending": _REC + "select * from expected anti join (select * from rec where config = 'cfg1' and not failed) r using (arm, case_id, replicate)",
    "stale_records": _REC + "select count(case when config = 'cfg1' then 1 end) as fresh, count(case when config != 'cfg1' then 1 end) as stale from rec",
    "resolve_records": _REC
    + "select arm, case_id, strftime(day, '%Y-%m-%d') as day, event_id, failed, cast(successes as bigint) as successes from (select *, sum(case when failed then 0 else 1 end) over (partition by arm, case_id, day) as successes, row_number() over (partition by arm, case_id, day order by failed, event_id desc) as n from rec) where n = 1",
    "arm_summary": _REC
    + _PARTS
    + "select arm, label, round(avg(score), 6) as mean, round(case when count(score) = 1 then 0.0 else stddev_samp(score) end, 6) as sd, count(score) as n_valid, count(*) - count(score) as n_failed from rec join bridge on rec.case_id % 4 = bridge.part group by 1, 2",
    "paired_deltas": _REC
    + "select count(*) as n, round(avg(a.score), 6) as before, round(avg(b.score), 6) as after, round(avg(b.score - a.score), 6) as delta from rec a join rec b using (case_id, replicate) where a.arm = 'click' and b.arm = 'view' and a.score is not null and b.score is not null",
    "win_tie_loss": _REC + _DELTAS + "select arm, count(case when delta > 1e-9 then 1 end) as wins, count(case when abs(delta) <= 1e-9 then 1 end) as ties, count(case when delta < -1e-9 then 1 end) as losses from del group by 1",
    "judge_agreement": _REC
    + "select arm, count(*) as n, round(avg(case when score = second then 1.0 else 0.0 end), 6) as exact, round(avg(abs(score - second)), 6) as mean_abs_diff, round(corr(score, second), 6) as pearson from rec where score is not null and second is not null group by rollup (arm)",
    "failure_histogram": _REC + "select coalesce(stage, 'unknown') as stage, count(*) as n from rec where failed group by 1",
    "holm_adjust": _REC
    + """, p as (select case_id % 4 as part, arm, (count(case when score >= 2 then 1 end) * 37 % 101) / 1010.0 as p from rec group by 1, 2),
 st as (select *, row_number() over (partition by part order by p, arm) as rk, count(*) over (partition by part) as m from p)
 select part, arm, round(p, 6) as p, round(max(least(1.0, (m - rk + 1) * p)) over (partition by part order by rk rows unbounded preceding), 6) as p_holm from st""",
    "wilson_interval": _REC
    + """, c as (select arm, count(*) as n, count(case when score >= 3 then 1 end) as k from rec where score is not null group by 1), x as (select *, k * 1.0 / n as p, 3.8416 as zz from c)
 select arm, n, k, round(greatest(0.0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 6) as low,
  round(least(1.0, (p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 6) as high from x""",
    "tournament_round_robin": _REC + _CONTESTS + 'select model, round(avg(s), 6) as score, count(*) as contests from (select "left" as model, points as s from p union all select "right", 1 - points from p) group by 1',
    "head_to_head": _REC
    + _VERDICTS
    + f""", x as (select *, {_EXACT('wins', '(wins + losses)')} as p0 from h), r as (select *, row_number() over (order by p0, "left", "right") as rk, count(*) over () as m from x)
 select "left", "right", n, missing, wins, ties, losses, round(score, 6) as score, round(p0, 6) as p, round(max(least(1.0, (m - rk + 1) * p0)) over (order by rk rows unbounded preceding), 6) as p_holm from r""",
    "tournament_members": _REC + _VERDICTS + 'select model, member, round(avg(s), 6) as score, count(*) as n from (select "left" as model, member, pts as s from v where pts is not null union all select "right", member, 1 - pts from v where pts is not null) group by 1, 2',
    "variant_selected": _REC
    + _VERDICTS
    + """, x as (select (select score from rr where model = 'view') as a, (select score from rr where model = 'click') as b, 1 - (select score from h where "left" = 'click' and "right" = 'view') as d)
 select case when a != b then case when a > b then 'view' else 'click' end when d >= 0.5 then 'view' else 'click' end as selected, case when a != b then 'all contests' when d != 0.5 then 'direct contest' else 'preference' end as by from x""",
    "alternating_jobs": _REC + _CONTESTS + 'select "left", "right", case_id, (row_number() over (partition by "left", "right" order by case_id) - 1) % 2 = 0 as chosen_is_a from c where replicate = 0',
    "label_agreement": _REC
    + f""", v as (select case when second = 2 then null else (second > 2) = (score > 2) end as agrees, case when event_id % 2 = 0 then 'A' else 'B' end as position from rec where score is not null and second is not null),
 c as (select count(case when agrees then 1 end) as agree, count(case when not agrees then 1 end) as disagree, count(case when agrees is null then 1 end) as tie, count(case when agrees is not null and position = 'A' then 1 end) as picked_a, count(case when agrees is not null and position = 'B' then 1 end) as picked_b from v),
 x as (select *, agree + disagree as n, agree * 1.0 / (agree + disagree) as pr, 3.8416 as zz from c)
 select agree, disagree, tie, picked_a, picked_b, round(pr, 6) as rate, round(greatest(0.0, (pr + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(pr * (1 - pr) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 6) as low, round(least(1.0, (pr + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(pr * (1 - pr) / n + zz / (4.0 * n * n)) / (1 + zz / n)), 6) as high,
  round({_EXACT('agree', 'n')}, 6) as p, round({_EXACT('picked_a', '(picked_a + picked_b)')}, 6) as position_p from x""",
    "flip_first": _REC + _RDELTAS + "select threshold, n, flips, round(flips * 1.0 / nullif(n, 0), 6) as rate from fc",
    "flip_bins": _REC
    + _RDELTAS
    + """, bins as (select unnest([0.0, 0.5, 1.0, 1.5, 2.0]::double[]) as margin_from, unnest([0.5, 1.0, 1.5, 2.0, 3.0]::double[]) as margin_to)
 select margin_from, margin_to, count(base) as n, round(avg(case when base is not null then case when delta = 0 or base = 0 or sign(delta) != sign(base) then 1.0 else 0.0 end end), 6) as flip_rate
 from bins left join rp on abs(base) >= margin_from and (abs(base) < margin_to or margin_to = 3.0) group by 1, 2""",
    "margin_recommendation": _REC
    + _RDELTAS
    + """, f as (select * from fc where n >= 30 and flips * 1.0 / nullif(n, 0) < 0.6 order by threshold limit 1)
 select threshold, round(flips * 1.0 / n, 6) as flip_rate, n as support, case when threshold is null then 'no threshold reaches the aim' end as reason from (select 1) left join f on true""",
    "pair_noise": _REC
    + _SPREAD
    + _RDELTAS.replace(", rd as", ", rd as", 1)
    + """, pp as (select stddev_samp(delta) as sd from rp group by case_id, "left", "right"), q as (select count(*) as pairs, avg(sd) as pair_sd from pp), o as (select avg(sd) as s from sp)
 select pairs, round((select avg(abs(delta)) from rp), 6) as mean_abs_delta, round(pair_sd, 6) as pair_sd, round(s * sqrt(2.0), 6) as independent_sd, round(1 - pair_sd * pair_sd / (2 * s * s), 6) as implied_correlation from q cross join o""",
    "orientation_balance": _REC + _CONTESTS + 'select "left", "right", count(case when left_first then 1 end) as left_a, count(case when not left_first then 1 end) as right_a, abs(count(case when left_first then 1 end) - count(case when not left_first then 1 end)) <= 1 as balanced from oriented group by 1, 2',
    "orientation_jobs": _REC + _CONTESTS + 'select "left", "right", case_id, cast(replicate as integer) as replicate, job_key, left_first from oriented',
    "noise_determinism": _REC
    + ", s as (select * from rec where score is not null), c as (select case_id, arm, count(distinct second) as replies, count(distinct score) as scores from s group by 1, 2 having count(*) >= 2) select count(*) as candidates, round(avg(case when replies = 1 then 1.0 else 0.0 end), 6) as same_reply, round(avg(case when scores = 1 then 1.0 else 0.0 end), 6) as same_score from c",
    "noise_spread": _REC + _SPREAD + "select count(*) as n, round(avg(sd), 6) as mean, round(quantile_cont(sd, 0.5), 6) as p50, round(quantile_cont(sd, 0.9), 6) as p90, round(max(sd), 6) as max from sp",
    "noise_bands": _REC
    + _SPREAD
    + f", b as (select {_BANDS} as band, sd from sp), dim as (select unnest([0, 1, 2, 3]) as band) select cast(dim.band as integer) as band, cast(dim.band as double) as low, cast(dim.band + 1 as double) as high, count(sd) as n, round(avg(sd), 6) as mean_sd from dim left join b using (band) group by dim.band",
    "candidate_deltas": _REC + _CAND + 'select case_id, "left", "right", round(delta, 6) as delta, round(sd, 6) as sd, n from cd',
    "flip_curve": _REC + _CAND + "select threshold, n, flips, round(flips * 1.0 / nullif(n, 0), 6) as rate from curve",
    "recommend_margin": _REC + _CAND + "select min(case when n >= 30 and flips * 1.0 / nullif(n, 0) < 0.45 then threshold end) as threshold from curve",
    "score_parse": f"""
 with r as (select event_id, {_REPLY} as reply from events)
 select event_id, case when regexp_full_match(trim(reply), '0(\\.\\d+)?|1(\\.0+)?') then try_cast(trim(reply) as double) end as strict,
  coalesce(least(1.0, greatest(0.0, try_cast(nullif(regexp_extract(reply, '([\\d.]+)', 1), '') as double))), 0.0) as lenient,
  list_filter(list_transform(list_filter(string_split(trim(reply), ' '), lambda x: x != ''), lambda x: try_cast(x as double)), lambda x: x >= 1 and x <= 10)[1] as ten_point from r""",
}

"""Pairwise tournaments, label agreement and the noise of judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bin_index, binomial_p, bootstrap_counts, sign_flip, sign_p, wilson
from .ranking import ranks_in_blocks


def pairings(models: DataFrame, name: str, order: str) -> DataFrame:
    """All unordered pairs of a tournament's models, a handful of rows: left, right."""
    a, b = models.select(F.col(name).alias("left"), F.col(order).alias("_l")), models.select(F.col(name).alias("right"), F.col(order).alias("_r"))
    return a.join(b, F.col("_l") < F.col("_r")).select("left", "right")


def balanced_orientation(jobs: DataFrame, pair: list[str], prompt: list[str]) -> DataFrame:
    """``jobs`` with ``job_key`` and ``left_first``: in hash order of the jobs of a pair, the first half shows the left
    model as A. Counts per pair differ by one at most. Places are counted in blocks of equal first hash digits, so a pair of
    any number of jobs is never sorted in one task."""
    key = F.sha2(F.concat_ws("\u0000", *[F.col(c).cast("string") for c in pair + prompt]), 256)
    ranked = ranks_in_blocks(jobs.withColumn("job_key", key), pair, F.substring("job_key", 1, 3), ["job_key"], "_place", "_of")
    return ranked.withColumn("left_first", F.col("_place") <= F.floor(F.col("_of") / 2)).drop("_place", "_of")


def orientation_balance(jobs: DataFrame, pair: list[str]) -> DataFrame:
    """Per pair how often either model is shown first, and whether that is balanced."""
    c = jobs.groupBy(*pair).agg(F.count_if("left_first").alias("left_a"), F.count_if(~F.col("left_first")).alias("right_a"))
    return c.withColumn("balanced", F.abs(F.col("left_a") - F.col("right_a")) <= 1)


def head_to_head(judged: DataFrame, pair: list[str], result: str) -> DataFrame:
    """Wins, ties and losses of the left model of each pair, jobs without a verdict (null results) as ``missing``, the mean
    score and the exact sign test over decided ones."""
    counts = (F.count_if(F.col(result) == r).alias(c) for r, c in (("win", "wins"), ("tie", "ties"), ("loss", "losses")))
    out = judged.groupBy(*pair).agg(*counts, F.count_if(F.col(result).isNull()).alias("missing"))
    n = F.col("wins") + F.col("ties") + F.col("losses")
    out = out.withColumn("n", n).withColumn("score", F.try_divide(F.col("wins") + 0.5 * F.col("ties"), n.cast("double")))
    return out.withColumn("p", sign_p(F.col("wins"), F.col("losses")))


def score_intervals(judged: DataFrame, pair: list[str], score: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Resampled interval of the left model's mean score per pair: pair, ``n``, ``mean``, ``low``, ``high``. Only counts of
    wins, ties and losses are resampled."""
    counted = judged.filter(F.col(score).isNotNull()).groupBy(*pair, score).agg(F.count("*").alias("n"))
    return bootstrap_counts(counted, pair, score, "n", resamples, seed).drop("p")


def member_scores(judged: DataFrame, left: str, right: str, member: str, score: str) -> DataFrame:
    """Each model's mean score per member over all its contests that have a verdict."""
    two = F.array(F.struct(F.col(left).alias("model"), F.col(score).alias("s")), F.struct(F.col(right).alias("model"), (1 - F.col(score)).alias("s")))
    sides = judged.filter(F.col(score).isNotNull()).select(member, F.explode(two).alias("x"))
    return sides.groupBy("x.model", member).agg(F.avg("x.s").alias("score"), F.count("*").alias("n"))


def select_variant(scores: DataFrame, contests: DataFrame, preferred: str, other: str) -> DataFrame:
    """One row: which of two models is taken, by the mean score over all contests (``model``, ``score``), then by the direct
    contest (``left``, ``right``, ``score``), then the preferred one; and ``by``, which of the three decided. Null if either
    has no score."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    direct = F.max(F.when((F.col("left") == preferred) & (F.col("right") == other), F.col("score")).when((F.col("left") == other) & (F.col("right") == preferred), 1 - F.col("score")))
    x = scores.agg(of(preferred).alias("a"), of(other).alias("b")).crossJoin(contests.agg(direct.alias("d")))  # one row each
    take = lambda won: F.when(won, preferred).otherwise(other)
    decided = F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("a") != F.col("b"), take(F.col("a") > F.col("b"))).otherwise(take(F.coalesce(F.col("d"), F.lit(0.5)) >= 0.5))
    by = F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("a") != F.col("b"), "all contests").when(F.coalesce(F.col("d"), F.lit(0.5)) != 0.5, "direct contest").otherwise("preference")
    return x.select(decided.alias("selected"), by.alias("by"))


def round_robin(judged: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Each model's mean score over all its contests."""
    sides = judged.select(F.explode(F.array(F.struct(F.col(left).alias("model"), F.col(score).alias("s")), F.struct(F.col(right).alias("model"), (1 - F.col(score)).alias("s")))).alias("x"))
    return sides.groupBy("x.model").agg(F.avg("x.s").alias("score"), F.count("*").alias("contests"))


def label_agreement(verdicts: DataFrame, agrees: str, position: str) -> DataFrame:
    """Agreement of a judge with labels: counts, the rate among decided verdicts with its Wilson interval and exact
    binomial p, and the p of a preference for one position. ``agrees`` is true, false or null for a tie."""
    c = verdicts.agg(
        F.count_if(F.col(agrees)).alias("agree"), F.count_if(~F.col(agrees)).alias("disagree"), F.count_if(F.col(agrees).isNull()).alias("tie"),
        F.count_if((F.col(position) == "A") & F.col(agrees).isNotNull()).alias("picked_a"), F.count_if((F.col(position) == "B") & F.col(agrees).isNotNull()).alias("picked_b"),
    )
    return agreement_statistics(c)


def agreement_statistics(counts: DataFrame) -> DataFrame:
    n = F.col("agree") + F.col("disagree")
    low, high = wilson(F.col("agree"), n)
    out = counts.withColumn("rate", F.when(n > 0, F.col("agree") / n).otherwise(float("nan"))).withColumn("low", low).withColumn("high", high)
    out = out.withColumn("p", binomial_p(F.col("agree"), n))
    return out.withColumn("position_p", binomial_p(F.col("picked_a"), F.col("picked_a") + F.col("picked_b")))


def determinism(samples: DataFrame, candidate: list[str], raw: str, score: str) -> DataFrame:
    """Share of candidates with two usable replies or more whose replies, and whose rounded scores, are all the same."""
    usable = samples.filter(F.col(score).isNotNull())
    per = usable.groupBy(*candidate).agg(F.count("*").alias("n"), F.countDistinct(raw).alias("replies"), F.countDistinct(F.round(score, 6)).alias("scores")).filter("n >= 2")
    return per.agg(F.count("*").alias("candidates"), F.avg((F.col("replies") == 1).cast("double")).alias("same_reply"), F.avg((F.col("scores") == 1).cast("double")).alias("same_score"))


def spreads(samples: DataFrame, candidate: list[str], score: str) -> DataFrame:
    """Mean and sample deviation of each candidate with two scores or more."""
    return samples.groupBy(*candidate).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.count(score).alias("n")).filter("n >= 2")


def spread_summary(per_candidate: DataFrame) -> DataFrame:
    q = lambda x: F.percentile("sd", x)
    return per_candidate.agg(F.count("*").alias("n"), F.avg("sd").alias("mean"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.max("sd").alias("max"))


def spread_by_band(per_candidate: DataFrame, edges: list[float]) -> DataFrame:
    """Deviation by band of the mean score; empty bands are listed too."""
    spark = per_candidate.sparkSession
    bands = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], "band int, low double, high double")
    got = per_candidate.groupBy(bin_index(F.col("mean"), edges).alias("band")).agg(F.count("*").alias("n"), F.avg("sd").alias("mean_sd"))
    return bands.join(got, "band", "left").select("band", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_sd")


def candidate_deltas(samples: DataFrame, group: list[str], candidate: str, replicate: str, score: str) -> DataFrame:
    """All candidates of a group in pairs, with their mean difference and its deviation over common replicates, two at
    least. A group is one question's few candidates by design; replicates join by equality."""
    a = samples.select(*group, F.col(candidate).alias("left"), replicate, F.col(score).alias("_a"))
    b = samples.select(*group, F.col(candidate).alias("right"), replicate, F.col(score).alias("_b"))
    j = a.join(b, [*group, replicate]).filter("left < right")
    d = F.col("_a") - F.col("_b")
    return j.groupBy(*group, "left", "right").agg(F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n")).filter("n >= 2")


def flip_curve(observations: DataFrame, delta: str, baseline: str, grid: list[float]) -> DataFrame:
    """For every threshold the observations with a baseline margin of at least it, and how many contradict the baseline.

    Observations are first counted by the last threshold that they reach, so the grid meets counts, not observations."""
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.abs(F.col(baseline)) >= t))
    counted = observations.groupBy(reached.alias("_r")).agg(F.count("*").alias("n"), F.count_if(sign_flip(F.col(delta), F.col(baseline))).alias("flips"))
    each = counted.select(F.explode(F.slice(F.array(*[F.lit(t) for t in grid]), F.lit(1), F.col("_r"))).alias("threshold"), "n", "flips")
    out = each.groupBy("threshold").agg(F.sum("n").alias("n"), F.sum("flips").alias("flips"))
    grid_df = observations.sparkSession.createDataFrame([(t,) for t in grid], "threshold double")
    out = grid_df.join(out, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flips", F.lit(0)).alias("flips"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("flips") / F.col("n")))


def replicate_deltas(samples: DataFrame, group: list[str], candidate: str, replicate: str, score: str) -> DataFrame:
    """Every pair of candidates of a group in every replicate that scored both, with ``delta``, ``first``, the difference in
    the first such replicate, ``mean``, that over all, and ``is_first``. Pairs with two replicates or more."""
    a = samples.select(*group, F.col(candidate).alias("left"), replicate, F.col(score).alias("_a"))
    b = samples.select(*group, F.col(candidate).alias("right"), replicate, F.col(score).alias("_b"))
    j = a.join(b, [*group, replicate]).filter("left < right").withColumn("delta", F.col("_a") - F.col("_b"))
    per = j.groupBy(*group, "left", "right").agg(F.min_by("delta", replicate).alias("first"), F.avg("delta").alias("mean"), F.min(replicate).alias("_at"), F.count("*").alias("_n")).filter("_n >= 2")
    out = j.join(per, [*group, "left", "right"])
    return out.select(*group, "left", "right", replicate, "delta", "first", "mean", (F.col(replicate) == F.col("_at")).alias("is_first"))


def flip_bins(observations: DataFrame, delta: str, baseline: str, edges: list[float]) -> DataFrame:
    """Observations and flips by the baseline margin's bin; empty bins are listed with a null rate."""
    counted = observations.groupBy(bin_index(F.abs(F.col(baseline)), edges).alias("bin")).agg(F.count("*").alias("n"), F.count_if(sign_flip(F.col(delta), F.col(baseline))).alias("flips"))
    bins = observations.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bin int, margin_from double, margin_to double")
    return bins.join(counted, "bin", "left").select("margin_from", "margin_to", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("flips") / F.col("n")).alias("flip_rate"))


def recommended_margin(curve: DataFrame, support: int, rate: float) -> DataFrame:
    """The first threshold with enough observations and a flip rate below the aim; null if there is none."""
    return curve.agg(F.min(F.when((F.col("n") >= support) & (F.col("rate") < rate), F.col("threshold"))).alias("threshold"))


def recommendation(curve: DataFrame, determinism: DataFrame, support: int, rate: float) -> DataFrame:
    """One row: the first threshold with enough observations and a flip rate below the aim, with both, or null and the
    ``reason``. Judges whose replies never vary show no flips at all, which recommends nothing."""
    good = (F.col("n") >= support) & (F.col("rate") < rate)
    first = curve.agg(F.min(F.when(good, F.struct("threshold", "rate", "n"))).alias("x")).select("x.threshold", "x.rate", "x.n")
    fixed = determinism.select((F.coalesce("same_reply", F.lit(0.0)) == 1.0).alias("fixed"))
    j = first.crossJoin(fixed)  # one row each
    reason = F.when(F.col("fixed"), "replies never vary").when(F.col("threshold").isNull(), "no threshold reaches the aim")
    held = lambda c: F.when(~F.col("fixed"), F.col(c))
    return j.select(held("threshold").alias("threshold"), held("rate").alias("flip_rate"), held("n").alias("support"), reason.alias("reason"))


def pair_noise(deltas: DataFrame, pair: list[str], spread: DataFrame) -> DataFrame:
    """One row on pairs of candidates over replicates: mean absolute difference, mean deviation of a pair's differences,
    what independent candidates would give (the root of two times their own deviation), and the implied correlation."""
    per = deltas.groupBy(*pair).agg(F.stddev_samp("delta").alias("sd"))
    a = per.agg(F.count("*").alias("pairs"), F.avg("sd").alias("pair_sd"))
    b, c = deltas.agg(F.avg(F.abs("delta")).alias("mean_abs_delta")), spread.agg(F.avg("sd").alias("_s"))
    j = a.crossJoin(b).crossJoin(c)  # one row each
    implied = F.when(F.col("_s") > 0, 1 - F.col("pair_sd") * F.col("pair_sd") / (2 * F.col("_s") * F.col("_s")))
    return j.select("pairs", "mean_abs_delta", "pair_sd", (F.col("_s") * F.sqrt(F.lit(2.0))).alias("independent_sd"), implied.alias("implied_correlation"))


def alternating_orientation(jobs: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """``jobs`` with ``chosen_is_a``: in the order given the first, third and every other job of each ``within`` shows the
    chosen side as A."""
    w = Window.partitionBy(*within).orderBy(*order)
    return jobs.withColumn("chosen_is_a", (F.row_number().over(w) - 1) % 2 == 0)

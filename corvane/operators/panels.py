"""Figures of evaluation reports: paired comparisons over groups, judges against each other, text shapes and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..functions.stats import guarded_corr


def _paired_cells(scores: DataFrame, comparisons: list[tuple[str, str, str]], groups: DataFrame, keys: list[str], member: str) -> DataFrame:
    """How often each pair of scores occurs: comparison, label, split, judge, metric, before, after, n.

    One pass brings the arms of a key together; comparisons, a handful, are then taken out of it, and equal pairs are
    counted before anything is resampled."""
    arms = sorted({a for _, before, after in comparisons for a in (before, after)})
    at = {a: f"_a{i}" for i, a in enumerate(arms)}
    wide = scores.filter(F.col("arm").isin(arms)).groupBy(*keys, member, "judge", "metric").agg(*(F.max(F.when(F.col("arm") == a, F.col("score").cast("double"))).alias(at[a]) for a in arms))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("comparison"), F.col(at[b]).alias("before"), F.col(at[a]).alias("after")) for c, b, a in comparisons))).alias("x")
    pairs = wide.select(member, "judge", "metric", each).select(member, "judge", "metric", "x.*").filter("before is not null and after is not null")
    counted = pairs.groupBy("comparison", member, "judge", "metric", "before", "after").agg(F.count("*").alias("n"))
    return counted.join(groups.withColumnRenamed("member", member), member).groupBy("comparison", "label", "split", "judge", "metric", "before", "after").agg(F.sum("n").alias("n"))


def paired_report(scores: DataFrame, comparisons: list[tuple[str, str, str]], groups: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Differences of pairs of arms for every comparison, group of members, judge and metric: ``before``, ``after``, their
    means over the keys that both arms have a score for, ``delta`` and ``n``.

    ``scores`` has arm, the keys, the member, judge, metric and score (null scores don't count). ``comparisons`` are
    (name, arm before, arm after); ``groups`` (label, split, member) may overlap and is small. Cells without a pair give
    no row."""
    c = _paired_cells(scores, comparisons, groups, keys, member)
    mean = lambda x: F.sum(F.col(x) * F.col("n")) / F.sum("n")
    out = c.groupBy("comparison", "label", "split", "judge", "metric").agg(mean("before").alias("before"), mean("after").alias("after"), F.sum("n").alias("n"))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def paired_intervals(scores: DataFrame, comparisons: list[tuple[str, str, str]], groups: DataFrame, keys: list[str], member: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """``paired_report`` with a resampled interval (``low``, ``high``), the sign-flip ``p`` and ``p_holm``, adjusted over
    all rows of the report. Only counts of distinct differences reach the tasks that resample."""
    c = _paired_cells(scores, comparisons, groups, keys, member)
    family = ["comparison", "label", "split", "judge", "metric"]
    deltas = c.withColumn("delta", F.round(F.col("after") - F.col("before"), 9)).groupBy(*family, "delta").agg(F.sum("n").alias("n"))
    tested = stats.bootstrap_counts(deltas, family, "delta", "n", resamples, seed).drop("n", "mean")
    out = paired_report(scores, comparisons, groups, keys, member).join(tested, family)
    return stats.holm(out, [], "p", family)


def judge_agreement(scores: DataFrame, keys: list[str], primary: str, secondary: str) -> DataFrame:
    """Exact rate, mean absolute difference, Pearson correlation (NaN where either judge is constant) and bias, the mean of
    the second judge less the first, of every metric over all arms (arm null) and per arm."""
    of = lambda j: F.max(F.when(F.col("judge") == j, F.col("score").cast("double")))
    both = scores.groupBy("arm", *keys, "metric").agg(of(primary).alias("a"), of(secondary).alias("b")).filter("a is not null and b is not null")
    parts = [F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("exact"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), guarded_corr("a", "b").alias("pearson"), F.avg(F.col("b") - F.col("a")).alias("bias")]
    return both.groupingSets([["metric"], ["metric", "arm"]], "metric", "arm").agg(*parts)


def delta_agreement(report: DataFrame, primary: str, secondary: str) -> DataFrame:
    """One row: Pearson correlation and share of equal signs of the two judges' differences over all cells of a report."""
    of = lambda j: F.max(F.when(F.col("judge") == j, F.col("delta")))
    both = report.groupBy("comparison", "label", "metric").agg(of(primary).alias("x"), of(secondary).alias("y")).filter("x is not null and y is not null")
    return both.agg(F.count("*").alias("cells"), guarded_corr("x", "y").alias("pearson"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("same_sign"))


def zero_rates(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Share of zeros among the scores there are."""
    return scores.groupBy(*by).agg(F.count(score).alias("n"), F.avg((F.col(score) == 0).cast("double")).alias("zero_rate"))


def run_counts(records: DataFrame, rank: str, failed: str, secondary: str) -> DataFrame:
    """Per rank and over all ranks (null): rows, failed ones, and sound ones without a second score."""
    sound = ~F.col(failed)
    return records.rollup(rank).agg(F.count("*").alias("rows"), F.count_if(F.col(failed)).alias("failed"), F.count_if(sound & F.col(secondary).isNull()).alias("secondary_missing"))


def fidelity(source: Column, rewrite: Column) -> Column:
    """Share of the source's content tokens that the rewrite keeps; null if the source has none."""
    src = tx.content_tokens(F.coalesce(source, F.lit("")))
    return F.size(F.array_intersect(src, tx.content_tokens(F.coalesce(rewrite, F.lit(""))))) / F.nullif(F.size(src), F.lit(0))


def split_by_fidelity(df: DataFrame, by: str, kept: str, score: str, cut: float = 0.3) -> DataFrame:
    """Mean score of rows that keep less, and of those that keep at least ``cut``; rows without a fidelity are in neither."""
    side = F.when(F.col(kept) < cut, "below").otherwise("at_or_above")
    return df.filter(F.col(kept).isNotNull() & ~F.isnan(kept)).groupBy(by, side.alias("side")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def word_rates(df: DataFrame, by: str, text: str, words: list[str]) -> DataFrame:
    """Share of the texts there are that hold each word, as a part of any text: ``by``, ``word``, ``rate``."""
    rates = df.filter(F.col(text).isNotNull()).groupBy(by).agg(*(F.avg(F.contains(F.col(text), F.lit(w)).cast("double")).alias(f"w{i}") for i, w in enumerate(words)))
    return rates.select(by, F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"w{i}").alias("rate")) for i, w in enumerate(words)))).alias("x")).select(by, "x.*")


def text_shape(df: DataFrame, by: str, query: str, text: str) -> DataFrame:
    """Median and mean number of words, share of texts that repeat three words in a row, and, among queries that hold a
    gap to fill, the share of texts that keep one."""
    n = F.size(tx.words(F.col(text)))
    gap = tx.has_cloze(F.col(query))
    rows = df.filter(F.col(text).isNotNull()).select(by, n.alias("n"), tx.has_repeated_trigram(F.col(text)).cast("double").alias("r"), F.when(gap, tx.has_cloze(F.col(text)).cast("double")).alias("c"))
    return rows.groupBy(by).agg(F.count("*").alias("texts"), F.median("n").alias("words_median"), F.avg("n").alias("words_mean"), F.avg("r").alias("repeated_trigram_rate"), F.count("c").alias("gaps"), F.avg("c").alias("cloze_kept"))


def confounds(points: DataFrame, target: str, suspects: list[str]) -> DataFrame:
    """Pearson correlation of each suspect with the target over checkpoints: ``suspect``, ``n``, ``pearson``."""
    row = points.agg(F.count("*").alias("n"), *(guarded_corr(s, target).alias(s) for s in suspects))
    return row.select("n", F.explode(F.array(*(F.struct(F.lit(s).alias("suspect"), F.col(s).alias("pearson")) for s in suspects))).alias("x")).select("x.suspect", "n", "x.pearson")


def row_invariants(records: DataFrame, keys: list[str], arm: str, member: str, failed: str, score: str, second: str, ranks: str, expected: dict, least: float, most: float, coverage: float = 0.9) -> DataFrame:
    """``invariant`` and ``violations`` of a run: 0 everywhere means that its numbers can be trusted.

    ``expected`` names the number of sound ``rows`` and the values of ``arms``, ``members`` and ``ranks``. Scores must lie
    from ``least`` to ``most``, and at least ``coverage`` of the expected rows need a second score."""
    ok = ~F.col(failed)
    out_of = lambda c: F.count_if(ok & F.col(c).isNotNull() & ~F.col(c).between(least, most))
    seen = lambda c, cond: F.collect_set(F.when(cond, F.col(c)))
    g = records.agg(
        F.count_if(ok).alias("n"), seen(arm, ok).alias("arms"), seen(member, ok).alias("members"), seen(ranks, F.lit(True)).alias("ranks"),
        (out_of(score) + out_of(second)).alias("range"), F.count_if(ok & F.col(second).isNotNull()).alias("twice"),
    )
    twice_seen = records.filter(ok).groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    odd = lambda c: F.size(F.array_except(c, F.array(*map(F.lit, expected[c])))) + F.size(F.array_except(F.array(*map(F.lit, expected[c])), c))
    checks = {
        "rows": F.abs(F.col("n") - expected["rows"]), "arms": odd("arms"), "members": odd("members"), "ranks": odd("ranks"), "range": F.col("range"),
        "secondary_coverage": F.greatest(F.lit(0), F.ceil(F.lit(coverage * expected["rows"])) - F.col("twice")), "repeated_keys": F.col("repeated"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("invariant"), v.cast("long").alias("violations")) for k, v in checks.items()))).alias("x")
    return g.crossJoin(twice_seen).select(rows).select("x.*")  # one row each


def hits_vary(hits: DataFrame, arm: str, question: str, member: str, doc: str) -> DataFrame:
    """Per arm the questions whose members get different hit sets, of all questions with two members or more. An arm that
    doesn't know its member must have none, one that does at least one."""
    sets = hits.groupBy(arm, question, member).agg(F.array_sort(F.collect_set(doc)).alias("s"))
    per = sets.groupBy(arm, question).agg(F.count("*").alias("members"), F.countDistinct("s").alias("sets")).filter("members > 1")
    return per.groupBy(arm).agg(F.count("*").alias("questions"), F.count_if(F.col("sets") > 1).alias("varying"))

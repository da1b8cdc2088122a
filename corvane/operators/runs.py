"""Resumable evaluation runs: expected keys, resuming, resolving attempts, summaries, paired differences and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import guarded_corr


def expected_keys(arms: DataFrame, cases: DataFrame, replicates: int) -> DataFrame:
    """Every replicate of every arm on every case. The arms are a configuration's, a handful of rows."""
    return cases.crossJoin(arms).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def question_persona_cases(questions: DataFrame, personas: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Questions by personas; a limit cuts questions before the product. Personas are a fixed, small table."""
    q = questions.orderBy(order).limit(limit) if limit is not None else questions
    return q.crossJoin(personas)


def pending(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not done yet."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def unexpected(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are done though nobody asked for them."""
    return done.select(*keys).distinct().join(expected, keys, "left_anti")


def key_sets_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys only ``a`` has and only ``b`` has."""
    left, right = a.select(*keys).distinct().withColumn("in_a", F.lit(1)), b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, keys, "full_outer")
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def current_config(records: DataFrame, digest: str, column: str = "config") -> DataFrame:
    """Records of this configuration; count the others with ``stale_count``."""
    return records.filter(F.col(column) == digest)


def stale_count(records: DataFrame, digest: str, column: str = "config") -> DataFrame:
    """How many rows are current and how many stale."""
    fresh = F.col(column).eqNullSafe(digest)
    return records.agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"))


def resolve_attempts(records: DataFrame, keys: list[str], ok: Column, seq: str) -> DataFrame:
    """One record per key: its success, else its last failure. ``successes`` counts the successes of the key, so a caller
    can refuse keys with more than one. Ordering inside a key is by success, then by the latest ``seq``."""
    w = Window.partitionBy(*keys)
    best = w.orderBy(F.desc(ok.cast("int")), F.desc(seq))
    marked = records.withColumn("successes", F.sum(ok.cast("long")).over(w)).withColumn("_n", F.row_number().over(best))
    return marked.filter("_n = 1").drop("_n")


def resolution_errors(expected: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without any record, with several successes, or that nobody expected: keys and ``error``."""
    missing = pending(expected.select(*keys), resolved, keys).withColumn("error", F.lit("missing"))
    twice = resolved.filter("successes > 1").select(*keys).withColumn("error", F.lit("several successes"))
    extra = unexpected(expected.select(*keys), resolved, keys).withColumn("error", F.lit("unexpected"))
    return missing.unionByName(twice).unionByName(extra)


def with_groups(records: DataFrame, bridge: DataFrame, member: str) -> DataFrame:
    """Records once for every overlapping group that their member belongs to; ``bridge`` (label, member) is small."""
    return records.join(bridge.withColumnRenamed("member", member), member)


def summarize(records: DataFrame, by: list[str], score: str) -> DataFrame:
    """Mean, sample deviation (0 for a single value), valid and failed rows per cell; an empty cell's mean is null."""
    valid = F.count(score)
    sd = F.when(valid > 1, F.stddev_samp(score)).when(valid == 1, 0.0)
    return records.groupBy(*by).agg(F.avg(score).alias("mean"), sd.alias("sd"), valid.alias("n_valid"), (F.count("*") - valid).alias("n_failed"))


def paired_deltas(records: DataFrame, arm: str, before: str, after: str, keys: list[str], score: str) -> DataFrame:
    """Differences of keys that both arms scored: keys, ``before``, ``after``, ``delta``. One pass, no self-join."""
    of = lambda a: F.max(F.when(F.col(arm) == a, F.col(score)))
    wide = records.filter(F.col(arm).isin(before, after)).groupBy(*keys).agg(of(before).alias("before"), of(after).alias("after"))
    return wide.filter("before is not null and after is not null").withColumn("delta", F.col("after") - F.col("before"))


def win_tie_loss(deltas: DataFrame, by: list[str], tolerance: float = 0.0) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy(*by).agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"))


def judge_agreement(records: DataFrame, a: str, b: str, arm: str | None = None) -> DataFrame:
    """Exact rate, mean absolute difference and Pearson correlation of two judges, over all arms (null) and per arm. The
    correlation is NaN where either judge is constant."""
    both = records.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    parts = [F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("exact"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"), guarded_corr(a, b).alias("pearson")]
    return both.rollup(arm).agg(*parts) if arm else both.agg(*parts)


def failure_histogram(records: DataFrame, stage: str) -> DataFrame:
    return records.groupBy(F.coalesce(F.col(stage), F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


def best_epoch(epochs: DataFrame, run: str) -> DataFrame:
    """Each run's epoch with the highest recall, then the lowest loss, then the highest reciprocal rank."""
    w = Window.partitionBy(run).orderBy(F.desc("recall"), "val_loss", F.desc("mrr"), "epoch")
    return epochs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def nearest_epoch(log: DataFrame, run: str, epoch: str, target: float, value: str) -> DataFrame:
    """The log entry nearest to an epoch, the earlier one of a tie."""
    return log.groupBy(run).agg(F.min_by(F.struct(epoch, value), F.struct(F.abs(F.col(epoch) - target), F.col(epoch))).alias("e")).select(run, f"e.{epoch}", f"e.{value}")


def alignment_errors(a: DataFrame, b: DataFrame, position: str, member: str) -> DataFrame:
    """One row on two runs that are compared by position: positions that only one has, and positions whose members differ.
    Both must be 0."""
    x, y = a.select(position, F.col(member).alias("_a"), F.lit(True).alias("_x")), b.select(position, F.col(member).alias("_b"), F.lit(True).alias("_y"))
    j = x.join(y, position, "full_outer")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return j.agg(F.count_if(~both).alias("unpaired"), F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("other_member"))


def merge_runs(a: DataFrame, b: DataFrame, arm: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of two runs together, and per arm how many of all keys it lacks (0 for every arm of runs that may be
    merged)."""
    merged = a.unionByName(b)
    every = merged.select(*keys).distinct().agg(F.count("*").alias("_all"))
    per = merged.select(arm, *keys).distinct().groupBy(arm).agg(F.count("*").alias("_n"))
    return merged, per.crossJoin(every).select(arm, (F.col("_all") - F.col("_n")).alias("missing"))  # one row of totals


def displacement(log: DataFrame, by: list[str], rewards: dict[str, str], beta: float) -> DataFrame:
    """Shift of the log probability against the frozen reference in nats: each reward column over ``beta``."""
    return log.select(*by, *((F.col(c) / beta).alias(name) for name, c in rewards.items()))

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import stats
from corvane.operators import contests, runs


def test_agreement_golden(spark):
    rows = [(True, "A")] * 40 + [(True, "B")] * 24 + [(False, "A")] * 10 + [(False, "B")] * 19 + [(None, "A")] * 7
    got = contests.label_agreement(spark.createDataFrame(rows, "agrees boolean, position string"), "agrees", "position").first()
    assert (got.agree, got.disagree, got.tie, got.picked_a, got.picked_b) == (64, 29, 7, 50, 43)
    assert got.rate == pytest.approx(0.6881720430107527, abs=1e-12)
    assert (got.low, got.high) == (pytest.approx(0.5881422410187721, abs=1e-9), pytest.approx(0.7732726881025974, abs=1e-9))
    assert got.p == pytest.approx(0.00036579567696276875, rel=1e-9) and got.position_p == pytest.approx(0.5340598617346067, rel=1e-9)


def test_all_ties(spark):
    got = contests.label_agreement(spark.createDataFrame([(None, "A")], "agrees boolean, position string"), "agrees", "position").first()
    assert math.isnan(got.rate) and math.isnan(got.low) and got.p == 1.0


def test_holm_properties(spark):
    rng = random.Random(1)
    rows = [(f, i, rng.choice([rng.random(), 0.01])) for f in "ab" for i in range(12)]
    out = stats.holm(spark.createDataFrame(rows, "f string, i int, p double"), ["f"], "p", ["i"]).collect()
    for f in "ab":
        part = sorted((r for r in out if r.f == f), key=lambda r: (r.p, r.i))
        assert all(a.p_holm <= b.p_holm for a, b in zip(part, part[1:])) and all(r.p <= r.p_holm <= 1 for r in part)
        assert part[0].p_holm == pytest.approx(min(1, 12 * part[0].p))


def test_exact_tests():
    assert stats.sign_test(0, 0) == 1.0 and stats.sign_test(5, 0) == 2 / 32 and stats.sign_test(3, 3) == 1.0
    assert stats.binomial_two_sided(0, 0) == 1.0 and stats.binomial_two_sided(2, 4) == 1.0


def test_bootstrap_by_agrees_with_plain(spark):
    rng = np.random.default_rng(3)
    d = rng.choice([-1.0, 0.0, 1.0, 2.0], 200)
    got = stats.bootstrap_by(spark.createDataFrame([("x", float(v)) for v in d], "f string, v double"), "f", "v", 4000).first()
    low, high, p = stats.paired_bootstrap(d, 4000)
    assert got["mean"] == pytest.approx(d.mean()) and abs(got.low - low) < 0.03 and abs(got.high - high) < 0.03 and abs(got.p - p) < 0.02
    a, b = stats.bootstrap_mean([1.0, 2.0, 3.0]), stats.bootstrap_mean([1.0, 2.0, 3.0], short=True)
    assert a[0] == b[0] and b[1] <= a[1]


def test_quantile_kinds(spark):
    values = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("one", 7.0)], "g string, v double")
    want = {"h": ("half_even", 0.25), "n": ("nearest_rank", 0.95), "l": ("linear", 0.9), "m": ("linear", 0.5)}
    got = {r.g: r for r in stats.quantiles(df, ["g"], "v", want).collect()}
    s = sorted(values)
    assert got["g"].h == s[round(0.25 * 7)] and got["g"].n == s[math.ceil(0.95 * 8) - 1]
    assert got["g"].l == pytest.approx(np.percentile(s, 90)) and got["g"].m == pytest.approx(np.median(s))
    assert tuple(got["one"])[1:] == (7.0, 7.0, 7.0, 7.0)


def test_bins_flips_and_constants(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (0.9, -1.0, 1.0), (1.0, 2.0, 0.0), (5.0, 3.0, 2.0)], "v double, d double, b double")
    got = df.select(stats.bin_index(F.col("v"), [0.0, 1.0, 2.0]).alias("i"), stats.sign_flip(F.col("d"), F.col("b")).alias("f")).collect()
    assert [r.i for r in got] == [1, 0, 0, 1, 1] and [r.f for r in got] == [True, False, True, True, False]
    flat = df.select("v", F.lit(1.0).alias("c"))
    assert math.isnan(flat.agg(stats.guarded_corr("v", "c").alias("r")).first().r)


def test_resolution(spark):
    rows = [(1, "a", False, 0), (1, "a", True, 1), (2, "a", False, 0), (2, "a", False, 2), (3, "a", True, 0), (3, "a", True, 1), (9, "z", True, 0)]
    r = runs.resolve_attempts(spark.createDataFrame(rows, "k int, arm string, ok boolean, seq int"), ["k", "arm"], F.col("ok"), "seq")
    got = {x.k: (x.ok, x.seq, x.successes) for x in r.collect()}
    assert got == {1: (True, 1, 1), 2: (False, 2, 0), 3: (True, 1, 2), 9: (True, 0, 1)}
    again = runs.resolve_attempts(r.drop("successes"), ["k", "arm"], F.col("ok"), "seq")
    assert again.count() == 4  # idempotent
    expected = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "k int, arm string")
    assert {(x.k, x.error) for x in runs.resolution_errors(expected, r, ["k", "arm"]).collect()} == {(3, "several successes"), (4, "missing"), (9, "unexpected")}


def test_expected_keys_and_summary(spark):
    arms = spark.createDataFrame([(a,) for a in "abcde"], "arm string")
    cases = spark.createDataFrame([(q, p) for q in range(3) for p in range(2)], "q int, p int")
    keys = runs.expected_keys(arms, cases, 2)
    assert keys.count() == keys.distinct().count() == 60
    rec = spark.createDataFrame([("base", 1, 2), ("base", 2, 4), ("new", 1, 3), ("new", 2, 4), ("new", 3, None)], "arm string, k int, s int")
    s = {r.arm: r for r in runs.summarize(rec, ["arm"], "s").collect()}
    assert s["base"]["mean"] == 3.0 and s["new"]["mean"] == 3.5 and s["new"].n_failed == 1
    d = runs.paired_deltas(rec, "arm", "base", "new", ["k"], "s").agg(F.avg("delta").alias("d"), F.count("*").alias("n")).first()
    assert (d.d, d.n) == (0.5, 2)
    one = runs.summarize(spark.createDataFrame([("x", 1)], "arm string, s int"), ["arm"], "s").first()
    assert one.sd == 0.0


def test_orientation_and_margin(spark):
    jobs = spark.createDataFrame([("a", "b", i) for i in range(7)] + [("a", "c", i) for i in range(8)], "l string, r string, i int")
    b = contests.orientation_balance(contests.balanced_orientation(jobs, ["l", "r"], ["i"]), ["l", "r"]).collect()
    assert all(x.balanced for x in b)
    obs = spark.createDataFrame([(1.0, 0.2), (-1.0, 0.2), (1.0, 0.8), (0.0, 0.9)], "d double, b double")
    curve = contests.flip_curve(obs, "d", "b", [0.0, 0.5, 2.0])
    assert {(x.threshold, x.n, x.flips) for x in curve.collect()} == {(0.0, 4, 2), (0.5, 2, 1), (2.0, 0, 0)}
    assert contests.recommended_margin(curve, 1, 0.1).first().threshold is None

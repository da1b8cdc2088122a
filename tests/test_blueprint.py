import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import clients, config, contests, panels, preferences, ranking, relational, retrieval, runs
from corvane.sources import readers


def test_own_pool(spark):
    """Two positives within the tolerance, any of them counts; the group of one is left out."""
    rows = [("g", 1, 0.9, 0.1), ("g", 2, 0.9 - 5e-7, 0.8), ("g", 3, 0.2, 0.9), ("h", 1, 0.0, 0.5), ("h", 2, 0.0, 0.5), ("one", 1, 1.0, 1.0)]
    r = retrieval.own_pool_quality(spark.createDataFrame(rows, "g string, d long, score double, sim double"), ["g"], "d", "score", "sim", 2).first()
    got, ideal = 0.2 + (0.9 - 5e-7) / math.log2(3), 0.9 + (0.9 - 5e-7) / math.log2(3)
    assert (r.groups, r.recall1, r.recall2) == (2, 0.5, 1.0)
    assert r.ndcg2 == pytest.approx((got / ideal + 0.0) / 2)


def test_hit_sets(spark):
    rows = [(q, p, arm, d) for q, p, arm, ds in [("q", "a", "x", "123"), ("q", "b", "x", "321"), ("q", "c", "x", "124"), ("r", "a", "x", "9"), ("q", "a", "y", "234"), ("q", "b", "y", "789")] for d in ds]
    h = spark.createDataFrame(rows, "q string, p string, arm string, d string")
    r = retrieval.hit_overlap(h, ["q", "p"], "arm", "x", "y", "d").first()
    assert r.n == 2 and r.overlap == pytest.approx((2 / 5 + 0) / 2)
    assert {x.arm: x.distinct_sets for x in retrieval.distinct_hit_sets(h, "q", "p", "arm", "d").collect()} == {"x": 1.5, "y": 2.0}


def test_divergence_over_personas(spark):
    rows = [("q", "a", "x y"), ("q", "b", "x y"), ("r", "a", "x y"), ("r", "b", "y z"), ("r", "c", "w"), ("s", "a", "x")]
    df = spark.createDataFrame(rows, "q string, p string, text string")
    r = preferences.rewrite_divergence(df, "q", "p", F.array_distinct(tx.words(F.col("text")))).first()
    assert (r.questions, r.identical) == (2, 1)
    assert r.mean_jaccard == pytest.approx((1 + 1 / 3 + 0 + 0) / 4)


def test_small_ones(spark):
    t = spark.createDataFrame([(t,) for t in ("a ... b", "__", "x____", "so\u2026", "..", "")], "t string")
    assert [r[0] for r in t.select(tx.has_cloze(F.col("t"))).collect()] == [True, False, True, True, False, False]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "v array<double>, b array<double>")
    assert retrieval.anchor_penalty(v, "v", "b").first().penalty == 0.5
    j = contests.alternating_orientation(spark.createDataFrame([(1, i) for i in range(5)] + [(2, 7)], "run long, i long"), ["i"], ["run"])
    assert [r.chosen_is_a for r in j.orderBy("run", "i").collect()] == [True, False, True, False, True, True]


def test_runs_that_are_compared(spark):
    a = spark.createDataFrame([(0, "p"), (1, "q"), (2, "r")], "pos int, persona string")
    b = spark.createDataFrame([(0, "p"), (1, "x"), (3, "r")], "pos int, persona string")
    assert tuple(runs.alignment_errors(a, b, "pos", "persona").first()) == (2, 1) and tuple(runs.alignment_errors(a, a, "pos", "persona").first()) == (0, 0)
    x = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2)], "arm string, k int")
    y = spark.createDataFrame([("B", 2)], "arm string, k int")
    merged, missing = runs.merge_runs(x, y, "arm", ["k"])
    assert merged.count() == 4 and {r.arm: r.missing for r in missing.collect()} == {"A": 0, "B": 1}
    assert tuple(runs.key_sets_equal(x, y, ["k"]).first()) == (1, 0)
    d = runs.displacement(spark.createDataFrame([(1, -0.2, 0.1)], "epoch int, c double, r double"), ["epoch"], {"chosen": "c", "rejected": "r"}, 0.1).first()
    assert d.chosen == pytest.approx(-2) and d.rejected == pytest.approx(1)
    e = spark.createDataFrame([("x", 1, 0.5, 0.2, 0.1), ("x", 2, 0.5, 0.1, 0.1), ("x", 3, 0.4, 0.0, 0.9), ("y", 7, 0.1, 1.0, 0.1)], "run string, epoch int, recall double, val_loss double, mrr double")
    assert {r.run: r.epoch for r in runs.best_epoch(e, "run").collect()} == {"x": 2, "y": 7}
    assert {r.run: (r.epoch, r.recall) for r in runs.nearest_epoch(e, "run", "epoch", 1.5, "recall").collect()} == {"x": (1, 0.5), "y": (7, 0.1)}
    q = spark.createDataFrame([("q2",), ("q1",), ("q3",)], "q string")
    assert {tuple(r) for r in runs.question_persona_cases(q, spark.createDataFrame([("p",), ("r",)], "persona string"), "q", 2).collect()} == {(f"q{i}", p) for i in (1, 2) for p in "pr"}


def test_places_shards_and_splits(spark):
    rows = [(f"k{i:03}", "g" if i % 10 else "h", i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, g string, n int")
    got = ranking.ranks_in_blocks(df, ["g"], F.substring("k", 1, 3), ["k"], "place", "of").collect()
    for g in "gh":
        own = sorted(r.k for r in got if r.g == g)
        assert {r.k: r.place for r in got if r.g == g} == {k: i for i, k in enumerate(own, 1)} and {r.of for r in got if r.g == g} == {len(own)}
    shards = [r.shard for r in ranking.round_robin(df, "k", 7).collect()]
    assert max(shards.count(s) for s in range(7)) - min(shards.count(s) for s in range(7)) <= 1
    b = ranking.length_batches(df, "n", "k", 16).collect()
    order = [r.n for r in sorted(b, key=lambda r: r.place)]
    assert order == sorted(order) and all(sum(r.batch == i for r in b) == 16 for i in range(31))
    t = ranking.token_batches(df.withColumn("n", F.col("n") * 40), "n", "k", 300).collect()
    sizes = {}
    for r in t:
        sizes.setdefault((r["class"], r.batch), []).append(r.n)
    assert all(len(v) == 1 or len(v) * max(v) <= 300 for v in sizes.values())
    ids, fixed = [f"e{i}" for i in range(20)], {"test": ["e3", "e4"]}
    split = ranking.seeded_split(ids, fixed, {"train": 0.7, "val": 0.1, "test": 0.2}, 42)
    assert split[:2] == [("e3", "test"), ("e4", "test")] and sorted(i for i, _ in split) == sorted(ids) and split == ranking.seeded_split(ids[::-1], fixed, {"train": 0.7, "val": 0.1, "test": 0.2}, 42)
    assert [sum(s == n for _, s in split) for n in ("train", "val", "test")] == [12, 1, 7]
    pinned = spark.createDataFrame([("k001", "test")], "k string, split string")
    parts = {r.k: r.split for r in ranking.hash_split(df, "k", pinned, {"train": 0.8, "val": 0.1, "test": 0.1}, 1).collect()}
    assert parts["k001"] == "test" and [sum(v == n for v in parts.values()) for n in ("train", "val", "test")] == [399, 49, 52]
    sample = ranking.sample_keys(df, ["n"], "k", 5, 3).collect()
    assert len({r.n for r in sample}) == 5 == len(sample)


def test_checks_on_rows_and_settings(spark):
    good = [(a, i, f"p{i % 2}", False, 2, 3, i % 2) for a in "xy" for i in range(4)]
    want = {"rows": 8, "arms": ["x", "y"], "members": ["p0", "p1"], "ranks": [0, 1]}
    schema = "arm string, k int, member string, failed boolean, score int, second int, rank int"
    check = lambda rows: {r.invariant: r.violations for r in panels.row_invariants(spark.createDataFrame(rows, schema), ["arm", "k"], "arm", "member", "failed", "score", "second", "rank", want, 0, 4).collect()}
    assert set(check(good).values()) == {0}
    bad = check([*good[:-1], good[0], ("z", 9, "p0", False, 7, None, 0), ("y", 3, "p1", True, None, None, 1)])
    assert bad == {"rows": 1, "arms": 1, "members": 0, "ranks": 0, "range": 1, "secondary_coverage": 0, "repeated_keys": 1}
    s = spark.createDataFrame([("a", 1.0, 0.5), ("a", None, 0.5), ("a", 0.5, 1.0)], "c string, x double, y double")
    r = preferences.average_samples(s, ["c"], {"x": 0.4, "y": 0.6}).first()
    assert r.judge_samples == 2 and r.score == pytest.approx(0.4 * 0.75 + 0.6 * 0.75)
    t = clients.two_judges(spark.createDataFrame([(1, "a", 1, 2), (2, None, 1, 2), (3, "a", None, 2)], "k int, a string, p int, q int"), F.col("p"), F.col("q"), F.col("a"))
    assert {x.k: x.failure_stage for x in t.collect()} == {1: None, 2: "generation", 3: "judge_primary"}
    config.reuse_manifest({"a": 1, "b": 2}, {"a": 1, "b": 3}, ["a"])
    with pytest.raises(config.ConfigErrors, match="b: 2 is not 3"):
        config.reuse_manifest({"a": 1, "b": 2}, {"a": 1, "b": 3}, ["a", "b"])
    assert config.check_pins({"pyspark-not-there": "1"}) == ["pyspark-not-there is absent"]
    a = spark.createDataFrame([('{"base_model_name_or_path": "m"}',), ("{",), ("{}",)], "t string")
    assert [x[0] for x in a.select(readers.adapter_base(F.col("t"))).collect()] == ["m", None, None]
    rows = spark.createDataFrame([(None, None, None)], "query string, persona_id string, document string").selectExpr("query", "persona_id", "document", "cast(null as double) score", "cast(null as array<struct<chunk_id: string, text: string, teacher_score: double>>) docs")
    assert readers.scored_groups(rows, 2).count() == 0
    with pytest.raises(Exception, match="neither format"):
        readers.scored_groups(rows, 2, "error").collect()


def test_time_joins_with_nulls_and_ties(spark):
    left = spark.createDataFrame([(1, "u", "2024-01-02 10:00"), (2, "u", "2024-01-01 00:00"), (3, "w", "2024-01-05 00:00"), (4, None, "2024-01-05 00:00"), (5, "u", None), (5, "u", None), (6, "u", "2024-03-01 00:00")], "i int, u string, t string").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([("u", "2024-01-02 10:00", 7), ("u", "2024-01-02 10:00", 9), ("u", "2024-01-02 11:00", 1), (None, "2024-01-01 00:00", 5), ("u", "2024-01-01 12:00", None)], "u string, t string, v int").withColumn("t", F.to_timestamp("t"))
    got = sorted((r.i, r.v) for r in relational.asof_join(left, right, ["u"], "t", "v", "v").select("i", F.coalesce("v", F.lit(-1)).alias("v")).collect())
    assert got == [(1, 9), (2, -1), (3, -1), (4, -1), (5, -1), (5, -1), (6, 1)]
    spans = spark.createDataFrame([("u", "2024-01-02 09:59", "2024-01-02 10:00", "a"), ("u", "2024-01-02 10:00", "2024-03-02 00:00", "b"), ("u", "2024-01-03 00:00", "2024-01-01 00:00", "c"), (None, "2024-01-01 00:00", "2025-01-01 00:00", "d")], "u string, s string, e string, n string")
    spans = spans.withColumn("s", F.to_timestamp("s")).withColumn("e", F.to_timestamp("e"))
    assert sorted((r.i, r.n) for r in relational.interval_join(left, spans, "u", "t", "s", "e").collect()) == [(1, "a"), (1, "b"), (6, "b")]
    x = relational.sketch(spark.range(50_000).selectExpr("id % 1000 d", "id v"), [], "d", "v").first()
    assert abs(x.distinct - 1000) < 80 and abs(x["median"] - 25_000) < 50

import random

from pyspark.sql import functions as F

from corvane.llm import splits


def union_find(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, *keys in rows:
        if r is None:
            continue
        find(("r", r))
        for i, k in enumerate(keys):
            if k is not None:
                parent[find(("r", r))] = find((i, k))
    groups = {}
    for r in {x[0] for x in rows if x[0] is not None}:
        groups.setdefault(find(("r", r)), []).append(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    rows = [(f"q{rng.randint(0, 300)}", rng.choice([None, f"g{rng.randint(0, 80)}"]), rng.choice([None, f"w{rng.randint(0, 60)}"])) for _ in range(350)]
    rows += [(f"c{i:03}", f"p{i}", f"p{i + 1}") for i in range(60)]  # a chain by way of two key columns never meets
    rows += [(f"d{i:03}", f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(64)]  # a long chain
    rows += [(f"h{i:04}", "hot", None) for i in range(2000)] + [(None, "hot", "w1")] + rows[:20]
    df = spark.createDataFrame(rows, "r string, a string, b string")
    got = {x.r: x.anchor for x in splits.tied_records(df, "r", [F.col("a"), F.col("b")]).collect()}
    assert got == union_find(rows)


def test_codes(spark):
    same = ["g1_0", "G1_0", " g1_0 ", "g​1_0", "g1-0", "g۱_۰", "ｇ1_0", "g1‑0", "g١‐٠"]
    none = ["", "  ", "-", "null", "None", "NULL ", "—", None, "​", "--"]
    df = spark.createDataFrame([(x,) for x in same + none], "v string")
    got = [r.c for r in df.select(splits.code(F.col("v")).alias("c")).collect()]
    assert set(got[: len(same)]) == {"g1-0"} and set(got[len(same) :]) == {None}


def test_balanced_splits(spark):
    rows = [(f"q{i:05}", f"g{i // 3}" if i % 2 else None) for i in range(6000)] + [(f"big{i:04}", "giant") for i in range(2500)]
    df = spark.createDataFrame(rows, "q string, g string").withColumn("split", F.lit("old"))
    got = splits.balanced_splits(df, "q", [F.col("g")], {"train": 0.8, "val": 0.1, "test": 0.1}, lot_items=500).collect()
    assert len(got) == 8500 and len({r.split for r in got if r.q.startswith("big")}) == 1
    by_anchor = {}
    for r in got:
        assert by_anchor.setdefault(r.anchor, r.split) == r.split
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "val", "test")}
    assert all(abs(share[s] - x) < 0.002 for s, x in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_splits_do_not_depend_on_batches_or_order(spark):
    rng = random.Random(4)
    rows = [(f"q{i:04}", f"g{rng.randint(0, 900)}") for i in range(1600)]
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    got = []
    for n, batch in ((1, "10000"), (7, "5")):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        df = spark.createDataFrame(rows, "q string, g string").repartition(n)
        got.append({r.q: r.split for r in splits.balanced_splits(df, "q", [F.col("g")], shares, bins=20, lot_items=60, fan_in=4).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0]) == 1600
    assert all(abs(sum(s == k for s in got[0].values()) / 1600 - x) < 0.01 for k, x in shares.items())


def test_allocation():
    rng = random.Random(2)
    for _ in range(50):
        w = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        got = splits.allocate(w, {"a": 0.8, "b": 0.1, "c": 0.1})
        assert len(got) == len(w) and set(got) <= {"a", "b", "c"}
    w = [40] * 10 + [10] * 40
    got = splits.allocate(w, {"a": 0.8, "b": 0.1, "c": 0.1})
    assert [sum(x for x, s in zip(w, got) if s == k) for k in "abc"] == [640, 80, 80]
    assert splits.allocate([], {"a": 1.0}) == []


def test_empty_and_unkeyed(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("b", None)], "q string, g string")
    assert {tuple(r) for r in splits.tied_records(df, "q", [F.col("g")]).collect()} == {("a", "a"), ("b", "b")}
    none = df.filter("1 = 0")
    assert splits.tied_records(none, "q", [F.col("g")]).count() == 0
    assert splits.balanced_splits(none, "q", [F.col("g")], {"train": 1.0}).count() == 0


def test_largest_differencing_balances():
    rng = random.Random(1)
    weights = [rng.randint(1, 100) for _ in range(200)]
    bins = splits.largest_differencing([[(0, [])] * 4 + [(w, [i])] for i, w in enumerate(weights)])
    assert sorted(i for _, m in bins for i in m) == list(range(200))
    assert bins[-1][0] - bins[0][0] <= 2

import math
import random

from corvane.llm.topn import top_n


def brute(rows, n):
    best = {}
    for g, h, i, s in rows:
        if s is not None and not math.isnan(s) and i is not None:
            k = (g, h, i)
            best[k] = max(best.get(k, -math.inf), s)
    groups = {}
    for (g, h, i), s in best.items():
        groups.setdefault((g, h), []).append((0.0 - s, i))
    return {(*k, i) for k, v in groups.items() for _, i in sorted(v)[:n]}


def test_against_brute_force(spark):
    random.seed(3)
    score = lambda: random.choice([None, math.nan, 0.0, -0.0, 0.5, 0.5, -1.0, math.inf, -math.inf, random.random()])
    rows = [(random.choice(["a", "b", None, ""]), random.choice(["x", "y"]), random.choice([None, "c1", "c2", "é", "z", "c10", "c11", "c12"]), score()) for _ in range(600)]
    rows += [("hot", "x", f"c{i % 900:04}", float(i % 7)) for i in range(3000)] + rows[:50]
    df = spark.createDataFrame(rows, "g string, h string, item string, place double").repartition(7)
    got = top_n(df, ["g", "h"], "item", "place", 3)
    assert {(r.g, r.h, r.item) for r in got.collect()} == brute(rows, 3)


def test_places_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1.0, "i1", 9), ("a", 2.0, "i2", 9), ("a", 2.0, "i0", 9)], "g0 string, s double, i string, p int")
    assert [(r.i, r.place) for r in top_n(df, ["g0"], "i", "s", 5).orderBy("place").collect()] == [("i0", 1), ("i2", 2), ("i1", 3)]
    assert top_n(df.filter("1 = 0"), ["g0"], "i", "s", 5).count() == 0


def test_heaps_are_built_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "i", 1.0)], "g string, i string, s double")
    plan = top_n(df, ["g"], "i", "s", 5)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_top_k" in plan and "Window" not in plan

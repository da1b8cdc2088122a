import math

import numpy as np
import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """300 vectors of three labels: about 100 rows a label, far more than any pool."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(300)]
    d = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, {i: (np.float32(e).astype(float), x) for i, e, x in rows}


def graded(rows, q):
    return {d: ((q * 7919 + d * 104729) % 1001) / 1000.0 for d in rows if d != q and rows[d][1] == rows[q][1]}


def brute_quality(rows, q, k=5, m=3):
    gain = graded(rows, q)
    order = sorted((d for d in rows if d != q), key=lambda d: (-round(float(rows[q][0] @ rows[d][0]), 6), d))
    rank = {d: i for i, d in enumerate(order, 1)}
    ideal = sorted(gain, key=lambda d: (-gain[d], d))
    rel, out = ideal[:m], {}
    for i in range(1, k + 1):
        best = sum(gain[d] / math.log2(j + 1) for j, d in enumerate(ideal[:i], 1))
        out[f"ndcg{i}"] = sum(gain.get(d, 0) / math.log2(rank[d] + 1) for d in order[:i]) / best
        out[f"hit{i}"] = float(any(rank[d] <= i for d in rel))
    return out | {"recall": sum(rank[d] <= k for d in rel) / m, "mrr": max(1 / rank[d] for d in rel), "judged": sum(d in gain for d in order[:k]) / k}


def brute_losses(rows, q):
    gain = graded(rows, q)
    ids = sorted(gain)
    s, g = np.array([rows[q][0] @ rows[d][0] for d in ids]), np.array([gain[d] for d in ids])
    soft = lambda x: x - math.log(np.exp(x).sum())
    p, r = soft(g / 0.25), soft(s / 0.1)
    return -soft(s / 0.05)[0], float((np.exp(p) * (p - r)).sum())


def test_quality_over_all_rows_of_the_label(spark, tables):
    d, rows = tables
    got = {r.query_id: r.asDict() for r in QUERIES["ranking_quality_whole"](spark, d).collect()}
    assert set(got) == {0, 100, 200}
    for q, r in got.items():
        assert {c: v for c, v in r.items() if c != "query_id"} == pytest.approx(brute_quality(rows, q), abs=2e-6)
    means = {r.label: r.asDict() for r in QUERIES["ranking_means_whole"](spark, d).collect()}
    for c in ("ndcg5", "hit5", "recall", "mrr", "judged"):
        assert means[None][c] == pytest.approx(sum(brute_quality(rows, q)[c] for q in got) / 3, abs=2e-5)
        assert {x: means[x][c] for x in (0, 1, 2)} == pytest.approx({q % 3: brute_quality(rows, q)[c] for q in got}, abs=2e-5)


def test_losses_over_all_rows_of_the_label(spark, tables):
    d, rows = tables
    got = QUERIES["training_losses_whole"](spark, d).collect()
    assert {r.query_id for r in got} == {0, 100, 200}
    for r in got:
        assert (r.mnrl, r.kd) == pytest.approx(brute_losses(rows, r.query_id), abs=2e-5)

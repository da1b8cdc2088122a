import random

import numpy as np
import pytest

from corvane.llm.split_text import boundaries, greedy_starts, split_many, split_oversized, successors


def walk(text, limit, overlap):
    """The same cuts one after the other."""
    code = np.frombuffer(text.strip().encode("utf-32-le"), np.uint32)
    end, succ = successors(code, limit, overlap)
    out, p = [], 0
    while p < len(code):
        out.append((p, int(end[p])))
        p = int(succ[p])
    return out


def make(rng, n):
    return "".join(rng.choice(["واژه", "a", "bc", " ", " ", ". ", "\n", "\n\n", "😀", "؟ ", "ک‌ل"]) for _ in range(n))


@pytest.mark.parametrize(("limit", "overlap"), [(800, 150), (40, 10), (10, 0), (9, 3), (100, 49)])
def test_doubling_equals_walking(limit, overlap):
    rng = random.Random(limit)
    texts = [make(rng, rng.randint(0, 900)) for _ in range(40)] + ["", "   ", "x" * 5000, "a" * limit, "a" * (limit + 1)]
    for t, pieces in zip(texts, split_many(texts, limit, overlap)):
        assert [(s, e) for s, e, _ in pieces] == walk(t, limit, overlap)
        bare = t.strip()
        assert all(0 < e - s <= limit and p == bare[s:e] for s, e, p in pieces)
        assert (pieces[0][0] == 0 and pieces[-1][1] == len(bare)) if bare else not pieces
        assert all(b[0] <= a[1] and b[0] > a[0] and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))  # nothing is lost, all advance


def test_overlap_and_boundaries():
    text = " ".join(f"word{i:03}" for i in range(600))
    pieces = next(split_many([text], 800, 150))
    for a, b in zip(pieces, pieces[1:]):
        assert 140 <= a[1] - b[0] <= 160
        assert text[b[0] - 1] == " " and text[a[1] - 1] == " "
    strength = boundaries(np.frombuffer("ab. cd\n\nef g".encode("utf-32-le"), np.uint32))
    assert strength.tolist() == [0, 0, 0, 0, 2, 0, 0, 0, 3, 0, 0, 1, 0]


def test_greedy_starts_needs_logarithmic_rounds():
    n = 1 << 16
    succ = np.minimum(np.arange(n + 1) + 1, n)
    stop = np.zeros(n + 1, bool)
    stop[n] = True
    assert len(greedy_starts(succ, np.array([0]), stop)) == n


def test_rows_nulls_repeats_and_clashes(spark):
    long = "کلمه " * 400
    rows = [("a", long, 1, 5), ("a", long, 1, 5), ("b", None, 2, 5), ("c", " \n ", 3, 5), ("d", "  short \n", None, 5), (None, "x", 1, 5), ("e", "", 1, 5)]
    df = spark.createDataFrame(rows, "k string, t string, piece int, end int")
    got = split_oversized(df, "k", "t").collect()
    assert {r.k for r in got} == {"a", "d", None}
    assert sum(r.k == "a" for r in got) == 3 and max(len(r.piece_text) for r in got) <= 800
    kept = split_oversized(df.withColumnRenamed("piece", "n"), "k", "t", keep=("n",)).collect()
    assert {r.n for r in kept if r.k == "a"} == {1}
    assert split_oversized(df.filter("1 = 0"), "k", "t").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "k", "t", 100, 80)


def test_limit_is_in_code_points(spark):
    df = spark.createDataFrame([("a", "😀" * 800), ("b", "😀" * 801)], "k string, t string")
    got = {r.k: r.pieces for r in split_oversized(df, "k", "t").collect()}
    assert got == {"a": 1, "b": 2}


def test_slices_do_not_change_pieces(spark):
    import pandas as pd

    from corvane.llm import split_text

    b = pd.DataFrame({"t": ["x" * 30, "", "y" * 500, None, "z" * 10, "w" * 10]}, index=[3, 3, 1, 0, 7, 9])
    for most in (1, 40, 10_000):
        got = list(split_text.slices(iter([b, b.iloc[:0]]), most))
        assert pd.concat(got).equals(b) and all(g.t.str.len().sum() < most + 500 or len(g) == 1 for g in got)

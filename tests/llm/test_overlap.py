import itertools
import random

import pytest

from corvane.llm import overlap


def test_reach_is_lossless():
    """Two sets of the required similarity always share two neighbours inside the reach of both, whatever the order."""
    rng = random.Random(6)
    for _ in range(3000):
        common, total = rng.randint(1, 24), 0
        d = rng.randint(0, int(common / 3))
        da = rng.randint(0, d)
        words = rng.sample(range(1000), common + d)
        a = sorted(words[: common + da])
        b = sorted(words[:common] + words[common + da :])
        total = common + d
        if a == b or common < 0.75 * total:
            continue
        pa, pb = overlap.reach(len(a), 0.75), overlap.reach(len(b), 0.75)
        first = set(zip(a[: pa - 1], a[1:pa]))
        assert first & set(zip(b[: pb - 1], b[1:pb])), (a, b)


def brute(rows, share=0.75):
    words = {k: set(overlap.plain_words(t)) for k, _, t, _, _ in rows}
    out = set()
    for (k, r, _, s, _), (k2, r2, _, s2, _) in itertools.product(rows, rows):
        if s == "train" and s2 not in ("train", None) and None not in (k, k2):
            a, b = words[k], words[k2]
            if (r is not None and r == r2) or (a and b and len(a & b) >= share * len(a | b)):
                out.add((k, k2))
    return out


@pytest.fixture
def rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(260):
        if out and rng.random() < 0.5:
            w = out[rng.randrange(len(out))][2].split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    j = rng.randrange(len(w))
                    w[j : j + 1] = rng.choice([[], [rng.choice(vocab)], [w[j], rng.choice(vocab)]])
            rng.shuffle(w) if rng.random() < 0.3 else None
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 14))]
        out.append((i, f"r{rng.randint(0, 200)}", " ".join(w), rng.choice(["train", "train", "val", "test"]), f"s{i % 3}"))
    out += [(1000, None, None, "train", "s"), (1001, None, "", "test", "s"), (1002, "r1", "!!! ...", "val", None)]
    return out


@pytest.mark.parametrize("cell", [2048, 3])
def test_against_brute_force(spark, rows, cell, monkeypatch):
    monkeypatch.setattr(overlap, "CELL", cell)  # with 3, frequent beginnings are cut into grids
    df = spark.createDataFrame(rows + rows[:30], "a long, r string, words string, b string, cls string")
    got = overlap.cross_split_overlaps(df, "a", "r", "words", "b", "cls").collect()
    assert {(x.a, x.b) for x in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_forms_and_empty(spark):
    assert overlap.plain_words("كتاب، می‌رود! كتاب") == overlap.plain_words("«کتاب» میرود")
    rows = [(1, "x", "الف ب پ ت", "train", "s"), (2, "y", "ب الف ﭖ ت!", "val", "s"), (3, None, "الف ب پ ث", "val", "s"), (None, "x", "الف", "val", "s"), (4, "x", "z", None, "s")]
    df = spark.createDataFrame(rows, "k long, r string, t string, s string, o string")
    assert [(x.a, x.b, x.similarity) for x in overlap.cross_split_overlaps(df, "k", "r", "t", "s", "o").collect()] == [(1, 2, 1.0)]
    assert overlap.cross_split_overlaps(df.filter("1 = 0"), "k", "r", "t", "s", "o").count() == 0
    with pytest.raises(ValueError):
        overlap.similar_classes(df, 0.5)


def windows_in_both(a, b):
    """Positions of b in windows of five words, or of all its words if fewer, that a has, by trying all of them."""
    k = max(1, min(overlap.SPAN, len(b)))
    has = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
    return {i + j for i in range(len(b) - k + 1) if tuple(b[i : i + k]) in has for j in range(k)}


def test_suffix_array_and_spans_against_brute_force():
    rng = random.Random(1)
    codes = overlap.np.array([rng.randint(0, 3) for _ in range(300)])
    order, _ = overlap.suffix_array(codes, 300)
    assert order.tolist() == sorted(range(300), key=lambda i: codes[i:].tolist())
    for _ in range(60):
        pairs = []
        for _ in range(rng.randint(0, 20)):
            a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
            b = list(a) if rng.random() < 0.4 else [rng.choice("abc") for _ in range(rng.randint(0, 40))]
            if b and rng.random() < 0.5:
                b[rng.randrange(len(b))] = "z"
            pairs.append((a, b))
        for (a, b), spans in zip(pairs, overlap.shared_spans(pairs), strict=True):
            assert {i for f, t in spans for i in range(f, t)} == windows_in_both(a, b)
            assert all(f < t for f, t in spans) and all(p[1] < q[0] for p, q in zip(spans, spans[1:]))


def test_coverage_of_long_near_copies(spark):
    """Spans count in written order, however long they are."""
    rng = random.Random(3)
    rows, texts = [], []
    for i, n in enumerate([2, 3, 12, 20, 40, 56, 100, 200]):
        w = [f"t{i}x{j}" for j in range(n)]
        near = list(w)
        for j in rng.sample(range(n), n // 9) if n < 200 else [199]:
            near[j] = f"n{i}x{j}"
        texts += [(i, w, "train"), (100 + i, near + [f"e{i}"] * (i % 2 and 3 < n < 200), "val")]
    rows = [(k, f"r{k}", " ".join(w), s, "s") for k, w, s in texts] + [(900, "q", "alone", "train", "s"), (901, "p", "Alone!", "test", "s")]
    df = spark.createDataFrame(rows, "k long, r string, t string, s string, o string")
    got = {(x.a, x.b): x.coverage for x in overlap.cross_split_overlaps(df, "k", "r", "t", "s", "o").collect()}
    text = {k: t.lower().replace("!", "").split() for k, _, t, _, _ in rows}
    assert set(got) == {(i, 100 + i) for i in range(8)} | {(900, 901)}
    assert got == pytest.approx({(a, b): len(windows_in_both(text[a], text[b])) / len(text[b]) for a, b in got})
    assert got[7, 107] == pytest.approx(0.995) and got[900, 901] == 1.0


@pytest.mark.parametrize("batch", [200_000, 30])
def test_report_equals_the_pairs(spark, rows, batch, monkeypatch):
    monkeypatch.setattr(overlap, "BATCH_WORDS", batch)
    df = spark.createDataFrame(rows + rows[:30], "a long, r string, words string, b string, cls string")
    pairs = overlap.cross_split_overlaps(df, "a", "r", "words", "b", "cls").collect()
    assert {(p.a, p.b) for p in overlap.overlap_pairs(df, "a", "r", "words", "b", "cls").collect()} == {(p.a, p.b) for p in pairs}
    text = {k: (t or "").split() for k, _, t, _, _ in rows}
    want, covered = {}, {}
    for p in pairs:
        w = want.setdefault((p.eval_split, p.eval_source), [0, set(), 0, 0])
        w[0] += 1
        w[1].add(p.b)
        w[2] += p.same_ref
        w[3] += p.similarity is not None
        if p.similarity is not None:
            covered.setdefault((p.eval_split, p.eval_source), {}).setdefault(p.b, set()).update(windows_in_both(text[p.a], text[p.b]))
    got = {(r.eval_split, r.eval_source): r for r in overlap.overlap_report(df, "a", "r", "words", "b", "cls").collect()}
    assert {k: [r.pairs, r.eval_records, r.same_question, r.similar_query] for k, r in got.items()} == {k: [w[0], len(w[1]), w[2], w[3]] for k, w in want.items()}
    for k, r in got.items():
        shares = [len(c) / len(text[b]) for b, c in covered.get(k, {}).items()]
        assert r.mean_coverage == (pytest.approx(sum(shares) / len(shares)) if shares else None)
        assert r.least_coverage == (pytest.approx(min(shares)) if shares else None)
    assert overlap.overlap_report(df.filter("1 = 0"), "a", "r", "words", "b", "cls").count() == 0

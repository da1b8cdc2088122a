import random

import pytest

from corvane.llm import lookalike as L

SAME = [
    ("می‌رود", "می‌‌رود"),  # a doubled non-joiner
    ("دارد باد", "دارد‌ باد"),  # behind a letter that doesn't join
    ("یاد", "ياد"), ("خوبی", "خوبى"), ("کتاب", "كتاب"), ("\u0622ب", "\u0627\u0653ب"), ("ۀ", "هٔ"), ("لا", "ﻻ"), ("۱۲۳", "١٢٣"),
    ("(a)", "（ａ）"), ("a b", "a b"), ("a b", "a b"), ("ab", "a­b"), ("ab", "﻿a⁠b"), ("Compare", "Cоmparе"), (" a ", "a"), ("\u00e9", "e\u0301"),
]
DIFFERENT = [("می‌رود", "میرود"), ("خوبی", "خوبي"), ("یاد", "ىاد"), ("پر", "بر"), ("زر", "زـر"), ("دقت", "دقّت"), ("۴", "٤"), ("a  b", "a b"), ("a\nb", "a b"), ("تک", "تك")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    c = L.Canonical(["کتاب", "آب"])
    assert a != b and c(a) == c(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_other_look(a, b):
    c = L.Canonical([])
    assert c(a) != c(b)


def test_table_is_idempotent_and_clean_texts_are_fixed():
    random.seed(1)
    alphabet = "ابپتجدرزسکگلمنوهیيىكءآؤئأّٔ‌ـ .،​­aо۱١" + "ﻻ（"
    for _ in range(3000):
        s = "".join(random.choice(alphabet) for _ in range(random.randint(0, 12)))
        once = L.table_form(s)
        assert L.table_form(once) == once


def test_the_trie_decides_vocabulary_words():
    """Raw tokens reach their spelling without the table, and only those that have that table form."""
    rng = random.Random(5)
    alphabet = "ابپتجدرزسکگلمنوهیيىكءآؤئأّٔەۀ" + "\u200c\u200c\u200cـ.\u200b\u00ada\u043e۱١" + "ﻻ（َ\u00e9e\u0301\u0451\u0435"
    draw = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))
    words = {f for f in (L.table_form(draw()) for _ in range(8000)) if f}
    canonical = L.Canonical(sorted(words), table=lambda t: None)  # without a table
    hits = 0
    for _ in range(20000):
        t = draw()
        form = L.table_form(t)
        hit = canonical.trie.search(t)
        assert (hit == (form, 0)) if form in words else (hit is None), ascii(t)
        hits += hit is not None and t != form
    assert hits > 1000
    for a, b in SAME:  # pairs are found without the table if their words are in the vocabulary
        c = L.Canonical(L.table_form(b).split() + L.table_form(a).split(), table=lambda t: "no table: " + t)
        assert c(a) == c(b)


def test_edits_against_distances():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 5))) for _ in range(40)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    trie = L.VocabularyTrie(words)
    for _ in range(60):
        t = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 5)))
        d, w = min((distance(t, w), w) for w in words)
        for limit in (0, 1, 2):
            assert trie.search(t, limit) == ((w, d) if d <= limit else None)


def test_trie_is_a_weighted_automaton():
    t = L.VocabularyTrie(["کتاب", "کباب", "آب"])
    assert t.search("كتاب") == ("کتاب", 0)
    assert t.search("کتـاب") is None
    assert t.search("کتـاب", 1) == ("کتاب", 1)
    assert t.search("كـاب", 1) == ("کباب", 1)  # of equal costs the smaller spelling
    assert t.search("", 1) is None


def test_memory_is_bounded():
    c = L.Canonical(["کتاب"], keep=3)
    assert [c(t) for t in ("كتاب a b c d", "كتاب e", "x" * 500)] == ["کتاب a b c d", "کتاب e", "x" * 500]
    assert len(c) == 3


def test_clean_rows_keep_their_text(spark):
    rows = [(i, a) for i, pair in enumerate(SAME + DIFFERENT) for a in pair]
    df = spark.createDataFrame(rows, "id int, t string")
    c = L.Canonical([])
    got = L.canonical_text(df, "t", "f", []).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.f == c(r.t), r.t


def test_pairs_nulls_copies_and_clashes(spark):
    rows = [("q1", "کتاب ما", 1), ("q2", "كتاب ما", 2), ("q3", "كتاب ما", 3), ("q1", "کتاب ما", 9), ("q4", None, 1), ("q5", "", 1), ("q6", "کتـاب ما", 1), (None, "كتاب ما", 1)]
    df = spark.createDataFrame(rows, "k string, t string, g int")
    got = {tuple(r) for r in L.same_look_pairs(df, "k", "t", []).collect()}
    assert got == {("q1", "q2"), ("q1", "q3")}
    src = spark.createDataFrame([("c1", "کتاب"), ("c1", "کتاب"), ("c2", None)], "r string, text string")
    hits = spark.createDataFrame([("h1", "c1", "كتاب"), ("h2", "c1", "کتاب"), ("h1", "c1", "كتاب"), ("h3", "c2", "x"), ("h4", "c9", "x"), ("h5", "c1", None)], "h string, r string, text string")
    assert {tuple(r) for r in L.same_look_as_source(hits, "h", "r", "text", src, []).collect()} == {("c1", "h1")}
    empty = df.filter("1 = 0")
    assert L.same_look_pairs(empty, "k", "t", []).count() == 0
    assert L.vocabulary([(empty, "t")]) == []


def test_vocabulary_counts_all_rows_and_is_bounded(spark):
    df = spark.createDataFrame([("b a a",), ("a b c",), (None,), ("كتاب",)], "t string")
    assert L.vocabulary([(df, "t")], 2) == ["a", "b"]
    assert "كتاب" not in L.vocabulary([(df, "t")])


def test_very_long_text():
    c = L.Canonical([])
    assert c("كتاب " * 200_000) == ("کتاب " * 200_000).strip()


def test_copies_do_not_meet(spark):
    """400 copies of one text and one variant: two pairs of spellings, 400 pairs of keys."""
    from corvane.llm import lookalike

    part = spark.createDataFrame([("g", i, "x") for i in range(400)] + [("g", 400, "y")], "g string, k long, h string")
    assert lookalike.different_spellings(part).count() == 2
    df = spark.createDataFrame([(i, "كتاب") for i in range(400)] + [(400, "کتاب")], "k long, t string")
    got = lookalike.same_look_pairs(df, "k", "t", ["کتاب"]).collect()
    assert sorted((r.key_a, r.key_b) for r in got) == [(i, 400) for i in range(400)]


def test_long_spellings_take_little_memory():
    """Tokens of thousands of characters, alike in the beginning or not: the trie takes some bytes a character."""
    import tracemalloc

    rng = random.Random(3)
    words = ["".join(rng.choice("ابپتجدرزسکگلمنوه") for _ in range(2000)) for _ in range(100)]
    words += [words[0][:1000] + w for w in words[:20]]
    tracemalloc.start()
    try:
        c = L.Canonical(words, table=lambda t: None)
        assert all(c.trie.search(w.replace("ک", "ك") + "​") == (w, 0) for w in words if w[-1] != "ک")
        assert c.trie.search(words[0][:-1]) is None and c.trie.search(words[0] + "ا") is None
        assert tracemalloc.get_traced_memory()[1] < 10e6
    finally:
        tracemalloc.stop()


def test_texts_are_walked_once(spark, monkeypatch):
    """However the pairs are joined, the forms come from one pass over the texts."""
    calls = []
    real = L.materialize
    monkeypatch.setattr(L, "materialize", lambda df: calls.append(df.columns) or real(df))
    df = spark.createDataFrame([("a", "كتاب"), ("b", "کتاب"), ("c", "ما")], "k string, t string")
    pairs = L.same_look_pairs(df, "k", "t", ["کتاب"])
    assert calls == [["k", "g", "h"]] and "ArrowEvalPython" not in pairs._jdf.queryExecution().toString()
    assert [tuple(r) for r in pairs.collect()] == [("a", "b")]

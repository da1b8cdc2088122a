import os
import random

import pytest

from corvane.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def test_counts_equal_whole_encoding():
    c = tokens.Counter(tokens.VOCABULARY)
    rng = random.Random(2)
    parts = ["متن", " ", "  ", "\n", "\n\n", "don't", "I'll", "12", "،", "...", "‌", "می‌شود", "😀", "\t", " ", "'s", "Ünïcode", "<|endoftext|>"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert c.count(t) == len(c.encoding.encode_ordinary(t)), repr(t)
    assert c.count(None) == c.count("") == 0


def test_pieces_cover_text():
    c = tokens.Counter(tokens.VOCABULARY)
    for t in ("یک دو سه " * 500, "x" * 3000, "a b\n" * 100 + "ک" * 999):
        cuts = c.pieces(t, 50)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        assert all(0 < n <= 50 for _, _, n in cuts)


def test_best_fit():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 700) for _ in range(2000)), reverse=True)
    where, held, caps = packing.best_fit(sizes, [256, 512, 1024])
    again = [0] * len(held)
    for s, b in zip(sizes, where):
        again[b] += s
    assert again == held and all(h <= c for h, c in zip(held, caps))
    assert sum(sizes) / sum(caps) > 0.97
    assert packing.best_fit([5], [8, 16])[2] == [8]  # downsized
    assert packing.best_fit([], [8]) == ([], [], [])


def test_fill_containers(spark):
    rows = [(i, "واژه " * (i % 40 + 1), i) for i in range(300)] + [(1, "واژه " * 2, 1), (900, None, 1), (901, "", 1), (902, "متن " * 3000, 1), (903, "   ", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "k long, t string, tokens long")
    got = packing.fill_containers(df, "k", "t", 256, (64, 128, 256), block_items=100).collect()
    one = {r.k for r in got}
    assert one == {k for k, _, _ in rows if k is not None}
    assert all(r.container is None for r in got if r.k in (900, 901)) and sum(r.k == 1 for r in got) == 1
    big = sorted((r.piece, r.start, r.end) for r in got if r.k == 902)
    assert len(big) > 5 and big[0][1] == 0 and big[-1][2] == 12000
    assert all(r.pieces == 1 for r in got if r.k != 902)
    load, size = {}, {}
    for r in got:
        if r.container is not None:
            load[r.container] = load.get(r.container, 0) + r.tokens
            size[r.container] = r.container_length
    assert all(load[c] <= size[c] <= 256 for c in load)
    assert sum(load.values()) / sum(size.values()) > 0.9
    assert packing.fill_containers(df.filter("1 = 0"), "k", "t").count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(df, "k", "t", 100, (200,))


def test_mix(spark):
    text = "یک متن کوتاه "
    rows = [(i, text, "big") for i in range(600)] + [(1000 + i, text, "Small_One") for i in range(40)] + [(2000 + i, text, "small one\t") for i in range(20)] + [(3000 + i, text, "tiny") for i in range(5)]
    rows += [(4000, None, "big"), (4001, text, None), (4002, text, "untargeted"), (4003, "", "tiny"), (4004, text, " - ")]
    df = spark.createDataFrame(rows, "id long, text string, source string").withColumnRenamed("id", "tokens")
    targets = spark.createDataFrame([("big", 0.5, 3), ("small-one", 0.4, 9), ("tiny", 0.1, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix_sources(df, "tokens", "text", "source", targets)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small-one", "tiny", "absent"}
    assert r["tiny"].capped and not r["big"].capped and not r["small-one"].capped
    m = mixed.collect()
    used = {}
    for x in mixed.toDF("id", "source", "n", "copies").collect():
        used.setdefault(x.source, []).append(x.copies)
    assert set(used["tiny"]) == {2} and len(used["tiny"]) == 5
    assert max(used["big"]) - min(used["big"]) <= 1 and max(used["small-one"]) <= 9
    total = 666 * 1.0
    assert abs(sum(map(sum, used.values())) - total) < 4
    # what tiny lacks goes to the others in proportion
    assert abs(r["big"].actual_share / r["small-one"].actual_share - 1.25) < 0.05
    again = mixing.mix_sources(df, "tokens", "text", "source", targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, m))
    none = mixing.mix_sources(df.filter("1 = 0"), "tokens", "text", "source", targets)
    assert none[0].count() == 0 and {x.actual_share for x in none[1].collect()} == {0.0}

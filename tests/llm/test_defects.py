import random

import numpy as np
import pytest

from corvane.llm import defects

NOUN = "باران خانه مدرسه کتاب دیوار پنجره چراغ کوچه نامه سفر رود جنگل شهر مادر پدر دوست ستاره آسمان برگ باغ".split()
VERB = "می‌بیند می‌خواند می‌شنود می‌سازد می‌آورد می‌برد می‌گوید می‌ستاید".split()
LEFT = "هر شاعر وقتی راوی گاهی در پایان داستان".split()


def sentence(rng):
    return f"{rng.choice(LEFT)} {rng.choice(NOUN)} را کنار {rng.choice(NOUN)} دلنشین {rng.choice(VERB)}"


def table(n=900, seed=7):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        q = "معنی عبارت زیر را بنویسید: " + sentence(rng) + " و " + sentence(rng)
        a = ". ".join(sentence(rng) for _ in range(rng.randint(1, 3))) + rng.choice([".", ".", ""])
        kind = rng.choice([None] * 14 + list(defects.DEFECTS))
        if kind == "empty":
            a = rng.choice([None, "", "  ", "-", "null", "N/A", "...", "​", "(بدون پاسخ)"])
        elif kind == "refusal":
            a = rng.choice(["متأسفانه نمی‌توانم به این پرسش پاسخ بدهم.", "از ارائۀ پاسخ معذورم", "این کار از توان من بیرون است. اگر موضوع دیگری هست در خدمتم.", "اجازه ندارم در این باره چیزی بنویسم."])
        elif kind == "copy":
            a = rng.choice([q, q + "؟", "سؤال: " + q, q + "\n" + q])
        elif kind == "other_language":
            a = rng.choice(["The poet says that the rain and the house were never quiet.", "قال الراوي إن المطر يعود إلى المدينة بعد أن رأى القمر.", "Şair bu derste eski bir yol olduğunu söylüyor ve onu kimse görmüyor."])
        elif kind == "truncated":
            whole = ". ".join(sentence(rng) for _ in range(2))
            a = rng.choice([whole.rsplit(" ", 2)[0] + " و", whole.rsplit(" ", 1)[0] + "،", whole + ". نشانه‌ی آن (" + rng.choice(NOUN) + " که", whole + ". ۲)", whole.rsplit(" ", 1)[0] + " " + rng.choice(NOUN)[:2] + "ژ"])
        rows.append((i, q, a, sentence(rng) + "."))
        if kind:
            truth[(i, "chosen")] = kind
    return rows, truth


def test_planted_defects_at_the_validated_cutoffs(spark):
    rows, truth = table()
    df = spark.createDataFrame(rows + rows[:40], "pair_id long, query string, chosen string, rejected string")
    out = defects.label_defects(df).collect()
    assert len(out) == 2 * len(rows)
    found = {(r.pair_id, r.side): r.defect for r in out if r.defect}
    for d in defects.DEFECTS:
        want, got = {k for k, v in truth.items() if v == d}, {k for k, v in found.items() if v == d}
        assert len(want & got) >= 0.9 * len(want), d
        assert len(got - want) <= 0.1 * len(got) + 1, d
    assert all(set(r.defects) <= set(defects.DEFECTS) for r in out)


def test_edges(spark):
    rows = [(1, None, "پاسخ درست این است.", None), (2, "", "", "متن " * 30_000 + "."), (3, "چه؟", "نه", "بله"), (None, "x", "y", "z"), (1, None, "پاسخ درست این است.", None)]
    df = spark.createDataFrame(rows, "pair_id long, query string, chosen string, rejected string")
    got = {(r.pair_id, r.side): r.defect for r in defects.label_defects(df).collect()}
    assert len(got) == 6 and got[(1, "rejected")] == got[(2, "chosen")] == "empty" and got[(1, "chosen")] is None
    assert defects.label_defects(df.filter("1 = 0")).count() == 0


def test_votes_know_no_lengths(spark):
    """A refusal stays one however long it is, and word statistics come in behind the votes."""
    rows, _ = table(400)
    long = "متأسفانه نمی‌توانم به این پرسش پاسخ بدهم. " + "لطفاً موضوع دیگری را مطرح کنید و اگر پرسش دیگری هست در خدمتم. " * 12
    df = spark.createDataFrame([*rows, (9999, rows[0][1], long, rows[0][3])], "pair_id long, query string, chosen string, rejected string")
    assert {(r.side, r.defect) for r in defects.label_defects(df).filter("pair_id = 9999").collect()} == {("chosen", "refusal"), ("rejected", None)}


def test_cutoffs_part_planted_from_plain():
    assert defects.best_cutoff([0.9, 0.8, 0.99], [0.0, 0.1, 0.02]) == 0.5
    assert defects.best_cutoff([0.3, 0.35, 0.9], [0.0, 0.1, 0.2]) == 0.3
    assert defects.best_cutoff([0.9, 0.97], [0.0, 0.6, 0.7]) == 0.75
    assert defects.best_cutoff([], [0.1]) == 0.5
    assert defects.measured(["+-", "+0", "++"], [("a", 0.5, 0.5), ("b", 0.0, 0.0)], 1.0) == [("a", 3.5 / 4, 0.5 / 4), ("b", 0.25, 0.25)]
    made = defects.plant([("چه شد؟", "یک دو سه چهار پنج شش هفت هشت نه ده."), (None, None)], random.Random(1))
    assert [d for d, _, _ in made] == ["", "copy", "refusal", "empty", "other_language", "truncated", "", "refusal", "empty", "other_language"]


def test_fit_depends_on_proportions_only():
    patterns, counts = [(1, 1), (-1, -1), (0, -1), (1, -1)], [30, 900, 60, 10]
    f = [("a", 0.9, 0.05), ("b", 0.9, 0.05)]
    a, b = defects.fit(patterns, counts, f), defects.fit(patterns, [100 * c for c in counts], f)
    assert np.allclose(a, b) and a[0] > 0.9 and a[1] == a[2] == 0
    assert defects.fit([(-1, -1)], [5], f).tolist() == [0.0]


@pytest.mark.parametrize("text", ["پهلوان گفت: «نمی‌توانم بمانم» و رفت.", "درویش از پاسخ معذور بود؛ باران آمد.", "شاعر از شب پوزش می‌خواهد، زیرا باران آمد و خانه را برد."])
def test_reported_refusals_are_none(spark, text):
    rows, _ = table(300)
    df = spark.createDataFrame([*rows, (9999, rows[0][1], text, text)], "pair_id long, query string, chosen string, rejected string")
    assert {r.defect for r in defects.label_defects(df).filter("pair_id = 9999").collect()} == {None}


def test_rates_and_cutoffs_come_from_all_rows(spark, monkeypatch):
    """Each defect is planted into every answer, and every answer as it is counts for the cutoffs."""
    rows, _ = table(450)
    seen = {"rates": [], "planted": [], "plain": []}
    measured, best_cutoff = defects.measured, defects.best_cutoff
    size = lambda x: sum(x.values()) if isinstance(x, dict) else len(x)
    monkeypatch.setattr(defects, "measured", lambda p, first: seen["rates"].append(size(p)) or measured(p, first))
    monkeypatch.setattr(defects, "best_cutoff", lambda a, b: seen["planted"].append(size(a)) or seen["plain"].append(size(b)) or best_cutoff(a, b))
    defects.label_defects(spark.createDataFrame(rows, "pair_id long, query string, chosen string, rejected string"))
    both = dict(zip(defects.DEFECTS, map(sum, zip(seen["rates"], seen["planted"]))))
    long = sum(len((a or "").split()) >= 8 for r in rows for a in r[2:])
    assert both == dict.fromkeys(defects.DEFECTS, 900) | {"truncated": long}
    assert seen["plain"] == [900] * 5


def test_planted_rows_are_voted_on_like_others():
    rows, _ = table(60)
    tagger = defects.Tagger(defects.LANGUAGE_MODEL)
    query, answer, seeds = [r[1] for r in rows] + [None, ""], [r[2] for r in rows] + [None, "نه"], list(range(-30, 32))
    counted, cut = defects.planted_votes(query, answer, seeds, tagger, tagger.segments(query)[1])
    want, ends = {}, []
    for q, a, seed in zip(query, answer, seeds):
        for d, _, text in defects.plant([(q, a)], random.Random(seed)):
            read = defects.read_tokens(text or "")
            said = {k: v[0] for k, v in defects.votes([q], [text], tagger, [read], tagger.segments([q])[1]).items()}
            if d == "truncated":
                ends.append((f"{d}/{seed & 1}", *defects.last_two(read), said[d], said["ends"]))
            elif d:
                want[f"{d}/{seed & 1}", said[d]] = want.get((f"{d}/{seed & 1}", said[d]), 0) + 1
    assert counted == want and cut == ends

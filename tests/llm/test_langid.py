import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import langid

TEXTS = {
    "fa": "در این درس شاعر از باران سخن می‌گوید و هر خانه را که می‌بیند با دقت نشان می‌دهد.",
    "ar": "قال الشاعر إن المطر يعود إلى المدينة بعد أن رأى القمر في هذا الدرس وكان النهر قديما.",
    "ur": "شاعر کہتا ہے کہ بارش اور گھر کے درمیان ایک پرانا راستہ ہے جو ہم نے پڑھا نہیں تھا۔",
    "en": "The poet says that the rain and the old house were never far from the quiet river in this lesson.",
    "tr": "Şair bu derste yağmur ile evin arasında eski bir yol olduğunu ve onu kimsenin görmediğini söylüyor.",
    "fr": "Le poète dit que la pluie et la vieille maison ne sont jamais loin de la rivière dans cette leçon.",
}


@pytest.fixture(scope="module")
def model():
    return langid.Model({})


def test_code_book():
    book = langid.code_book()
    assert book.shape == (6, 31)
    assert all((book[i] != book[j]).sum() == 16 for i in range(6) for j in range(i))  # equally far apart


def test_seeds_alone_tell_languages(model):
    main = langid.Tagger(model).segments([t for t in TEXTS.values()])[1]
    assert [langid.LANGUAGES[m] for m in main] == list(TEXTS)


def test_mixed_quotations_and_edges(model):
    t = langid.Tagger(model)
    mixed = (TEXTS["fa"] + " ") * 2 + "| " + (TEXTS["en"] + " ") * 2
    quote = (TEXTS["fa"] + " ") * 2 + "«The quiet river» " + (TEXTS["fa"] + " ") * 2
    runs, main = t.segments([mixed, quote, None, "", " \n", "۱۲ 34 !", "x" * 10, mixed * 300])
    found = {d: {langid.LANGUAGES[x] for x, s in zip(runs[3][runs[0] == d], runs[5][runs[0] == d]) if s >= 100} for d in range(8)}
    assert found[0] == {"fa", "en"} == found[7] and found[1] == {"fa"} and main[2:6] == [None] * 4
    empty = t.segments([None, ""])
    assert empty[1] == [None, None] and len(empty[0][0]) == 0


def test_labels(spark):
    names = {"fa-IR": "fa", " Persian ": "fa", "FAS": "fa", "en_GB": "en", "English": "en", "tr-TR": "tr", "und": None, "mul": None, "": None, "??": None, "de": None, "فارسی": "fa"}
    df = spark.createDataFrame([(k,) for k in names], "l string")
    assert [r.x for r in df.select(langid.label_language(F.col("l")).alias("x")).collect()] == list(names.values())


def test_rows(spark, model):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())]
    rows += [(10, TEXTS["fa"], "en"), (11, TEXTS["fa"], None), (12, None, None), (13, "123", None), (14, TEXTS["tr"] + " " + TEXTS["tr"] + "\n\n" + TEXTS["ar"] + " " + TEXTS["ar"], "tr-TR"), (10, TEXTS["fa"], "en")]
    df = spark.createDataFrame(rows, "l long, t string, k string")
    got = {tuple(r) for r in langid.mislabelled(df, "l", "t", "k", model).collect()}
    assert got == {(10, "fa"), (11, "fa"), (14, "tr"), (14, "ar")}
    full = langid.languages(df, "l", "t", model).collect()
    assert sum(r.segment is None for r in full) == 10 and all(0 < r.confidence <= 1 for r in full)
    assert {r.segment for r in full if r.l == 14} == {None, 0, 1}
    assert langid.languages(df.filter("1 = 0"), "l", "t", model).count() == 0


def test_training_on_a_bounded_noisy_sample(spark):
    rng = random.Random(9)
    rows = []
    for lang, t in TEXTS.items():
        words = t.split()
        for _ in range(60):
            rows.append((" ".join(rng.choice(words) for _ in range(30)), lang if rng.random() > 0.1 else rng.choice(langid.LANGUAGES)))
    train, held = rows[::2], rows[1::2]
    m = langid.train(spark.createDataFrame(train, "t string, l string"), "t", "l", rows_per_language=40)
    truth = [lang for lang in TEXTS for _ in range(60)][1::2]
    main = langid.Tagger(m).segments([t for t, _ in held])[1]
    assert sum(langid.LANGUAGES[a] == b for a, b in zip(main, truth)) / len(truth) > 0.97


def test_passages_come_from_the_whole_text(spark):
    from pyspark.sql import functions as F

    from corvane.llm import langid

    long = "".join(f"{i:05}," for i in range(10_000))
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "")], "k int, t string")
    got = {r.k: r.p for r in df.select("k", langid.passages(F.col("t"), 800).alias("p")).collect()}
    assert got[2] == "short" and got[3] is None and got[4] == ""
    parts = got[1].split("\n")
    assert len(parts) == 8 and all(len(p) == 100 and p in long for p in parts) and long.startswith(parts[0]) and long.endswith(parts[-1])

"""Parsers of judges' replies and validators of references and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, words

# The judge's fields with the greatest score of each.
JUDGE_FIELDS = {"context_utility": 4, "answer_correctness": 1, "faithfulness": 4, "persona_alignment": 4, "pedagogical_quality": 4}


def strict_unit_score(reply: Column) -> Column:
    """A number from 0 to 1 that is the whole reply, else null."""
    t = strip(reply)
    return F.when(t.rlike(r"^(?:0(?:\.\d+)?|1(?:\.0+)?)$"), t.try_cast("double"))


def lenient_unit_score(reply: Column) -> Column:
    """The first number of a reply, clamped to [0, 1]; 0 if there is none."""
    number = F.regexp_extract(reply, r"([\d.]+)", 1).try_cast("double")
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)), F.lit(0.0))


def batched_scores(reply: Column, n: Column) -> Column:
    """Exactly ``n`` scores: those of a JSON field ``scores``, else all numbers of the reply; cut or filled up with 0."""
    listed = F.from_json(reply, "scores array<double>")["scores"]
    loose = F.transform(F.regexp_extract_all(reply, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    got = F.transform(F.coalesce(listed, loose, F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    return F.slice(F.concat(got, F.array_repeat(F.lit(0.0), n)), F.lit(1), n)


def ten_point_score(reply: Column) -> Column:
    """The first token that is a number from 1 to 10, else null."""
    numbers = F.transform(words(reply), lambda w: w.try_cast("double"))
    return F.get(F.filter(numbers, lambda x: (x >= 1) & (x <= 10)), F.lit(0))


def rubric_scores(reply: Column, criteria: list[str]) -> Column:
    """A map of criteria to numbers from 0 to 1; null if any is absent, no number or out of range. Other keys are ignored."""
    v = F.try_parse_json(reply)
    values = [F.try_variant_get(v, f"$.{c}", "double") for c in criteria]
    kinds = [F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) for c in criteria]
    fine = F.lit(True)
    for x, k in zip(values, kinds):
        fine = fine & F.coalesce((k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & (x >= 0) & (x <= 1), F.lit(False))
    return F.when(fine, F.create_map(*[y for c, x in zip(criteria, values) for y in (F.lit(c), x)]))


def judge_scores(reply: Column, fields: dict[str, int] = JUDGE_FIELDS) -> Column:
    """The judge's five whole numbers as a struct; null unless the reply is an object of exactly these keys, each a JSON
    integer (true and 3.0 are none) from 0 to its greatest score. Code fences are not stripped."""
    keys = F.json_object_keys(reply)
    v = F.try_parse_json(reply)
    fine = F.coalesce(F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(fields)]), F.lit(False))
    out = []
    for name, most in fields.items():
        x = F.try_variant_get(v, f"$.{name}", "int")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        fine = fine & F.coalesce((kind == "BIGINT") & (x >= 0) & (x <= most), F.lit(False))
        out.append(x.alias(name))
    return F.when(fine, F.struct(*out))


def verdict(reply: Column) -> Column:
    """A, B or TIE of a pairwise judge; null unless an object of exactly winner and reason with a reason that isn't blank."""
    bare = F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", "")
    x = F.from_json(bare, "winner string, reason string")
    keys = F.array_sort(F.json_object_keys(bare))
    fine = F.coalesce((keys == F.array(F.lit("reason"), F.lit("winner"))) & x["winner"].isin("A", "B", "TIE") & (strip(x["reason"]) != ""), F.lit(False))
    return F.when(fine, x["winner"])


def reference(ref: Column) -> tuple[Column, Column]:
    """Both halves of ``exam:id``, split at the first colon; null if either is empty."""
    parts = F.split(ref, ":", 2)
    exam, qid = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    fine = (exam != "") & (qid != "")
    return F.when(fine, exam), F.when(fine, qid)


def retryable(status: Column) -> Column:
    """Whether a call that failed with this HTTP status may be tried again: without a status, on 408, 429 and from 500 on."""
    return status.isNull() | status.isin(408, 429) | (status >= 500)


def lesson_id(heading: Column) -> Column:
    """``lesson-NN`` from Persian digits or an ordinal word behind the word for lesson; null if there is neither."""
    from .text import fold_digits

    # Ordinal words from one to seventeen; the first has two forms.
    ordinals = {"یکم": 1, "اول": 1, "دوم": 2, "سوم": 3, "چهارم": 4, "پنجم": 5, "ششم": 6, "هفتم": 7, "هشتم": 8, "نهم": 9, "دهم": 10, "یازدهم": 11, "دوازدهم": 12, "سیزدهم": 13, "چهاردهم": 14, "پانزدهم": 15, "شانزدهم": 16, "هفدهم": 17}
    digits = F.regexp_extract(fold_digits(F.regexp_extract(heading, r"درس\s+([۰-۹]+)", 1)), r"(\d+)", 1).try_cast("int")
    word = F.regexp_replace(F.regexp_extract(heading, r"درس\s+(\S+)", 1), "[:،]+$", "")
    named = F.create_map(*[x for w, i in ordinals.items() for x in (F.lit(w), F.lit(i))])
    n = F.coalesce(digits, F.try_element_at(named, word))
    return F.when(n.isNotNull(), F.format_string("lesson-%02d", n))

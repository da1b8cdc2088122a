import json
import random

import pytest

from corvane.operators import nested


def brute(rec, text):
    """The same rows by parsing and walking."""
    out = set()

    def loads(v):
        if isinstance(v, str):
            try:
                w = json.loads(v)
                return w if isinstance(w, dict | list) else v
            except ValueError:
                return v
        return v

    def elements(v):
        v = loads(v)
        if isinstance(v, dict):
            return [(int(k) if k.strip().isdecimal() else i, x) for i, (k, x) in enumerate(v.items(), 1)]
        return list(enumerate(v, 1)) if isinstance(v, list) else []

    def question(x):
        x = loads(x)
        if not isinstance(x, dict):
            return
        for k, kind in (("options", "option"), ("items", "item")):
            out.update((rec, x.get("id"), kind, n) for n, e in elements(x.get(k)) if e is not None)
        p = loads(x.get("pairs"))
        if isinstance(p, dict):
            for s in ("left", "right"):
                out.update((rec, x.get("id"), s, n) for n, e in elements(p.get(s)) if e is not None)
        elif isinstance(p, list):
            for n, e in enumerate(p, 1):
                both = [e.get("left"), e.get("right")] if isinstance(e, dict) else (e + [None, None])[:2] if isinstance(e, list) else [None, None]
                out.update((rec, x.get("id"), s, n) for s, z in zip(("left", "right"), both) if z is not None)
        for y in loads(x.get("parts")) or []:
            question(y)

    for x in loads(json.loads(text).get("questions")) or []:
        question(x)
    return out


def make(rng, depth=0):
    word = lambda: rng.choice(["a", "ب", 'q"uo', "back\\", "{x}", "[1]", ",:", "", "😀", "line\nend", None, 3, True, {"text": "t"}, ["n", ["m"]]])
    seq = lambda: [word() for _ in range(rng.randint(0, 4))]
    q = {"id": f"q{rng.randint(1, 999)}", "stem": 'st"em\\', "answer": seq()}
    for k in ("options", "items"):
        if rng.random() < 0.6:
            q[k] = rng.choice([seq, lambda: {str(i * 2): word() for i in range(3)}, lambda: json.dumps(seq()), lambda: None, lambda: "none", lambda: []])()
    if rng.random() < 0.6:
        q["pairs"] = rng.choice([lambda: {"left": seq(), "right": seq()}, lambda: [{"left": word(), "right": word()}, [word(), word()], None, 5], lambda: {"left": seq(), "right": None}, lambda: json.dumps({"left": seq()}), lambda: {}])()
    if depth < 3 and rng.random() < 0.5:
        q["parts"] = rng.choice([lambda: [make(rng, depth + 1) for _ in range(2)], lambda: json.dumps([make(rng, depth + 1)]), lambda: None])()
    return q


def children(pdf):
    c = pdf[pdf.kind.isin(["option", "left", "right", "item"])]
    return set(zip(c.record_id, c.id, c.kind, c.no))


def test_against_parsing():
    rng = random.Random(11)
    texts = [json.dumps({"exam_title": None, "passages": [{"group_id": "p", "text": "}"}], "questions": [make(rng) for _ in range(4)]}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for _ in range(120)]
    got = nested.flatten_records(list(range(120)), texts)
    assert children(got) == set().union(*(brute(i, t) for i, t in enumerate(texts)))
    assert not got.duplicated(["record_id", "key"]).any()
    assert set(got.parent.dropna()) <= set(got.key)


@pytest.mark.parametrize(
    ("payload", "rows"),
    [
        ('{"questions": [{"id": "1", "options": ["a", null, "c"]}]}', {("option", 1), ("option", 3)}),
        ('Here is [the] JSON:\n```json\n{"exam": {"questions": [{"id": "1", "items": ["a"]}]}}\n```', {("item", 1)}),
        ('﻿[{"questions": [{"id": "1", "options": {"2": "b"}}]}]', {("option", 2)}),
        ('{"questions": [{"id": "1", "options": ["a"]}, {"id": "2", "opt', set()),
        ('{"questions": [{"id": "1", "options": ["a"] "x"}]}', set()),
        (json.dumps({"questions": json.dumps([{"id": "1", "options": ["a"]}])}), {("option", 1)}),
        ("timeout", set()), ("", set()), ("{}", set()), ("[]", set()), ("null", set()), ('{"questions": null}', set()), ('{"questions": [null, 3, "x", []]}', set()),
    ],
)
def test_dirty_payloads(payload, rows):
    got = nested.flatten_records([7], [payload])
    assert {(k, n) for _, _, k, n in children(got)} == rows


def test_table(spark):
    good = json.dumps({"exam_title": "t", "questions": [{"id": "1", "options": ["a"], "parts": [{"id": "1a", "items": ["x", "y"]}]}]})
    rows = [(1, good, 1, "c"), (1, good, 2, "c"), (1, "broken {", 0, "c"), (2, None, 1, "c"), (None, good, 1, "c"), (3, "x" * 100_000 + good, 1, "c")]
    df = spark.createDataFrame(rows, "record_id long, payload string, received_at int, kind string")
    flat = nested.flatten(df)
    t = nested.tables(flat)
    assert t["questions"].count() == 4 and t["children"].count() == 6 and t["exams"].count() == 2
    joined = t["children"].join(t["questions"].select("record_id", "question_key"), ["record_id", "question_key"])
    assert joined.count() == 6
    assert nested.flatten(df.filter("1 = 0")).count() == 0


def _walk(v, out, parent=None, field=None, no=1, depth=0):
    me = len(out)
    kind = {dict: "object", list: "array", type(None): "null", str: "string"}.get(type(v)) or ({True: "true", False: "false"}[v] if isinstance(v, bool) else "number")
    kids = list(v.items()) if isinstance(v, dict) else [(None, x) for x in v] if isinstance(v, list) else []
    out.append((me, parent, field, no, depth, kind, len(kids), v if kind == "string" else json.dumps(v) if kind in ("true", "false", "number") else None))
    for i, (f, x) in enumerate(kids, 1):
        _walk(x, out, me, f, i, depth + 1)
    return out


def test_nodes_against_a_parser(spark):
    """Values of any schema, in one batch with prose, broken and empty texts between them."""
    rng = random.Random(2)

    def value(d=0):
        r = rng.random()
        if d < 4 and r < 0.3:
            return {rng.choice(["a", 'b"', "ک", "d\\", "e f"]) + str(i): value(d + 1) for i in range(rng.randint(0, 4))}
        if d < 4 and r < 0.55:
            return [value(d + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([None, True, False, 1, -2500.0, "", "x,y:[{", 'quote"\\', "متن 😀", "\n"])

    docs, want = [], {}
    for i in range(400):
        v = value()
        if not isinstance(v, dict | list):
            v = [v]
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        broken = rng.random() < 0.1
        docs.append((i, rng.choice(["", "", " \n", "note: a, b "]) + (text[: len(text) // 2] if broken else text + rng.choice(["", " end: x"])), i))
        if not broken:
            want[i] = _walk(v, [])
    docs += [(900, None, 1), (901, "", 1), (None, "[]", 1), (902, "no JSON, here: none", 1), docs[3]]
    df = spark.createDataFrame(docs, "record_id long, payload string, received_at long").coalesce(1)
    got = {}
    for r in nested.nodes(df).collect():
        got.setdefault(r.record_id, []).append(tuple(r)[1:])
    whole = {k: v for k, v in got.items() if k in want}
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()} and set(got).isdisjoint({900, 901, 902, None})
    assert nested.nodes(df.filter("1 = 0")).count() == 0


def test_bare_lists_of_questions_and_several_exams():
    flat = nested.flatten_records([5, 6], ['[{"id":"q1","stem":"s","options":["a"]},{"id":"q2","stem":"t"}]', '[{"questions":[{"id":"x"}]},{"questions":[{"id":"y"}]}]'])
    rows = [tuple(r) for r in flat[["record_id", "kind", "key", "parent", "id"]].astype(object).where(flat[["record_id", "kind", "key", "parent", "id"]].notna(), None).values.tolist()]
    assert rows == [
        (5, "exam", "5", None, None), (5, "question", "5/q1", "5", "q1"), (5, "option", "5/q1/option1", "5/q1", "q1"), (5, "question", "5/q2", "5", "q2"),
        (6, "exam", "6", None, None), (6, "question", "6/q1", "6", "x"), (6, "exam", "6/1", None, None), (6, "question", "6/1/q1", "6/1", "y"),
    ]

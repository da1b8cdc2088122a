"""Questions in context: the passage they share, their sections and their gold answer, read from exam payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = (("options", "Options"), ("pairs", "Pairs"), ("items", "Items"))


def shown(value: Any) -> str:
    """A string as it is, any other value as JSON with its keys in order."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def section(label: str, values: Any) -> str | None:
    """A titled list, numbered from 1; one value that is no list is its only entry. Nothing for null and an empty list."""
    if values is None or values == []:
        return None
    listed = values if isinstance(values, list) else [values]
    return "\n".join([f"{label}:", *(f"{n}. {shown(v)}" for n, v in enumerate(listed, 1))])


def passage_of(group: Any, passages: Any) -> Any:
    """The text of the passage that a group names: in a list the first whose id or group_id it is, in an object either that
    object itself or its entry. A KeyError if there is none or it has no text."""
    hit = None
    if isinstance(passages, dict):
        hit = passages if group in (passages.get("id"), passages.get("group_id")) else passages.get(group, passages.get(str(group)))
    elif isinstance(passages, list):
        hit = next((p for p in passages if isinstance(p, dict) and group in (p.get("id"), p.get("group_id"))), None)
    text = hit.get("text", hit.get("passage")) if isinstance(hit, dict) else hit
    if text is None:
        raise KeyError(f"no text of passage {group}")
    return text


def context(question: dict[str, Any], passages: Any) -> str:
    """The sections of a question, parted by blank lines: its passage, the question, options, pairs and items."""
    parts: list[str | None] = []
    if question.get("group_id") is not None:
        parts.append("Passage:\n" + shown(passage_of(question["group_id"], passages)))
    parts.append("Question:\n" + shown(question["stem"]))
    for field, label in SECTIONS:
        value = question.get(field)
        if field == "pairs" and isinstance(value, dict):
            parts += [section(f"{label} ({side})", value.get(side)) for side in ("left", "right")]
        else:
            parts.append(section(label, value))
    return "\n\n".join(p for p in parts if p is not None)


def contexts(exams: DataFrame, exam: str, payload: str) -> DataFrame:
    """Every question of exam payloads (``readers.exam_files``): ``exam``, ``question_id``, ``query``, its rendered context,
    ``answer``, ``explanation`` and ``error``, which names what is missing; then ``query`` is null.

    A payload that is no JSON object gives one row with an error; the first of equal ids counts. Payloads are read one by
    one, as an exam is a small file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, text in zip(b.exam, b.payload):
                try:
                    data = json.loads(text)
                    found = data.get("questions", [])
                except (TypeError, ValueError, AttributeError) as e:
                    rows.append((name, None, None, None, None, f"payload: {type(e).__name__}"))
                    continue
                passages, seen = data.get("passages", data.get("passage", [])), set()
                for q in found:
                    if not isinstance(q, dict) or q.get("id") in seen:
                        continue
                    seen.add(q.get("id"))
                    gold = [None if q.get(f) is None else shown(q[f]) for f in ("answer", "explanation")]
                    try:
                        rows.append((name, str(q["id"]), context(q, passages), *gold, None))
                    except KeyError as e:
                        rows.append((name, None if q.get("id") is None else str(q["id"]), None, *gold, f"missing: {e.args[0]}"))
            yield pd.DataFrame(rows, columns=["exam", "question_id", "query", "answer", "explanation", "error"], dtype=object)

    given = exams.select(F.col(exam).alias("exam"), F.col(payload).alias("payload"))
    return given.mapInPandas(read, "exam string, question_id string, query string, answer string, explanation string, error string")


def resolve_refs(refs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (exam, qid) with the context of their question, and those that no question resolves."""
    known = found.filter("error is null").withColumnRenamed("question_id", "qid")
    return refs.join(known, ["exam", "qid"]), refs.join(known, ["exam", "qid"], "left_anti")


def with_profiles(rows: DataFrame, profiles: DataFrame, persona: str, rendered: str = "rendered") -> DataFrame:
    """``rows`` with their persona's prose; a persona without a profile is an error when its row is read."""
    p = profiles.select(F.col("id").alias(persona), F.col(rendered).alias("profile"))
    joined = rows.join(p, persona, "left")
    unknown: Column = F.raise_error(F.concat(F.lit("unknown persona: "), F.coalesce(F.col(persona), F.lit("null"))))
    return joined.withColumn("profile", F.when(F.col("profile").isNotNull(), F.col("profile")).otherwise(unknown))

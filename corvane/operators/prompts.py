"""Prompt columns for answering, rewriting and judging, and rubric blocks. Wording is a parameter with a default."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

ANSWER = {"en": "Answer the question from the passages.", "fa": "با توجه به متن‌ها به پرسش پاسخ دهید."}
NO_HITS = {"en": "(no passages found)", "fa": "(متنی یافت نشد)"}


@dataclass(frozen=True)
class Criterion:
    name: str
    weight: float
    description: str


def numbered(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def rag_prompt(query: Column, hits: Column, language: str = "en") -> Column:
    """System text, the hits in order of rank (an array of structs rank, source, text) and the question. Another language
    than those known is an error."""
    if language not in ANSWER:
        raise ValueError(f"no prompt for {language}")
    lines = F.transform(F.array_sort(hits), lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] (source: "), h["source"], F.lit(") "), h["text"]))
    context = F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(NO_HITS[language])
    return F.concat_ws("\n\n", F.lit(ANSWER[language]), context, query)


def mcq_prompt(query: Column, hits: Column, stem: Column, options: Column, language: str = "en") -> Column:
    return F.concat_ws("\n\n", rag_prompt(query, hits, language), stem, F.when(F.size(options) > 0, numbered(options)))


def answer_prompt(query: Column, hits: Column, profile: Column | None = None, language: str = "en") -> Column:
    """The answering prompt behind the reader's profile, if there is one."""
    base = rag_prompt(query, hits, language)
    return base if profile is None else F.concat_ws("\n\n", F.nullif(strip(profile), F.lit("")), base)


def rewrite_prompt(profile: Column, query: Column) -> Column:
    """The rewriting prompt; a blank profile or query is an error."""
    need = lambda c, what: F.when(F.coalesce(strip(c), F.lit("")) != "", c).otherwise(F.raise_error(F.lit(f"blank {what}")))
    return F.concat(F.lit("Profile:\n"), need(profile, "profile"), F.lit("\n\nRewrite for this reader:\n"), need(query, "query"))


def judge_prompt(query: Column, answer: Column, gold: Column, explanation: Column, passages: Column | None = None) -> Column:
    """The judge's prompt; the reference block appears only if there is a gold answer or an explanation."""
    there = gold.isNotNull() | explanation.isNotNull()
    reference = F.when(there, F.concat_ws("\n", F.lit("Reference:"), gold, explanation))
    listed = None if passages is None else F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    parts = [F.concat(F.lit("Question:\n"), query), reference, F.concat(F.lit("Answer:\n"), answer)]
    return F.concat_ws("\n\n", *parts, *([listed] if listed is not None else []))


def pairwise_prompt(query: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("Question:\n"), query, F.lit("\n\nA:\n"), a, F.lit("\n\nB:\n"), b)


def training_triple(profile: Column, query: Column, chosen: Column, rejected: Column, system: str = "", template: str | None = None) -> list[Column]:
    """Prompt, chosen and rejected of a preference row; with a ``template`` (the opening of a turn with {role}) the prompt is
    rendered as a chat that the assistant is to go on with."""
    prompt = rewrite_prompt(profile, query)
    prompt = prompt if template is None else chat_text(messages(F.lit(system), prompt), template)
    return [prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected")]


def batched_judge_prompt(query: Column, profile: Column, passages: Column) -> Column:
    """One prompt for all passages of a query (an array of texts), numbered from 1, that asks for one score each; null
    without passages."""
    n = F.size(passages).cast("string")
    listed = F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")
    ask = F.concat(F.lit('Rate from 0.0 to 1.0 how useful each passage is to this reader. Reply with {"scores": [...]} and exactly '), n, F.lit(" numbers in the order of the passages."))
    return F.when(F.size(passages) > 0, F.concat_ws("\n\n", F.concat(F.lit("Profile: "), profile), F.concat(F.lit("Question: "), query), listed, ask))


def passage_prompt(query: Column, profile: Column, passage: Column, gold: Column | None = None, explanation: Column | None = None) -> Column:
    """The prompt that rates one passage for a reader. Gold answer and explanation are shown to the judge where they are
    given, each under its own title."""
    titled = lambda title, c: F.when(c.isNotNull(), F.concat(F.lit(title + ":\n"), c))
    reference = [titled(t, c) for t, c in (("Gold answer", gold), ("Gold explanation", explanation)) if c is not None]
    ask = F.lit("Rate from 0.0 to 1.0 how useful this passage is to this reader. Reply with one decimal number only.")
    return F.concat_ws("\n\n", F.concat(F.lit("Profile: "), profile), F.concat(F.lit("Question: "), query), *reference, titled("Passage", passage), ask)


def ten_point_prompt(query: Column, profile: Column, passage: Column) -> Column:
    """The older prompt that asks for a whole number from 1 to 10."""
    return F.concat_ws("\n\n", F.concat(F.lit("Profile: "), profile), F.concat(F.lit("Question: "), query), F.concat(F.lit("Passage:\n"), passage), F.lit("Rate from 1 to 10 how useful this passage is. Reply with one whole number only."))


def persona_prefix(profile: Column, query: Column) -> Column:
    """The older form of a query for a reader: the profile's prose, a blank line, the query; alone without a profile."""
    return F.when(F.coalesce(profile, F.lit("")) == "", query).otherwise(F.concat(profile, F.lit("\n\n"), query))


def messages(system: Column, user: Column) -> Column:
    """A chat turn as an array of (role, content)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user))


def chat_text(turns: Column, opening: str = "<|{role}|>\n", closing: str = "\n", generate: bool = True) -> Column:
    """Turns in a chat template: ``opening`` and ``closing`` stand around each content, and with ``generate`` the opening
    of the assistant's turn at the end."""
    before, _, after = opening.partition("{role}")
    each = F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["content"], F.lit(closing)))
    text = F.array_join(each, "")
    return F.concat(text, F.lit(opening.format(role="assistant"))) if generate else text


def rubric_block(criteria: list[Criterion]) -> str:
    return "\n".join(f"  - {c.name} (weight {c.weight:g}): {c.description}" for c in criteria)


def rubric_schema(criteria: list[Criterion]) -> dict[str, Any]:
    """A strict JSON schema of the same criteria."""
    number = {"type": "number", "minimum": 0, "maximum": 1}
    return {"type": "object", "properties": {c.name: number for c in criteria}, "required": [c.name for c in criteria], "additionalProperties": False}


def check_rubric(criteria: list[Criterion]) -> None:
    names = [c.name for c in criteria]
    if len(set(names)) != len(names) or not names:
        raise ValueError("criteria must have distinct names")
    if any(isinstance(c.weight, bool) or c.weight <= 0 for c in criteria) or abs(sum(c.weight for c in criteria) - 1) > 1e-6:
        raise ValueError("weights must be positive and sum to 1")

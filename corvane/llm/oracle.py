"""SQL for those queries that SQL can express on whole tables."""

from __future__ import annotations

from .splits import DASHES, FILLERS, HIDDEN

_TOP = """
with best as (
  select question_ref, persona_id, chunk_id, max(score) as score
  from retrieved_chunks where score is not null and not isnan(score) and chunk_id is not null group by 1, 2, 3
), ranked as (
  select *, row_number() over (partition by question_ref, persona_id order by score desc, chunk_id) as place from best
)
"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _code(column: str) -> str:
    """The one spelling of a code, as ``splits.code`` has it."""
    c = f"translate(translate(translate(lower(translate({column}, '{_WIDE}', '{_PLAIN}')), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '{DASHES}', '{'-' * len(DASHES)}'), chr(8203), '')"
    c = f"regexp_replace({c}, '[\\s\\p{{Z}}{HIDDEN}]', '', 'g')"
    return f"case when not {c} in ({', '.join(repr(f) for f in FILLERS)}) and not regexp_full_match({c}, '-*') then {c} end"


_TIES = f"""
with recursive links as (
  select distinct question_ref as r, unnest(['g' || coalesce(exam, '') || chr(1) || {_code('group_id')}, 'w' || {_code('writer')}]) as k from exam_questions where question_ref is not null),
 keyed as (select * from links where k is not null),
 reach as (select r as a, k from keyed union select reach.a, y.k from reach join keyed x using (k) join keyed y on y.r = x.r),
 anchors as (select a, min(r) as anchor from reach join keyed using (k) group by a)
"""

ORACLE = {
    "p2_found": _TIES + "select anchor as anchor_ref, a as question_ref from anchors where anchor != a",
    "p1_found": r"select distinct chunk_id from chunks where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 800",
    "p7_found": _TOP + "select question_ref, persona_id, chunk_id from ranked where place <= 5",
    "p7_ranked": _TOP + "select question_ref, persona_id, chunk_id, score, cast(place as integer) as place from ranked where place <= 5",
}

"""Deeply nested JSON into related flat tables, by vectorised structural indexing.

All texts of a batch are indexed at once. From bitmaps of quotes, escapes, brackets and delimiters a prefix sum gives what
lies inside strings and how deep each bracket nests; sorting by depth and place pairs brackets, numbers the values of each
container and finds their spans. Rows are read off those spans; values are decoded only where they are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, BACKSLASH, COMMA, COLON = (ord(c) for c in '"\\,:')
OPEN = np.array([ord("{"), ord("[")], np.uint8)
CLOSE = np.array([ord("}"), ord("]")], np.uint8)


class Index:
    """Structural index of many JSON texts: containers and the spans of their values."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.data, np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.start = np.cumsum(size) - size
        doc_of = np.repeat(np.arange(len(texts)), size)
        opening, closing = np.isin(a, OPEN), np.isin(a, CLOSE)
        # quotes count from a text's first bracket on, as prose may stand before it
        first = np.full(len(texts), len(a))
        at = np.flatnonzero(opening)
        np.minimum.at(first, doc_of[at], at)
        # a quote is escaped behind an odd run of backslashes
        slash = a == BACKSLASH
        run_end = np.flatnonzero(slash & ~np.concatenate([slash[1:], [False]]))
        run_start = np.flatnonzero(slash & ~np.concatenate([[False], slash[:-1]]))
        escaped = np.zeros(len(a) + 1, bool)
        escaped[run_end + 1] = (run_end - run_start + 1) % 2 == 1
        quote = (a == QUOTE) & ~escaped[:-1] & (np.arange(len(a)) >= first[doc_of])
        seen = np.cumsum(quote)
        before = np.concatenate([[0], seen])[self.start]
        inside = ((seen - before[doc_of]) % 2 == 1) | quote
        up, down = opening & ~inside, closing & ~inside
        mark = up | down | (((a == COMMA) | (a == COLON)) & ~inside)
        pos = np.flatnonzero(mark)
        doc, ch, up, down = doc_of[pos], a[pos], up[pos], down[pos]
        level = np.cumsum(up.astype(np.int64) - down)
        base = np.zeros(len(texts), np.int64)
        heads = np.searchsorted(pos, self.start)
        base[heads > 0] = level[heads[heads > 0] - 1]
        level = level - base[doc]
        depth = level + down  # of the container that a mark belongs to; an opening bracket belongs to its own
        # marks outside of all containers, such as commas of prose, belong to none
        pos, doc, ch, depth, up, down = (x[depth > 0] for x in (pos, doc, ch, depth, up, down))
        # marks of one container stand together once sorted by text, depth and place
        order = np.lexsort((pos, depth, doc))
        pos, doc, ch, depth, up, down = (x[order] for x in (pos, doc, ch, depth, up, down))
        owner = np.cumsum(up) - 1
        valid = (depth > 0) & (owner >= 0)
        head = np.flatnonzero(up)  # container number -> its opening mark
        ok = np.zeros(len(head), bool)
        last = np.concatenate([head[1:], [len(pos)]]) - 1
        if len(head):
            ok = down[last] & (doc[last] == doc[head]) & (depth[last] == depth[head])
            ok &= (ch[head] == OPEN[0]) == (ch[last] == CLOSE[0])
        self.c_doc, self.c_open, self.c_depth = doc[head], pos[head], depth[head]
        self.c_close = np.where(ok, pos[last] if len(head) else 0, -1)
        self.c_object = ch[head] == OPEN[0]
        # values lie between a container's marks; a colon parts key and value
        i = np.flatnonzero(valid & ~down)
        i = i[(i + 1 < len(pos))]
        i = i[(owner[i] == owner[i + 1]) & valid[i + 1]] if len(i) else i
        value = (ch[i + 1] != COLON) if len(i) else np.zeros(0, bool)
        self.v_owner, self.v_start, self.v_end = owner[i][value], pos[i][value] + 1, pos[i + 1][value]
        colon = ch[i][value] == COLON
        key = np.flatnonzero(valid & (ch == COLON))
        self.v_key = np.full(len(self.v_owner), -1)
        prior = np.searchsorted(key, i[value])
        self.v_key[colon] = prior[colon]
        self.k_start, self.k_end = pos[np.maximum(key - 1, 0)] + 1, pos[key]
        bounds = np.searchsorted(self.v_owner, np.arange(len(head) + 1))
        self.c_first, self.c_after = bounds[:-1], bounds[1:]
        self.at = {int(p): n for n, p in enumerate(self.c_open)}

    def raw(self, start: int, end: int) -> bytes:
        return self.data[start:end].strip()

    def roots(self) -> list[int | None]:
        """For each text its first complete outermost container that is valid JSON; none behind an incomplete one."""
        out: list[int | None] = [None] * len(self.start)
        closed = np.zeros(len(self.start), bool)  # found, or nothing more to look for
        for c in np.flatnonzero(self.c_depth == 1).tolist():
            d = int(self.c_doc[c])
            if closed[d]:
                continue
            if self.c_close[c] < 0:
                closed[d] = True
                continue
            try:
                json.loads(self.data[self.c_open[c] : self.c_close[c] + 1])
            except ValueError:
                continue
            out[d], closed[d] = c, True
        return out

    def values(self, c: int) -> list[tuple[int, int]]:
        """Spans of a container's values, without the one empty span of an empty container."""
        spans = list(zip(self.v_start[self.c_first[c] : self.c_after[c]].tolist(), self.v_end[self.c_first[c] : self.c_after[c]].tolist()))
        return [] if len(spans) == 1 and not self.raw(*spans[0]) else spans

    def fields(self, c: int) -> dict[str, tuple[int, int]]:
        """Keys of an object with their values' spans; of equal keys the last one counts."""
        out = {}
        for v in range(self.c_first[c], self.c_after[c]):
            k = self.v_key[v]
            if k >= 0:
                raw = self.raw(self.k_start[k], self.k_end[k])
                name = raw[1:-1].decode(errors="replace") if b"\\" not in raw else json.loads(raw)
                out[name] = (int(self.v_start[v]), int(self.v_end[v]))
        return out

    def child(self, span: tuple[int, int]) -> int | None:
        """The container that a span holds."""
        s, e = span
        while s < e and self.data[s] <= 32:
            s += 1
        return self.at.get(s)


#: Columns of the rows that ``flatten`` emits: which table, the row's key and its parent's, and what tables hold.
ROWS = T.StructType(
    [T.StructField("record_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("kind", "key", "parent")]
    + [T.StructField("no", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("id", "type", "group_id", "number", "points", "answer", "explanation", "text")]
)
ENVELOPES = ("exam", "data", "result", "payload", "document")


class _Reader:
    """Reads the rows of one batch off its index; JSON inside strings is indexed in further rounds."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.exams: dict = {}

    def add(self, rec, kind, key, parent, no, **x) -> None:
        self.rows.append((rec, kind, key, parent, no, *(x.get(c) for c in ("id", "type", "group_id", "number", "points", "answer", "explanation", "text"))))

    def _next(self, rec) -> str:
        """The key of a record's next exam: the record, then record/1 and so on."""
        n = self.exams[rec] = self.exams.get(rec, -1) + 1
        return f"{rec}/{n}" if n else f"{rec}"

    def read(self, records: list[int], texts: list[str | None]) -> None:
        pending = [(t, self._exam, (r,)) for r, t in zip(records, texts) if t]
        while pending:
            ix = Index([t.encode("utf-8", "surrogatepass") for t, _, _ in pending])
            jobs, pending = pending, []
            for root, (_, read, args) in zip(ix.roots(), jobs):
                if root is not None:
                    span = (int(ix.c_open[root]), int(ix.c_close[root]) + 1)
                    read(ix, span, pending, *args)

    @staticmethod
    def text(ix: Index, span: tuple[int, int] | None) -> str | None:
        """A value as text: strings decoded, null as null, anything else as it is written."""
        if span is None:
            return None
        raw = ix.raw(*span)
        if raw == b"null":
            return None
        if raw[:1] == b'"':
            return json.loads(raw) if b"\\" in raw else raw[1:-1].decode(errors="replace")
        return raw.decode(errors="replace")

    def inner(self, ix: Index, span: tuple[int, int], pending: list, read, args: tuple) -> int | None:
        """The container of a span; if it is a string that holds JSON, it is put off to the next round."""
        c = ix.child(span)
        if c is None and ix.raw(*span)[:1] == b'"' and (t := self.text(ix, span)) and t.lstrip()[:1] in ("[", "{"):
            pending.append((t, read, args))
        return c

    def _exam(self, ix, span, pending, rec) -> None:
        c = self.inner(ix, span, pending, self._exam, (rec,))
        if c is None:
            return
        if not ix.c_object[c]:  # a list around exams, or a bare list of questions
            values = ix.values(c)
            held = [ix.fields(k) for v in values if (k := ix.child(v)) is not None and ix.c_object[k]]
            if held and all(("stem" in f or "id" in f) and "questions" not in f for f in held):
                key = self._next(rec)
                self.add(rec, "exam", key, None, 1)
                self._questions(ix, span, pending, rec, key, "q")
                return
            for v in values:
                self._exam(ix, v, pending, rec)
            return
        f = ix.fields(c)
        if "questions" not in f:
            for e in ENVELOPES:
                if e in f and (ix.child(f[e]) is not None or ix.raw(*f[e])[:1] == b'"'):
                    self._exam(ix, f[e], pending, rec)
                    return
        key = self._next(rec)
        self.add(rec, "exam", key, None, 1, text=self.text(ix, f.get("exam_title")))
        if "passages" in f:
            self._passages(ix, f["passages"], pending, rec, key)
        if "questions" in f:
            self._questions(ix, f["questions"], pending, rec, key, "q")

    def _passages(self, ix, span, pending, rec, parent) -> None:
        c = self.inner(ix, span, pending, self._passages, (rec, parent))
        if c is None:
            return
        named = ix.fields(c).items() if ix.c_object[c] else [(None, v) for v in ix.values(c)]
        for no, (name, v) in enumerate(named, 1):
            p = ix.child(v)
            g, text = name, self.text(ix, v)
            if p is not None and ix.c_object[p]:
                f = ix.fields(p)
                g = self.text(ix, f.get("group_id") or f.get("id")) or name
                text = self.text(ix, f.get("text"))
            if g is not None or text is not None:
                self.add(rec, "passage", f"{parent}/p{no}", parent, no, group_id=g, text=text)

    def _questions(self, ix, span, pending, rec, parent, mark) -> None:
        c = self.inner(ix, span, pending, self._questions, (rec, parent, mark))
        if c is None:
            return
        one = ix.c_object[c] and "stem" not in (own := ix.fields(c)) and "id" not in own
        values = list(ix.fields(c).values()) if one else [span] if ix.c_object[c] else ix.values(c)
        for no, v in enumerate(values, 1):
            self._question(ix, v, pending, rec, parent, f"{parent}/{mark}{no}", no)

    def _question(self, ix, span, pending, rec, parent, key, no) -> None:
        c = self.inner(ix, span, pending, self._question, (rec, parent, key, no))
        if c is None or not ix.c_object[c]:
            return
        f = ix.fields(c)
        get = lambda k: self.text(ix, f.get(k))
        self.add(rec, "question", key, parent, no, id=get("id"), type=get("type"), group_id=get("group_id"), number=get("number"), points=get("points"), answer=get("answer"), explanation=get("explanation"), text=get("stem"))
        for k, kind in (("options", "option"), ("items", "item")):
            if k in f:
                self._elements(ix, f[k], pending, rec, key, kind, get("id"))
        if "pairs" in f:
            self._pairs(ix, f["pairs"], pending, rec, key, get("id"))
        if "parts" in f:
            self._questions(ix, f["parts"], pending, rec, key, "s")

    def _one(self, ix, span, rec, parent, kind, no, qid) -> None:
        if ix.raw(*span) in (b"null", b""):
            return
        c, text = ix.child(span), self.text(ix, span)
        if c is not None and ix.c_object[c] and "text" in (f := ix.fields(c)):
            text = self.text(ix, f["text"])
        self.add(rec, kind, f"{parent}/{kind}{no}", parent, no, id=qid, text=text)

    def _elements(self, ix, span, pending, rec, parent, kind, qid) -> None:
        c = self.inner(ix, span, pending, self._elements, (rec, parent, kind, qid))
        if c is None:
            return
        if ix.c_object[c]:
            for place, (name, v) in enumerate(ix.fields(c).items(), 1):
                no = int(name) if name.strip().isdecimal() else place
                self._one(ix, v, rec, parent, kind, no, qid)
        else:
            for no, v in enumerate(ix.values(c), 1):
                self._one(ix, v, rec, parent, kind, no, qid)

    def _pairs(self, ix, span, pending, rec, parent, qid) -> None:
        c = self.inner(ix, span, pending, self._pairs, (rec, parent, qid))
        if c is None:
            return
        if ix.c_object[c]:
            f = ix.fields(c)
            if "left" in f or "right" in f:
                for side in ("left", "right"):
                    if side in f:
                        self._elements(ix, f[side], pending, rec, parent, side, qid)
                return
            rows = [(int(n) if n.strip().isdecimal() else i, v) for i, (n, v) in enumerate(f.items(), 1)]
        else:
            rows = list(enumerate(ix.values(c), 1))
        for no, v in rows:  # a row is {left, right} or [left, right]
            p = ix.child(v)
            if p is None:
                continue
            sides = [ix.fields(p).get(s) for s in ("left", "right")] if ix.c_object[p] else (ix.values(p) + [None, None])[:2]
            for side, x in zip(("left", "right"), sides):
                if x is not None:
                    self._one(ix, x, rec, parent, side, no, qid)


def flatten_records(records: list[int], texts: list[str | None]) -> pd.DataFrame:
    reader = _Reader()
    reader.read(records, texts)
    return pd.DataFrame(reader.rows, columns=ROWS.names)


def flatten(df: DataFrame, key: str = "record_id", payload: str = "payload", version: str | None = "received_at") -> DataFrame:
    """Rows of all flat tables, told apart by ``kind``: exam, passage, question (sub-questions too, their parent is a
    question), option, left, right and item. ``key`` is unique in a record, ``parent`` the key of the parent row.

    A repeated record counts once: the row with the greatest ``version``, ties by payload. Payloads that are null, empty,
    broken or no JSON give no rows, nor do records with a null key; prose around the JSON, envelopes and JSON inside
    strings are seen through; fields that are absent, null or empty give no rows, a null element takes its place but is no
    row. Texts of any length are read whole. Other columns are not read."""
    return _payloads(df, key, payload, version).mapInPandas(_batched(flatten_records), ROWS)


def _payloads(df: DataFrame, key: str, payload: str, version: str | None) -> DataFrame:
    """One payload a record: k, p."""
    cols = [F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{payload}`").alias("p"), (F.col(f"`{version}`") if version else F.lit(0)).alias("v")]
    rows = df.select(*cols).filter("k is not null and p is not null")
    return rows.groupBy("k").agg(F.max(F.struct("v", "p")).alias("x")).select("k", "x.p")


def _batched(read_all):
    """A function on batches of payloads that reads about a million characters at once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            upto = b.p.str.len().to_numpy().cumsum() // 1_000_000
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(upto)) + 1):
                if len(part):
                    yield read_all(b.k.iloc[part].tolist(), b.p.iloc[part].tolist())

    return read


#: Columns of the rows that ``nodes`` emits.
NODES = "record_id long, node int, parent int, field string, no int, depth int, kind string, children int, value string"
_BLANK = np.frombuffer(b" \t\n\r", np.uint8)
_KINDS = np.array(["object", "array", "string", "true", "false", "null", "number"], dtype=object)


def node_rows(records: list[int], texts: list[str | None]) -> pd.DataFrame:
    """All values of all texts as one table, read off the spans of the structural index at once."""
    kept = [(r, t) for r, t in zip(records, texts) if t]
    ix = Index([t.encode("utf-8", "surrogatepass") for _, t in kept])
    roots = ix.roots()
    a = np.frombuffer(ix.data, np.uint8)
    n = len(a)
    solid = ~np.isin(a, _BLANK)
    after = np.minimum.accumulate(np.where(solid, np.arange(n), n)[::-1])[::-1]  # the next place that is no blank
    before = np.maximum.accumulate(np.where(solid, np.arange(n), -1))  # the last one
    top = np.array([r for r in roots if r is not None], np.int64)
    # containers inside a root: their span lies in the root's
    lo, hi = np.full(len(kept), n), np.full(len(kept), -1)
    lo[ix.c_doc[top]], hi[ix.c_doc[top]] = ix.c_open[top], ix.c_close[top]
    own = ix.v_owner
    start, end = after[np.minimum(ix.v_start, n - 1)], before[np.maximum(ix.v_end - 1, 0)] + 1
    doc = ix.c_doc[own]
    real = (start < end) & (ix.c_open[own] >= lo[doc]) & (ix.v_end <= hi[doc])
    own, start, end, doc, key = own[real], start[real], end[real], doc[real], ix.v_key[real]
    # a node a root and a node a value, in order of place
    t_start, t_end, t_doc = ix.c_open[top], ix.c_close[top] + 1, ix.c_doc[top]
    place = np.concatenate([t_start, start])
    order = np.argsort(place, kind="stable")
    place = place[order]
    docs = np.concatenate([t_doc, doc])[order]
    ends = np.concatenate([t_end, end])[order]
    owner = np.concatenate([np.full(len(top), -1), own])[order]
    keys = np.concatenate([np.full(len(top), -1), key])[order]
    number = np.arange(len(place)) - np.searchsorted(docs, docs)  # documents ascend with places
    # the container that a node opens, and from it the node of a container
    at = np.full(n + 1, -1)
    at[ix.c_open] = np.arange(len(ix.c_open))
    opened = at[place] if len(place) else place
    node_of = np.full(len(ix.c_open) + 1, -1)
    node_of[opened[opened >= 0]] = number[opened >= 0]
    parent = np.where(owner >= 0, node_of[owner], -1)
    depth = np.where(owner >= 0, ix.c_depth[owner] if len(ix.c_depth) else 0, 0)
    # the place among the owner's values: places ascend, so it is the rank in the owner's run
    by_owner = np.argsort(owner, kind="stable")
    run = owner[by_owner]
    no = np.zeros(len(place), np.int64)
    no[by_owner] = np.arange(len(run)) - np.searchsorted(run, run) + 1
    no[owner < 0] = 1
    children = np.bincount(owner[owner >= 0], minlength=len(ix.c_open)) if len(ix.c_open) else np.zeros(1, np.int64)
    first = a[place] if len(place) else np.zeros(0, np.uint8)
    kind = np.full(len(place), 6)
    for i, c in enumerate(b'{["tfn'):
        kind[first == c] = i
    leaf = kind >= 2
    data = ix.data
    value = [_Reader.text(ix, (s, e)) if k == 2 else data[s:e].decode() if k != 5 else None for s, e, k in zip(place[leaf].tolist(), ends[leaf].tolist(), kind[leaf].tolist())]
    values = np.full(len(place), None, dtype=object)
    values[leaf] = value
    names = np.full(len(place), None, dtype=object)
    named = np.flatnonzero(keys >= 0)
    names[named] = [_Reader.text(ix, (int(ix.k_start[k]), int(ix.k_end[k]))) for k in keys[named]]
    rec = np.array([r for r, _ in kept], np.int64)
    held = np.where(opened >= 0, children[np.maximum(opened, 0)], 0)
    up = pd.array(np.where(owner >= 0, parent, 0), dtype="Int32")
    up[owner < 0] = pd.NA
    return pd.DataFrame({"record_id": rec[docs], "node": number, "parent": up, "field": names, "no": no, "depth": depth, "kind": _KINDS[kind], "children": held, "value": values})


def nodes(df: DataFrame, key: str = "record_id", payload: str = "payload", version: str | None = "received_at") -> DataFrame:
    """Every value of every payload, whatever its schema, as one row: ``record_id``, ``node`` (from 0 on in order of place),
    ``parent`` (the node that holds it, null for the outermost), ``field`` (its key in an object), ``no`` (its place in its
    parent from 1 on), ``depth``, ``kind`` (object, array, string, number, true, false, null), ``children`` (how many values
    it holds) and ``value`` (of strings, decoded, of numbers and truths as written).

    Which rows and payloads count is as for ``flatten``, but JSON inside strings stays a string, and of equal keys of an
    object all are given. Flat tables of any records are filters and joins of this one on (record_id, parent)."""
    return _payloads(df, key, payload, version).mapInPandas(_batched(node_rows), NODES)


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The related tables: exams, passages, questions and children, each with the key of its parent."""
    pick = lambda kinds, *cols: flat.filter(F.col("kind").isin(*kinds)).select("record_id", *cols)
    return {
        "exams": pick(["exam"], F.col("key").alias("exam_key"), F.col("text").alias("exam_title")),
        "passages": pick(["passage"], F.col("key").alias("passage_key"), F.col("parent").alias("exam_key"), F.col("no").alias("passage_no"), "group_id", "text"),
        "questions": pick(["question"], F.col("key").alias("question_key"), F.col("parent").alias("parent_key"), F.col("no").alias("question_no"), F.col("id").alias("question_id"), "number", "type", "group_id", "points", "answer", "explanation", F.col("text").alias("stem")),
        "children": pick(["option", "left", "right", "item"], F.col("key").alias("child_key"), F.col("parent").alias("question_key"), F.col("id").alias("question_id"), F.col("kind").alias("child_kind"), F.col("no").alias("child_no"), "text"),
    }

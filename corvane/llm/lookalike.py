"""One consistent form for texts that look the same on screen.

Every token, as it is written, is walked through a trie of the corpus vocabulary by a weighted edit automaton: look-alike
characters and characters without visible effect cost nothing, every visible edit costs one. A token that reaches a
vocabulary word at no cost takes that word's spelling; any other token is normalised by table. Vocabulary words are their
own table form, so two texts have the same form exactly if they look the same, whatever the vocabulary holds.

What is visible depends on the joining of Arabic letters. A zero-width non-joiner shows only between two letters that
would join. Arabic and Persian yeh look the same where they join the next letter, alef maksura and Persian yeh where they
don't; Arabic and Persian kaf where they join.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Characters with no visible effect.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Blanks of the width of a space.
SPACES = "\u00a0\u2002\u2004\u2005\u2006\u2007\u2008\u2009\u202f\u205f\u3000"
# Cyrillic and Greek letters and the Latin letters they look like.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Arabic-Indic digits and the Persian digits of the same shape; 4, 5 and 6 differ.
DIGITS = {"٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹"}
# Arabic letters that join only the letter before, by code point range.
RIGHT_JOINING = ((0x622, 0x625), (0x627, 0x627), (0x629, 0x629), (0x62F, 0x632), (0x648, 0x648), (0x671, 0x673), (0x675, 0x677), (0x688, 0x699), (0x6C0, 0x6C0), (0x6C3, 0x6CB), (0x6CD, 0x6CD), (0x6CF, 0x6CF), (0x6D2, 0x6D3), (0x6D5, 0x6D5), (0x6EE, 0x6EF))
ZWNJ, ZWJ = "\u200c", "\u200d"
YEHS, KAFS = {"ي", "ی", "ى"}, {"ك", "ک"}


def _letters() -> tuple[frozenset[str], frozenset[str]]:
    """Letters that join the letter before, and letters that join the next one."""
    right = {chr(c) for a, b in RIGHT_JOINING for c in range(a, b + 1)}
    dual = {chr(c) for c in (*range(0x620, 0x64B), *range(0x66E, 0x6D4), *range(0x6FA, 0x6FD), 0x6FF) if unicodedata.category(chr(c)) == "Lo"}
    dual -= right | {"ء", "ٴ"}
    dual.add("ـ")
    return frozenset(right | dual), frozenset(dual)


JOIN_BEFORE, JOIN_NEXT = _letters()


def _simple_map() -> dict[int, str | None]:
    """Characters whose look doesn't depend on their neighbours: other widths, presentation forms, homoglyphs, digits."""
    table: dict[int, str | None] = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES}
    for c in (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD), *range(0xFF01, 0xFFEF)):
        if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c):
            table[c] = n
    table |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    return table | {0x6C0: "هٔ", 0x6C2: "ۂ"}


def mapper(table: dict[int, str | None]) -> Callable[[str], str]:
    """``str.translate`` for tables whose characters are rare in most texts: only those characters are touched."""
    found = re.compile("[" + "".join(re.escape(chr(c)) for c in table) + "]")
    to = {chr(c): v or "" for c, v in table.items()}
    return lambda s: found.sub(lambda m: to[m.group()], s)


simple = mapper(_simple_map())
_YEH_HAMZA = re.compile("[یى]([\u064b-\u0653\u0670]*)ٔ")
_CONTEXT = re.compile(f"[{ZWNJ}{ZWJ}\u064a\u0649\u0643]")
_HALF_SPACES = re.compile(f"{ZWNJ}+")
_VARIANTS = re.compile("[\u064a\u0649\u0643]")
_MARKS = "".join(chr(c) for c in range(0x300, 0x1F00) if unicodedata.category(chr(c)) == "Mn")
#: Marks or joiners beside half-spaces, or scripts outside the lower blocks: their neighbours are looked up one by one.
_CROWDED = re.compile(f"{ZWJ}|[{_MARKS}]{ZWNJ}|{ZWNJ}[{_MARKS}]|[\u0900-\u1dff\ua800-\uabff\U00010000-\U0010ffff]{ZWNJ}")
_TOKEN = re.compile(r"\S+")
#: Half-spaces between a letter and its marks; they count as standing behind the marks.
_EARLY = re.compile(f"{ZWNJ}[{ZWNJ}{_MARKS}]*[{_MARKS}]")
def _behind_marks(m: re.Match) -> str:
    return m.group().replace(ZWNJ, "") + ZWNJ


def _joined(m: re.Match) -> bool:
    s, i, j = m.string, m.start(), m.end()
    return 0 < i and j < len(s) and s[i - 1] in JOIN_NEXT and s[j] in JOIN_BEFORE


def _variant(m: re.Match) -> str:
    """The letter that a yeh or kaf looks like, as it joins the next letter or doesn't."""
    s, j = m.string, m.end()
    while j < len(s) and unicodedata.category(s[j]) == "Mn":
        j += 1
    joins = j < len(s) and s[j] in JOIN_BEFORE
    return {"ك": "ک" if joins else "ك", "ي": "ی" if joins else "ي", "ى": "ى" if joins else "ی"}[m.group()]


def table_form(text: str) -> str:
    """The form of a text or token by table, in the light of how its letters join. Applying it twice changes nothing."""
    s = simple(text)
    if not s.isascii():
        s = _EARLY.sub(_behind_marks, s) if ZWNJ in s else s
        s = unicodedata.normalize("NFC", simple(unicodedata.normalize("NFC", simple(unicodedata.normalize("NFD", s)))))
        s = _YEH_HAMZA.sub(r"ئ\1", s)
    if not _CONTEXT.search(s):
        return s
    if not _CROWDED.search(s):  # no marks beside half-spaces: neighbours are those in the string
        s = _HALF_SPACES.sub(lambda m: ZWNJ if _joined(m) else "", s) if ZWNJ in s else s
        return _VARIANTS.sub(_variant, s)
    out: list[str] = []
    before = ""  # the last character that is no mark
    for i, c in enumerate(s):
        if c == ZWNJ or c == ZWJ:
            j = i + 1
            while j < len(s) and (s[j] == c or unicodedata.category(s[j]) == "Mn"):
                j += 1
            joined = before in JOIN_NEXT and j < len(s) and s[j] in JOIN_BEFORE
            seen = unicodedata.combining(before) == 9 if before and c == ZWNJ else False
            if (joined if c == ZWNJ else not joined) or seen:
                if not (out and out[-1] == c):
                    out.append(c)
                before = c
            continue
        if c in YEHS or c == "ك":
            j = i + 1
            while j < len(s) and unicodedata.category(s[j]) == "Mn":
                j += 1
            joins = j < len(s) and (s[j] in JOIN_BEFORE or s[j] == ZWJ)
            if c == "ك":
                c = "ک" if joins else c
            elif c == "ي":
                c = "ی" if joins else c
            elif c == "ى":
                c = c if joins else "ی"
        out.append(c)
        if unicodedata.category(c) != "Mn":
            before = c
    return "".join(out)


# What a letter may look like, as (letter, whether it joins the next letter, whether a hamza stands above it);
# None leaves a condition open.
LOOKS = {
    "ي": (("ی", True, False), ("ي", False, False), ("ي", None, True)),
    "ى": (("ى", True, False), ("ی", False, False), ("ي", None, True)),
    "ی": (("ی", None, False), ("ي", None, True)),
    "ك": (("ک", True, None), ("ك", False, None)),
    "ە": (("ە", None, False), ("ه", None, True)),
}
HAMZA = "\u0654"


class _Readings(dict):
    """The visible units that a raw character stands for: none for an ignorable, letter and marks for a composed one."""

    def __missing__(self, c: str) -> str:
        self[c] = r = simple(unicodedata.normalize("NFD", simple(c)))
        return r


_READ = _Readings()


def _units(token: str) -> str | None:
    """What a raw token shows, one unit a letter, mark or half-space, adjacent marks in canonical order; None if it holds
    joiners or viramas, which the automaton doesn't know."""
    units = "".join(map(_READ.__getitem__, token))
    if units.isascii():
        return units
    units = _EARLY.sub(_behind_marks, units) if ZWNJ in units else units
    out, run = [], []
    for u in units:
        kind = unicodedata.combining(u)
        if u == ZWJ or kind == 9:
            return None
        if kind:
            run.append((kind, u))
            continue
        out += [m for _, m in sorted(run, key=lambda m: m[0])]
        run = []
        out.append(u)
    return "".join(out) + "".join(m for _, m in sorted(run, key=lambda m: m[0]))


class _Node:
    """A node of the trie: the spellings ``lo`` to ``hi`` of the sorted ones, which agree in their first ``depth`` units."""

    __slots__ = ("trie", "lo", "hi", "depth")

    def __init__(self, trie: VocabularyTrie, lo: int, hi: int, depth: int):
        self.trie, self.lo, self.hi, self.depth = trie, lo, hi, depth

    def edges(self) -> dict[str, tuple[int, int]]:
        """The spellings behind each next unit; of the one that ends here, the smallest first, behind ''."""
        key = (self.lo, self.hi, self.depth)
        if (known := self.trie.kept.get(key)) is not None:
            return known
        units, at, out = self.trie.units, self.lo, {}
        while at < self.hi:
            c = units[at][self.depth : self.depth + 1]
            end = bisect_right(units, c, at, self.hi, key=lambda u: u[self.depth : self.depth + 1])
            out[c] = (at, end)
            at = end
        if self.depth < self.trie.SHALLOW and self.hi - self.lo > 1:
            self.trie.kept[key] = out
        return out

    def child(self, u: str) -> _Node | None:
        if self.hi - self.lo == 1:  # one spelling is left: no table of edges
            units = self.trie.units[self.lo]
            return _Node(self.trie, self.lo, self.hi, self.depth + 1) if units[self.depth : self.depth + 1] == u else None
        found = self.edges().get(u)
        return found and _Node(self.trie, *found, self.depth + 1)

    def word(self) -> str | None:
        """The spelling that ends here."""
        return self.trie.words[self.lo] if len(self.trie.units[self.lo]) == self.depth else None


class VocabularyTrie:
    """A trie of spellings in their visible units. ``search`` walks it with a weighted edit automaton over raw tokens.

    A state is a node, whether the letter before joins the next one, and what the next unit is bound to: whether it must
    join the letter before, and whether a hamza must come. Reading a look-alike follows its edge and reading an ignorable
    or a half-space that doesn't show stays at the node, both at no cost; every visible edit costs one.

    Nodes are ranges of the sorted spellings, so a spelling takes its own characters and not a table a character: tokens
    of thousands of characters occur. Edges are kept for nodes of several spellings near the root, where most walks pass."""

    SHALLOW = 12

    def __init__(self, spellings: list[str]):
        pairs = sorted(((unicodedata.normalize("NFD", w), i, w) for i, w in enumerate(spellings)), key=lambda p: p[:2])
        self.units, self.words = [u if u != w else w for u, _, w in pairs], [w for _, _, w in pairs]
        self.kept: dict[tuple[int, int, int], dict[str, tuple[int, int]]] = {}
        self.root = _Node(self, 0, len(pairs), 0)

    @staticmethod
    def _follow(node: _Node, u: str, joins: bool, join: bool | None, hamza: bool | None) -> list[tuple]:
        """The states behind a unit at no cost."""
        if u == ZWNJ:
            if hamza is True:
                return []
            if not joins:
                return [(node, False, join, None)]
            out = [] if join is True else [(node, True, False, None)]  # unseen, as the next letter doesn't join
            if join is not True and (after := node.child(u)):
                out.append((after, False, True, None))
            return out
        if unicodedata.category(u) == "Mn":
            after = None if u == HAMZA and hamza is False else node.child(u)
            return [(after, joins, join, None if u == HAMZA else hamza)] if after else []
        if hamza is True or (join is not None and join != (u in JOIN_BEFORE)):
            return []
        return [(after, e in JOIN_NEXT, j, h) for e, j, h in LOOKS.get(u, ((u, None, None),)) if (after := node.child(e))]

    def search(self, token: str, limit: int = 0) -> tuple[str, int] | None:
        """The spelling of least cost, at most ``limit`` visible edits away, the smaller one of a tie; None if there is none."""
        units = _units(token)
        if units is None or not self.words:
            return None
        best: tuple[int, str] | None = None
        todo = [(0, 0, self.root, False, None, None)]  # cost, units read, state
        while todo:
            cost, i, node, joins, join, hamza = todo.pop()
            if best and cost > best[0]:
                continue
            if i == len(units):
                word = node.word()
                if word is not None and join is not True and hamza is not True and (best is None or (cost, word) < best):
                    best = (cost, word)
            else:
                for state in self._follow(node, units[i], joins, join, hamza):
                    todo.append((cost, i + 1, *state))
            if cost < limit:  # a visible edit: another unit, one too many, one too few
                steps = [(i + 1, node, joins, None, None)] if i < len(units) else []
                for e, ends in node.edges().items():
                    if e:
                        child = _Node(self, *ends, node.depth + 1)
                        after = joins if unicodedata.category(e) == "Mn" else e in JOIN_NEXT
                        steps += [(i + n, child, after, None, None) for n in ((1, 0) if i < len(units) else (0,))]
                todo = [(cost + 1, *s) for s in steps] + todo  # states without edits first
        return (best[1], best[0]) if best else None


class Canonical(dict):
    """Forms of whole texts. Each token, as it is written, is walked through the trie and its form remembered, at most
    ``keep`` of them; ``table`` gives the form of a token that reaches no spelling."""

    def __init__(self, spellings: list[str], keep: int = 200_000, table: Callable[[str], str] = table_form):
        self.trie, self.room, self.table = VocabularyTrie(spellings), keep, table

    def __missing__(self, part: str) -> str:
        """``part`` holds no plain space, but may hold other blanks."""
        form = _TOKEN.sub(lambda m: self._token(m.group()), _blanks(part))
        form = part if form == part else form  # most parts are their own form: one string for both
        if self.room > 0 and len(part) < 100:
            self.room -= 1
            self[part] = form
        return form

    def _token(self, token: str) -> str:
        hit = self.trie.search(token)
        return hit[0] if hit else self.table(token)

    def __call__(self, text: str | None) -> str | None:
        return None if text is None else " ".join(map(self.__getitem__, text.split(" "))).strip()


_blanks = mapper({ord(c): " " for c in SPACES})


def vocabulary(texts: list[tuple[DataFrame, str]], size: int = 50_000) -> list[str]:
    """The ``size`` most frequent tokens that are their own table form, over all the given texts; ties go to the smaller.

    ``size`` bounds what reaches the driver and the workers. A token beyond it is normalised by table to the same form."""
    all_texts = None
    for df, col in texts:
        one = df.select(F.col(col).cast("string").alias("t"))
        all_texts = one if all_texts is None else all_texts.unionAll(one)
    counted = all_texts.select(F.explode(F.split("t", r"\s+")).alias("w")).filter("w != ''").groupBy("w").count()

    @F.pandas_udf("boolean")
    def own_form(s: pd.Series) -> pd.Series:
        return pd.Series([table_form(w) == w for w in s], index=s.index, dtype=bool)

    return [r.w for r in counted.filter(own_form("w")).orderBy(F.desc("count"), "w").limit(size).select("w").collect()]


def canonical_text(df: DataFrame, text: str, into: str, spellings: list[str]) -> DataFrame:
    """``df`` with ``into``, the consistent form of the column ``text``.

    Null stays null, empty or blank text becomes ''. Rows, repeated or not, are kept as they are; an existing column
    ``into`` is replaced. Only forms that differ from their text come back from Python."""

    @F.pandas_udf("string")
    def changed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        canonical = Canonical(spellings)
        for s in batches:
            yield pd.Series([f if (f := canonical(t)) != t else None for t in s.tolist()], index=s.index, dtype=object)

    t: Column = F.col(f"`{text}`")
    return df.withColumn(into, F.coalesce(changed(t), t))


def different_spellings(part: DataFrame) -> DataFrame:
    """Pairs (g, ha, hb), both ways round, of different spellings ``h`` of a group ``g``, each once however many rows have it."""
    h = part.select("g", "h").distinct()
    return h.withColumnRenamed("h", "ha").join(h.withColumnRenamed("h", "hb"), "g").filter("ha != hb")


def same_look_pairs(df: DataFrame, key: str, text: str, spellings: list[str]) -> DataFrame:
    """Pairs (key_a < key_b) of distinct keys whose texts look the same but differ in their characters.

    Null texts pair with nothing; re-delivered keys count once; exact copies of a text pair only with its other
    spellings. Spellings are grouped first, so copies don't meet each other."""
    rows = canonical_text(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("k is not null and t is not null").distinct(), "t", "f", spellings)
    rows = materialize(rows.select("k", F.sha2("f", 256).alias("g"), F.sha2("t", 256).alias("h")))  # each text walked once, and by one worker a task
    several = rows.groupBy("g").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo != hi").select("g")
    part = rows.join(several, "g", "left_semi").select("g", "k", "h")
    a, b = part.toDF("g", "key_a", "ha"), part.toDF("g", "key_b", "hb")
    return different_spellings(part).join(a, ["g", "ha"]).join(b, ["g", "hb"]).filter("key_a < key_b").select("key_a", "key_b").distinct()


def same_look_as_source(df: DataFrame, key: str, ref: str, text: str, source: DataFrame, spellings: list[str]) -> DataFrame:
    """Pairs (key_a, key_b) of a row's key and its source's, the smaller first, where the row's text looks like its
    source's text but isn't equal to it.

    ``source`` has the columns ``ref`` and ``text``. Null texts and rows without a source give no pair. Only hashes of the
    texts are shuffled, 96 bits and the length of each."""
    mark = lambda c: F.struct(F.xxhash64(c), F.hash(c), F.length(c)).alias(c)
    hashes = lambda d: canonical_text(d, "t", "f", spellings).select("k", "r", mark("t"), mark("f"))
    left = hashes(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ref}`").alias("r"), F.col(f"`{text}`").alias("t")).filter("t is not null and k is not null"))
    right = source.select(F.lit("").alias("k"), F.col(f"`{ref}`").alias("r"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    right = hashes(right).select("r", F.col("t").alias("t2"), F.col("f").alias("f2")).distinct()
    return left.join(right, "r").filter("t != t2 and f = f2").select(F.least("k", "r").alias("key_a"), F.greatest("k", "r").alias("key_b")).distinct()

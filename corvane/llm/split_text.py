"""Cut long texts into overlapping pieces at natural boundaries by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strength of the boundary behind a character.
SENTENCE_ENDS = ".!?؟۔…؛;"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def boundaries(code: np.ndarray) -> np.ndarray:
    """Strength of a cut before each code point: 3 behind a line break, 2 behind a sentence end and its blanks, 1 behind
    other blanks, 0 inside a word."""
    n = len(code)
    blank = np.isin(code, [ord(c) for c in BLANKS])
    line = np.isin(code, [10, 13, 0x85, 0x2028, 0x2029])
    strength = np.zeros(n + 1, np.int8)
    word = np.flatnonzero(~blank)
    first = word[(word > 0) & blank[np.maximum(word - 1, 0)]]  # first code points behind blanks
    strength[first] = 1
    if len(first):
        at = np.searchsorted(word, first) - 1  # the visible code point before the blanks
        last = np.where(at >= 0, word[np.maximum(at, 0)], -1)
        end = (last >= 0) & np.isin(code[np.maximum(last, 0)], [ord(c) for c in SENTENCE_ENDS])
        strength[first[end]] = 2
        lines = np.concatenate([[0], np.cumsum(line)])
        strength[first[lines[first] - lines[last + 1] > 0]] = 3
    return strength


def _latest(allowed: np.ndarray) -> np.ndarray:
    """For each position the latest allowed one at or before it, -1 if there is none."""
    return np.maximum.accumulate(np.where(allowed, np.arange(len(allowed)), -1))


def successors(code: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a piece that starts at position p: where it ends, and where the next piece starts (n if it is the last).

    A piece ends at the farthest strongest boundary in the latter half of its room, else at the limit. The next one starts
    ``overlap`` before that end, moved to the nearest boundary within half the overlap."""
    n = len(code)
    strength = boundaries(code)
    p = np.arange(n + 1)
    far = np.minimum(p + limit, n)
    end = np.full(n + 1, -1)
    for s in (3, 2, 1):
        at = _latest(strength >= s)[far]
        end = np.where((end < 0) & (at > p + limit // 2), at, end)
    end = np.where(end < 0, far, end)
    end = np.where(p + limit >= n, n, end)
    want = np.clip(end - overlap, 0, n)
    cut = strength >= 1
    cut[n] = False
    low = _latest(cut)[want]
    high = (n - _latest(cut[::-1])[n - want]) if n else np.zeros(1, int)  # the next boundary at or behind `want`
    low_gap = np.where(low >= 0, want - low, n + 1)
    high_gap = np.where((high <= n) & (high < end), high - want, n + 1)
    near = np.where(low_gap <= high_gap, low, high)
    # not before the latter half of its room, or the next piece might end where this one does
    start = np.where((np.minimum(low_gap, high_gap) <= max(1, overlap // 2)) & (near >= end - limit // 2), near, want)
    start = np.where(start <= p, np.maximum(want, p + 1), start)  # every piece starts behind the one before
    start = np.minimum(start, end)
    return end, np.where(end >= n, n, start)


def greedy_starts(succ: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All piece starts reached from ``first``: each round adds the successors of all found so far under the squared
    table, so the number of rounds is the logarithm of the most pieces of a text. Works for many texts at once."""
    found = first
    jump = succ
    while True:
        more = jump[found]
        more = more[~stop[more]]
        both = np.union1d(found, more)
        if len(both) == len(found):
            return found
        found, jump = both, jump[jump]


def split_many(texts: list[str], limit: int, overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """For each text its pieces (start, end, piece); offsets count in the text without blanks at its ends."""
    texts = [t.strip() for t in texts]
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])]).astype(np.int64)
    ends, succ = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
    stop = np.zeros(base[-1], bool)
    for c, b in zip(codes, base):
        e, s = successors(c, limit, overlap)
        ends[b : b + len(e)], succ[b : b + len(e)] = e + b, s + b
        stop[b + len(c)] = True
    starts = greedy_starts(succ, base[:-1][[len(c) > 0 for c in codes]], stop)
    cut = np.searchsorted(starts, base)
    for t, b, i, j in zip(texts, base, cut, cut[1:]):
        yield [(int(s - b), int(ends[s] - b), t[s - b : ends[s] - b]) for s in starts[i:j]]


def slices(batches: Iterator[pd.DataFrame], most_chars: int = 500_000) -> Iterator[pd.DataFrame]:
    """The batches in slices of about ``most_chars`` characters of column ``t``: a worker's memory holds the tables of one
    slice, or of one text that is longer."""
    for b in batches:
        upto = b.t.str.len().fillna(0).to_numpy().cumsum() // most_chars
        for at in np.split(np.arange(len(b)), np.flatnonzero(np.diff(upto)) + 1):
            if len(at):
                yield b.iloc[at]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 800, overlap: int = 150, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of at most ``limit`` code points: ``key``, the ``keep`` columns, ``piece`` from 0 on, ``start``, ``end``,
    ``pieces`` (of the text) and ``piece_text``.

    Blanks and line breaks at a text's ends don't count. A text within the limit is one piece, a null, empty or blank text
    gives none. Pieces end at paragraph, sentence or word boundaries where the latter half of their room has one, and cover
    the text; each shares ``overlap`` code points, or the nearest boundary's worth, with the one before. Rows of one key
    count once: identical copies are read as one, of different texts the greatest is taken; a null key is kept as a key.
    Ties don't arise. Columns besides those named are not read, so names that clash don't matter."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    cols = [F.col(f"`{key}`").alias("k"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("t")]
    held = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*cols).groupBy("k").agg(F.max(F.struct("t", *held)).alias("r")).select("k", *(f"r.{c}" for c in held), "r.t").filter("t is not null")
    kinds = {f.name: f for f in rows.schema}
    out = T.StructType([kinds["k"], *(kinds[c] for c in held), T.StructField("piece", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("piece_text", T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            found = list(split_many(b.t.tolist(), limit, overlap))
            counts = [len(x) for x in found]
            flat = [(i, s, e, n, t) for x, n in zip(found, counts) for i, (s, e, t) in enumerate(x)]
            left = b.iloc[np.repeat(np.arange(len(b)), counts)][["k", *held]].reset_index(drop=True)
            right = pd.DataFrame(flat, columns=["piece", "start", "end", "pieces", "piece_text"])
            yield pd.concat([left, right], axis=1)

    done = rows.mapInPandas(cut, out)
    return done.select(F.col("k").alias(key), *(F.col(h).alias(c) for h, c in zip(held, keep)), "piece", "start", "end", "pieces", "piece_text")

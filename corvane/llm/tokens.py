"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary file on every executor; a parameter of each operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space with the run of other characters behind it. The pattern above never matches across such a unit's end.
UNIT = re.compile(r"\s*\S+|\s+")


class Counter(dict):
    """Tokens per unit; a unit is encoded once. Counts of a text are those of encoding it as a whole."""

    def __init__(self, path: str, keep: int = 400_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.room = keep

    def __missing__(self, unit: str) -> int:
        n = len(self.encoding.encode_ordinary(unit))
        if self.room and len(unit) < 200:
            self.room -= 1
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, UNIT.findall(text))) if text else 0

    def pieces(self, text: str, most: int) -> list[tuple[int, int, int]]:
        """Cuts (start, end, tokens) of at most ``most`` tokens, between units; a longer unit is cut between characters."""
        out: list[tuple[int, int, int]] = []
        at = held = 0
        begin = 0
        for m in UNIT.finditer(text):
            n = self[m.group()]
            if held + n > most and held:
                out.append((begin, at, held))
                begin, held = at, 0
            if n > most:
                for s, e, k in self._hard(m.group(), most):
                    out.append((at + s, at + e, k))
                begin = m.end()
            else:
                held += n
            at = m.end()
        if held:
            out.append((begin, at, held))
        return out

    def _hard(self, unit: str, most: int) -> Iterator[tuple[int, int, int]]:
        start = 0
        while start < len(unit):
            step = min(len(unit) - start, most)
            while (k := len(self.encoding.encode_ordinary(unit[start : start + step]))) > most and step > 1:
                step = max(1, step * most // (k + 1))
            yield start, start + step, k
            start += step


def with_tokens(df: DataFrame, text: str, into: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``into``, the tokens of ``text``; null and empty texts have none. A column ``into`` is replaced."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary)
        for s in batches:
            yield pd.Series([counter.count(t) for t in s], index=s.index, dtype="int64")

    return df.withColumn(into, count(F.col(f"`{text}`")))

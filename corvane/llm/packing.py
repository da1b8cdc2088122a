"""Fill containers of fixed capacity by variable-capacity best fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter as Counts
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import VOCABULARY, Counter


class Stock:
    """Items by size, with how many of each size are left."""

    def __init__(self, sizes: list[int]):
        count = Counts(sizes)
        self.sizes = sorted(count)
        self.left = [count[s] for s in self.sizes]
        #: For each place the next one at or below it that has items left, with path halving; place 0 stands for none.
        self.below = list(range(len(self.sizes) + 1))

    def at_most(self, room: int) -> int:
        """The place of the largest size left that fits, from 1 on; 0 if none does."""
        i = bisect_right(self.sizes, room)
        below = self.below
        while below[i] != i:
            below[i] = below[below[i]]
            i = below[i]
        return i

    def take(self, place: int, n: int) -> None:
        self.left[place - 1] -= n
        if not self.left[place - 1]:
            self.below[place] = place - 1

    def fill(self, room: int) -> tuple[list[tuple[int, int]], int]:
        """What best fit would put into ``room``, the largest fitting size over and over: (place, how many) and the rest of
        the room. Takes nothing."""
        out: list[tuple[int, int]] = []
        i = self.at_most(room)
        while i:
            size = self.sizes[i - 1]
            n = min(self.left[i - 1], room // size)
            out.append((i, n))
            room -= n * size
            # what is left of this size doesn't fit, or nothing is left of it
            i = self.at_most(min(room, size - 1))
        return out, room


def best_fit(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Bins of items given from the largest on: each item's bin, each bin's content and its capacity in the end.

    For the largest item left a bin is opened. Every permitted length that holds it is tried with what best fit would put
    into it from all items still to come, and the length with the least unused room per token of content is opened, the
    larger one of equals. So an item that fits no larger length well gets a shorter one of its own. No item that is left
    fits a bin that is closed. In the end every bin shrinks to the shortest permitted length that holds its content."""
    capacities = sorted(capacities)
    stock = Stock(sizes)
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    while top := stock.at_most(stock.sizes[-1] if stock.sizes else 0):
        size = stock.sizes[top - 1]
        best = None
        for c in capacities:
            if c >= size:
                items, rest = stock.fill(c)
                cost = (rest / (c - rest), -c)
                if best is None or cost < best[0]:
                    best = (cost, items, c - rest)
        _, items, held = best
        for place, n in items:
            stock.take(place, n)
        bins.append((held, items))
    # items of one size are alike: those given first go to the bins opened first
    queue: dict[int, list[int]] = {}
    for b, (_, items) in enumerate(bins):
        for place, n in items:
            queue.setdefault(stock.sizes[place - 1], []).extend([b] * n)
    at = dict.fromkeys(queue, 0)
    where = []
    for s in sizes:
        where.append(queue[s][at[s]])
        at[s] += 1
    return where, [h for h, _ in bins], [capacities[bisect_left(capacities, h)] for h, _ in bins]


def fill_containers(
    df: DataFrame, key: str, text: str, capacity: int = 16_384, lengths: tuple[int, ...] = (2_048, 4_096, 8_192, 16_384), block_items: int = 20_000, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``key``, ``piece`` from 0 on, ``pieces``, ``start``, ``end``, ``tokens``, ``container`` and ``container_length``.

    A text of more than ``capacity`` tokens is cut into pieces within it, between words where it can; no other text is cut.
    Null and empty texts have no tokens and are placed in no container (null). Containers are filled in blocks of about
    ``block_items`` items, drawn by a hash of the key so that every block sees the same mix of sizes, which leaves at most
    a few unfilled containers a block. A repeated key with the same text counts once; of different texts the greatest is
    taken. Equal sizes are placed in order of key and piece. Other columns are not read."""
    if max(lengths) > capacity:
        raise ValueError("no permitted length may exceed the capacity")
    lengths = tuple(sorted({*lengths, capacity}))
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("k is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary)
        for b in batches:
            out = []
            for k, t in zip(b.k.tolist(), b.t.tolist()):
                n = counter.count(t)
                if n <= capacity:
                    out.append((k, 0, 1, 0, len(t) if t else 0, n))
                else:
                    cuts = counter.pieces(t, capacity)
                    out += [(k, i, len(cuts), s, e, m) for i, (s, e, m) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=["k", "piece", "pieces", "start", "end", "tokens"])

    sized = rows.mapInPandas(cut, f"k {kind}, piece int, pieces int, start int, end int, tokens long")
    # of several texts under one key the one with most tokens is kept whole; identical copies collapse
    sized = materialize(sized.groupBy("k", "pieces", "piece").agg(F.max(F.struct("tokens", "start", "end")).alias("m")).select("k", "piece", "pieces", "m.*"))
    keep = sized.groupBy("k").agg(F.max("pieces").alias("pieces"))
    sized = sized.join(keep, ["k", "pieces"])
    n_blocks = max(1, -(-sized.filter("tokens > 0").count() // block_items))
    items = sized.filter("tokens > 0").withColumn("block", F.pmod(F.xxhash64("k", "piece"), F.lit(n_blocks)).cast("int"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "k", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        where, _, caps = best_fit(pdf.tokens.tolist(), list(lengths))
        pdf["bin"] = where
        pdf["container_length"] = [caps[b] for b in where]
        return pdf

    schema = f"k {kind}, pieces int, piece int, tokens long, start int, end int, block int, bin int, container_length int"
    packed = items.select("k", "pieces", "piece", "tokens", "start", "end", "block").groupBy("block").applyInPandas(place, schema)
    packed = packed.withColumn("container", F.col("block").cast("long") * (1 << 32) + F.col("bin")).drop("block", "bin")
    empty = sized.filter("tokens = 0").select("k", "pieces", "piece", "tokens", "start", "end", F.lit(None).cast("int").alias("container_length"), F.lit(None).cast("long").alias("container"))
    out = packed.unionByName(empty)
    return out.select(F.col("k").alias(key), "piece", "pieces", "start", "end", "tokens", "container", "container_length")

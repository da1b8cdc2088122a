"""Splits that keep related records together: connected components, then balanced bins by largest differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

# Codes that stand for no value, once blanks, case and dashes are made alike.
FILLERS = ("", "null", "none", "nil", "nan", "n/a")
# Kinds of dash and underscore.
DASHES = "_‐‑‒–—―−﹘﹣－＿‿﹍﹎﹏⁃"
# Characters without visible effect.
HIDDEN = r"\p{Cf}\x{34f}\x{fe00}-\x{fe0f}"


def code(value: Column) -> Column:
    """One spelling per code: compatible character widths, case, digit script and kind of dash made alike, blanks and
    invisible characters removed. Fillers and codes of nothing but dashes become null."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    c = F.lower(F.translate(value.cast("string"), wide, plain))
    c = F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    c = F.translate(c, DASHES, "-" * len(DASHES))
    c = F.regexp_replace(c, rf"[\s\p{{Z}}{HIDDEN}]", "")
    return F.when(c.isin(*FILLERS) | c.rlike("^-*$"), F.lit(None)).otherwise(c)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v): every node with its component's least node, columns ``node`` and ``root``.

    Alternates large-star and small-star steps, each an aggregation and an equi-join on (node, least neighbour), so a node
    with millions of neighbours is never gathered in a task. Every round is written to the shared folder."""
    e = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select("u").union(edges.select("v")).distinct().toDF("node")
    state = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the star centre itself keeps its link through its own neighbours
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, e = e, materialize(small.filter("u != v").distinct())
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    root = e.groupBy("u").agg(F.min("v").alias("root")).toDF("node", "root")
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def tied_records(df: DataFrame, record: str, keys: list[Column]) -> DataFrame:
    """``record`` and its ``anchor``, the smallest record it is tied to by way of equal ``keys`` (itself if to none).

    Null keys tie nothing. A repeated record counts once, with all its keys; a null record is left out. Records with one
    key go straight to it; only records with several link keys to each other, so the graph that is searched has keys for
    nodes."""
    spread = F.filter(F.array(*[F.concat(F.lit(f"{i}:"), k) for i, k in enumerate(keys)]), lambda k: k.isNotNull())
    rows = df.select(F.col(f"`{record}`").alias("r"), spread.alias("ks")).filter("r is not null")
    links = materialize(rows.select("r", F.explode_outer("ks").alias("k")).distinct())
    least = links.filter("k is not null").groupBy("r").agg(F.min("k").alias("v"))
    edges = links.filter("k is not null").join(least, "r").select(F.col("k").alias("u"), "v").distinct()
    comp = materialize(components(edges))
    anchors = links.join(comp, links.k == comp.node).groupBy("root").agg(F.min("r").alias("anchor"))
    of_key = comp.join(anchors, "root").select(F.col("node").alias("k"), "anchor")
    tied = links.join(of_key, "k").groupBy("r").agg(F.min("anchor").alias("anchor"))
    return links.select("r").distinct().join(tied, "r", "left").select(F.col("r").alias(record), F.coalesce("anchor", "r").alias("anchor"))


def largest_differencing(groups: list[list[tuple[int, list]]]) -> list[tuple[int, list]]:
    """Combine partial partitions of equally many bins until one is left: the two with the widest spread are joined,
    heaviest bin to lightest. A bin is (weight, members)."""
    heap = [(g[-1][0] - g[0][0], i, g) for i, g in enumerate(sorted(x, key=lambda b: b[0]) for x in groups)]
    heap = [(-w, i, g) for w, i, g in heap]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: x[0])
        heapq.heappush(heap, (-(joined[-1][0] - joined[0][0]), count, joined))
        count += 1
    return heap[0][2]


def _combine(lots: list[list[tuple[int, list]]], bins: int) -> list[tuple[int, list]]:
    """The bins of several lots in ``bins`` common ones, the heaviest first."""
    return sorted(largest_differencing([[(0, [])] * (bins - len(g)) + g for g in lots]), key=lambda b: (-b[0], b[1]))


def allocate(weights: list[int], shares: dict[str, float]) -> list[str]:
    """A split for each bin: the heaviest bin first to the split that lacks most of its share, then single bins are moved or
    swapped as long as that brings the splits nearer to their shares."""
    total, names = sum(weights), list(shares)
    lack = {s: shares[s] * total for s in names}
    where = [""] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        where[i] = max(names, key=lambda s: (lack[s], s))
        lack[where[i]] -= weights[i]
    for _ in range(len(weights)):
        best = (-1e-9, None)
        for i, s in enumerate(where):
            moves = [(t, None, weights[i]) for t in names if t != s]
            moves += [(where[j], j, weights[i] - weights[j]) for j in range(i) if where[j] != s]
            for t, j, w in moves:
                gain = abs(lack[s] + w) + abs(lack[t] - w) - abs(lack[s]) - abs(lack[t])
                if gain < best[0]:
                    best = (gain, (i, t, j, w))
        if best[1] is None:
            break
        i, t, j, w = best[1]
        s = where[i]
        where[i] = t
        if j is not None:
            where[j] = s
        lack[s] += w
        lack[t] -= w
    return where


def balanced_splits(df: DataFrame, record: str, keys: list[Column], shares: dict[str, float], bins: int = 100, lot_items: int = 10_000, fan_in: int = 200) -> DataFrame:
    """``record``, ``anchor`` and ``split``: splits in the given proportions, tied records always in the same one.

    Components are spread by a hash over lots of about ``lot_items``; in each, largest differencing balances them into
    ``bins`` equal bins. The bins of up to ``fan_in`` lots are combined the same way, over and over until few enough are
    left for the driver, which sees at most ``fan_in`` x ``bins`` weights and gives whole bins to splits. A component
    heavier than a bin fills its bin alone. Lots depend on the anchors alone, and inside a lot heavier components come
    first, of equal ones the smaller anchor, so the same records get the same splits however they are partitioned.
    An empty table gives no rows."""
    tied = materialize(tied_records(df, record, keys))
    sizes = materialize(tied.groupBy("anchor").agg(F.count("*").alias("w")))
    lots = max(1, -(-sizes.count() // lot_items))
    sizes = sizes.withColumn("lot", F.pmod(F.xxhash64("anchor"), F.lit(lots)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "anchor"], ascending=[False, True])
        found = largest_differencing([[(0, [])] * (bins - 1) + [(w, [i])] for i, w in enumerate(pdf.w.tolist())])
        place = [0] * len(pdf)
        for b, (_, members) in enumerate(found):
            for i in members:
                place[i] = b
        return pd.DataFrame({"anchor": pdf.anchor.to_numpy(dtype=object), "w": pdf.w.to_numpy(), "lot": key[0], "bin": place})

    kind = sizes.schema["anchor"].dataType.simpleString()
    placed = materialize(sizes.groupBy("lot").applyInPandas(fill, f"anchor {kind}, w long, lot long, bin int"))
    weights = placed.groupBy("lot", "bin").agg(F.sum("w").alias("w"))

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lot", "bin"]).reset_index(drop=True)
        found = _combine([[(w, [i]) for w, i in zip(g.w.tolist(), g.index.tolist())] for _, g in pdf.groupby("lot")], bins)
        to = [0] * len(pdf)
        for b, (_, members) in enumerate(found):
            for i in members:
                to[i] = b
        return pd.DataFrame({"lot": pdf.lot, "bin": pdf.bin, "w": pdf.w, "up": key[0], "to": to})

    while lots > fan_in:
        lots = -(-lots // fan_in)
        joined = materialize(weights.withColumn("up", F.pmod(F.xxhash64("lot", F.lit(lots)), F.lit(lots))).groupBy("up").applyInPandas(join, "lot long, bin int, w long, up long, to int"))
        placed = placed.join(joined.select("lot", "bin", "up", "to"), ["lot", "bin"]).select("anchor", "w", F.col("up").alias("lot"), F.col("to").alias("bin"))
        weights = joined.groupBy(F.col("up").alias("lot"), F.col("to").alias("bin")).agg(F.sum("w").alias("w"))
    by_lot: dict[int, list] = {}
    for r in sorted(weights.collect(), key=lambda r: (r.lot, r.bin)):  # at most fan_in x bins rows
        by_lot.setdefault(r.lot, []).append((r.w, [(r.lot, r.bin)]))
    if not by_lot:
        return tied.select(record, "anchor", F.lit(None).cast("string").alias("split"))
    final = _combine([by_lot[k] for k in sorted(by_lot)], bins)
    split = allocate([w for w, _ in final], shares)
    rows = [(*m, s) for (_, members), s in zip(final, split) for m in members]
    where = df.sparkSession.createDataFrame(rows, "lot long, bin int, split string")
    return tied.join(placed.join(where, ["lot", "bin"]).select("anchor", "split"), "anchor").select(record, "anchor", "split")

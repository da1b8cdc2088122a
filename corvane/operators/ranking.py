"""Places, samples, shards and batches without a global sort."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks_in_blocks(df: DataFrame, by: list[str], block: Column, order: list[str], into: str, total: str | None = None) -> DataFrame:
    """``df`` with ``into``, each row's place from 1 on inside its ``by`` group, and ``total``, the group's size.

    ``block`` must ascend with ``order``. Rows are placed inside their block, behind all rows of the blocks before, whose
    sizes are counted first. So a group is spread over as many tasks as it has blocks; blocks are a bounded number."""
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*by, "_block").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_total", F.sum("_c").over(group))
    keys = [*by, "_block"]
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = blocked.alias("x").join(sizes.alias("y"), on).select("x.*", "y._before", "y._total")
    out = joined.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + F.col("_before"))
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_block", "_before", "_total")


def _hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *(c.cast("string") for c in cols)), 256)


def sample_keys(df: DataFrame, key: list[str], row: str, size: int, seed: int) -> DataFrame:
    """``size`` keys in the order of a seeded hash, and of each the one row with the least hash. No key counts twice, which
    a sample of rows would allow. Raises if there are fewer keys."""
    keyed = df.withColumn("_k", _hash(F.lit(seed), *(F.col(c) for c in key))).withColumn("_r", _hash(F.lit(seed), F.col(row)))
    one = Window.partitionBy("_k").orderBy("_r", row)
    first = keyed.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    chosen = first.orderBy("_k").limit(size)
    return chosen.drop("_k", "_r", "_n")


def round_robin(df: DataFrame, order: str, world: int) -> DataFrame:
    """``df`` with ``shard``: every ``world``-th row in hash order, so that shards differ by one row at most."""
    h = df.withColumn("_h", _hash(F.col(order)))
    return ranks_in_blocks(h, [], F.substring("_h", 1, 3), ["_h", order], "_p").withColumn("shard", (F.col("_p") - 1) % world).drop("_h", "_p")


def length_batches(df: DataFrame, length: str, order: str, rows: int) -> DataFrame:
    """``df`` with ``place`` in order of length, then of a hash, and ``batch``, ``rows`` of them at a time, so that texts of
    one batch are about equally long. Sort by ``order`` to have the rows as they were."""
    h = df.withColumn("_h", _hash(F.col(order)))
    block = F.struct(F.col(length), F.substring("_h", 1, 2))
    return ranks_in_blocks(h, [], block, [length, "_h", order], "place").withColumn("batch", F.floor((F.col("place") - 1) / rows)).drop("_h")


def token_batches(df: DataFrame, length: str, order: str, tokens: int) -> DataFrame:
    """``df`` with ``batch``, numbered in order of length: each holds texts of about one length, as many as fit in
    ``tokens`` at the length of the batch's longest, at least one. A batch number is the pair of the length's power-of-two
    class and the place in it, so classes are filled independently of each other."""
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col(length), F.lit(1)).cast("double")))).cast("long")
    h = df.withColumn("_h", _hash(F.col(order))).withColumn("class", top)
    r = ranks_in_blocks(h, ["class"], F.substring("_h", 1, 3), ["_h", order], "_p")
    return r.withColumn("batch", F.floor((F.col("_p") - 1) / F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("class"))))).drop("_h", "_p")


def rotation(members: DataFrame, member: str) -> DataFrame:
    """Each member with the ``next`` one in order, the last with the first. Members are a fixed, small table."""
    w = Window.partitionBy(F.lit(0)).orderBy(member)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return members.select(member, F.coalesce(F.lead(member).over(w), F.first(member).over(whole)).alias("next"))


def seeded_split(ids: list[str], fixed: dict[str, list[str]], ratios: dict[str, float], seed: int) -> list[tuple[str, str]]:
    """(id, split) on the driver with the standard library's shuffle, for lists as short as a set of exams: ids that
    ``fixed`` pins to a split come first; the others, sorted and shuffled, fill the splits in order, each with its share cut
    to a whole number, and what is left goes to the last split."""
    pinned = [(i, s) for s, members in fixed.items() for i in members]
    free = sorted(set(ids) - {i for i, _ in pinned})
    random.Random(seed).shuffle(free)
    out, at = list(pinned), 0
    names = list(ratios)
    for s in names:
        upto = len(free) if s == names[-1] else at + int(len(free) * ratios[s])
        out += [(i, s) for i in free[at:upto]]
        at = upto
    return out


def hash_split(df: DataFrame, key: str, fixed: DataFrame | None, ratios: dict[str, float], seed: int) -> DataFrame:
    """``key`` and ``split`` of any number of distinct keys: pinned ones (``fixed``: key, split) as they are, the others by
    their place in seeded hash order, cut to whole numbers as in ``seeded_split``."""
    free = df.select(key).distinct()
    if fixed is not None:
        free = free.join(fixed.select(key), key, "left_anti")
    r = ranks_in_blocks(free.withColumn("_h", _hash(F.lit(seed), F.col(key))), [], F.substring("_h", 1, 3), ["_h", key], "_p", "_of")
    names, upto, split = list(ratios), F.lit(0), F.lit(list(ratios)[-1])
    bounds = []
    for s in names[:-1]:
        upto = upto + F.floor(F.col("_of") * ratios[s])
        bounds.append((s, upto))
    for s, b in reversed(bounds):
        split = F.when(F.col("_p") <= b, s).otherwise(split)
    out = r.select(key, split.alias("split"))
    return out if fixed is None else fixed.select(key, "split").unionByName(out)

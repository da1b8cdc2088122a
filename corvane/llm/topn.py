"""The N best items of every group by mergeable aggregation with bounded heaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.heaps import smallest


def top_n(df: DataFrame, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """The ``n`` best items of each group: ``group`` columns, ``item``, ``score`` and ``place`` from 1 on.

    Higher scores come first, of equal scores the smaller item; -0.0 equals 0.0. An item counts once with its highest
    score. Rows with a null or NaN score or a null item are left out, so a group of only such rows gives no row; a null
    group value is a group of its own. Other columns are not read. Repeated rows change nothing.

    Items are first reduced to their highest score by (group, item), which spreads even one giant group over all
    partitions; then every partition keeps at most ``n`` items per group in a heap, and only heaps are shuffled."""
    if n < 1:
        raise ValueError("n must be at least 1")
    g = [F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)]
    rows = df.select(*g, F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("double").alias("s"))
    rows = rows.filter("s is not null and not isnan(s) and i is not null")
    keys = [f"g{i}" for i in range(len(group))]
    best = rows.groupBy(*keys, "i").agg(F.max("s").alias("s"))
    # 0.0 - s makes ascending order mean higher scores first and turns -0.0 into 0.0
    heaps = best.groupBy(*keys).agg(smallest(F.struct((F.lit(0.0) - F.col("s")).alias("o"), F.col("i"), F.col("s")), n).alias("h"))
    out = heaps.select(*keys, F.posexplode("h").alias("p", "e"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, group)), F.col("e.i").alias(item), F.col("e.s").alias(score), (F.col("p") + 1).alias("place"))

"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .splits import DASHES, HIDDEN
from .tokens import VOCABULARY, with_tokens

#: Random offsets that are tried for each source.
OFFSETS = 32


def source_name(value: Column) -> Column:
    """One spelling per source: case, blanks, invisible characters and kind of dash or underscore made alike. A blank
    between words counts as a dash. Nothing but blanks and dashes is no name (null)."""
    n = F.translate(F.lower(value.cast("string")), DASHES, "-" * len(DASHES))
    n = F.regexp_replace(n, f"[{HIDDEN}]", "")
    n = F.regexp_replace(n, r"[\s\p{Z}-]+", "-")
    n = F.regexp_replace(n, "^-+|-+$", "")
    return F.when(n == "", F.lit(None)).otherwise(n)


def allotments(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of ``targets`` (source, target_share, max_repeats) gives to a mixture as large as all ``sizes``
    (source, tokens) together: columns source, name, tokens, target_share, max_repeats, total, repeats.

    A source that can't reach its share gives all it may, ``max_repeats`` times; what it lacks is left to the others in
    proportion to their shares, as often as that makes another source reach its cap. Both tables have one row a source."""
    t = targets.select("source", source_name(F.col("source")).alias("name"), "target_share", "max_repeats")
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total"))
    j = t.join(sizes.select(F.col("source").alias("name"), "tokens"), "name", "left").crossJoin(total)  # one row on the right
    j = j.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("double")).withColumn("most", F.col("max_repeats") * F.col("tokens"))
    # sources in order of cap by share: the first ones are capped, the rest share what is left
    every = Window.orderBy(F.when(F.col("target_share") > 0, F.col("most") / F.col("target_share")).otherwise(F.lit(float("inf"))), "name")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("given", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("share_left", F.lit(1.0) - F.coalesce(F.sum("target_share").over(before), F.lit(0.0)))
    rate = F.when(F.col("share_left") > 1e-12, (F.col("total") - F.col("given")) / F.col("share_left"))
    # the rate of the first source that its own cap doesn't hold back is the greatest of those
    free = F.max(F.when(F.col("most") >= F.col("rate") * F.col("target_share"), F.col("rate"))).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    j = j.withColumn("rate", rate).withColumn("free", free)
    j = j.withColumn("goal", F.least(F.col("most"), F.coalesce(F.col("free") * F.col("target_share"), F.col("most"))))
    return j.select("source", "name", "tokens", "target_share", "max_repeats", "total", F.when(F.col("tokens") > 0, F.col("goal") / F.col("tokens")).otherwise(0.0).alias("repeats"))


def mix_sources(df: DataFrame, key: str, text: str, source: str, targets: DataFrame, seed: int = 42, block_rows: int = 500_000, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (``key``, ``source``, ``tokens``, ``copies``: how often the row is used, 0 rows left out) and its report
    (source, tokens, target_share, max_repeats, capped, mixed_tokens, actual_share).

    A source's documents have equal expected copies, its repeats. Their running sum, plus one random offset a source,
    crosses a whole number once for each copy. Documents stand in order of size class, then of a hash, and of ``OFFSETS``
    random offsets the one is taken whose sample comes nearest to the source's goal in tokens, as a few long documents can
    be most of a source. The sum is taken in two levels, over blocks of a class and inside a block of about ``block_rows``
    rows of all sources, so that a source of any size is spread over many tasks. Copies are the floor or the ceiling of
    the repeats, never more than max_repeats. Rows without a source, of a source without a target, or without text are not
    used; the total counts every row that has a source. A repeated key counts as often as it is there. Sources are
    compared without case, blanks and kind of dash.

    ``capped`` is read off the mixture: a source that the sampling uses up, every document ``max_repeats`` times, and that
    has less than its share of the total all the same."""
    rows = df.select(F.col(f"`{key}`").alias("k"), source_name(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("t"))
    rows = with_tokens(rows.filter("source is not null"), "t", "tokens", vocabulary)
    rows = materialize(rows.select("k", "source", "tokens", F.xxhash64(F.lit(seed), F.col("k").cast("string")).alias("h")))
    # equal targets of one name are added up, so each name has one row
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = materialize(allotments(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), t))
    blocks = max(1, -(-rows.count() // block_rows))
    # documents of one source stand in order of size, the largest first, so that a sample has its share of every size
    used = rows.filter("tokens > 0").withColumn("class", -F.floor(4 * F.log2(F.col("tokens").cast("double")))).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    # every document of a source expects the same copies, so a running sum is a running count
    counts = used.groupBy("source", "class", "block").agg(F.count("*").alias("n"))
    first = Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "class", "block", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "class", "block").orderBy("h", "k")
    used = used.withColumn("i", F.row_number().over(inside)).join(counts, ["source", "class", "block"])
    used = used.join(plan.select(F.col("name").alias("source"), "repeats"), "source")
    used = materialize(used.select("k", "source", "tokens", "repeats", (F.col("before") + F.col("i")).alias("at")))
    drawn = [F.pmod(F.xxhash64(F.lit(seed + 1), "source", F.lit(j)), F.lit(1 << 30)) / float(1 << 30) for j in range(OFFSETS)]
    copies = lambda offset: (F.floor(offset + F.col("at") * F.col("repeats") + 1e-9) - F.floor(offset + (F.col("at") - 1) * F.col("repeats") + 1e-9)).cast("int")
    sums = used.groupBy("source").agg(*(F.sum(F.col("tokens") * copies(o)).alias(f"s{j}") for j, o in enumerate(drawn)), F.sum(F.col("tokens") * F.col("repeats")).alias("goal"))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"s{j}") - F.col("goal")).alias("d"), o.alias("offset")) for j, o in enumerate(drawn))))
    offsets = sums.select("source", best["offset"].alias("offset"))
    mixed = used.join(offsets, "source").withColumn("copies", copies(F.col("offset"))).filter("copies > 0").select("k", "source", "tokens", "copies")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("m"))
    report = plan.join(got.select(F.col("source").alias("name"), "m"), "name", "left").withColumn("mixed_tokens", F.coalesce("m", F.lit(0)))
    used_up = F.col("mixed_tokens") >= F.col("max_repeats") * F.col("tokens")
    report = report.withColumn("capped", used_up & (F.col("mixed_tokens") < F.col("target_share") * F.col("total")))
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0))
    return mixed.withColumnRenamed("k", key), report.select("source", F.col("tokens").cast("long").alias("tokens"), "target_share", "max_repeats", "capped", "mixed_tokens", "actual_share")

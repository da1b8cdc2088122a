"""Labels and preference data: scored groups, triplets, candidate filters, pairs and their validation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, squeeze
from .heaps import largest, smallest

# Fixed value: punctuation that a normalised rewrite loses at its ends.
EDGE = " .،؛:!?؟\"'«»"


def rewrite_key(text: Column) -> Column:
    """Normalised rewrite: compatibility form, single spaces, no punctuation at the ends."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.btrim(squeeze(nfkc(text)), F.lit(EDGE))


def plain_key(text: Column) -> Column:
    """The same without the compatibility form; stays in the JVM."""
    return F.btrim(squeeze(text), F.lit(EDGE))


def triplet_groups(scored: DataFrame, group: list[str], item: str, score: str, most: int, margin: float, floor: float, gap: float) -> DataFrame:
    """Groups with their fate: ``dropped`` (too_few_docs, positive_margin, positive_score, no_negatives or null), the
    ``positive``, the best item, and ``negatives``, the last ``most`` of the others in descending order that are at least
    ``gap`` below it. Reasons are tested in this order; ties go to the smaller item. Two bounded heaps a group hold its
    ends, whatever its size."""
    if most < 1:
        raise ValueError("most must be at least 1; for all negatives use negative_pairs")
    entry = F.struct((F.lit(0.0) - F.col(score)).alias("o"), F.col(item).alias("item"), F.col(score).alias("score"))
    g = scored.groupBy(*group).agg(F.count("*").alias("docs"), smallest(entry, 2).alias("tops"), largest(entry, most).alias("worst"))
    first, second = F.get("tops", F.lit(0)), F.get("tops", F.lit(1))
    g = g.select(*group, "docs", first["score"].alias("top"), second["score"].alias("second"), first["item"].alias("positive"), F.reverse("worst").alias("worst"))
    fit = F.filter("worst", lambda x: (x["item"] != F.col("positive")) & (F.col("top") - x["score"] >= gap))
    g = g.withColumn("negatives", F.transform(fit, lambda x: x["item"]))
    reason = (
        F.when(F.col("docs") < 2, "too_few_docs")
        .when(F.col("top") - F.col("second") < margin, "positive_margin")
        .when(F.col("top") < floor, "positive_score")
        .when(F.size("negatives") == 0, "no_negatives")
    )
    return g.withColumn("dropped", reason).select(*group, "dropped", "positive", "negatives", "top")


def negative_pairs(scored: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """The positive with every other item of its group, one row each: group, positive, negative, margin."""
    entry = F.struct((F.lit(0.0) - F.col(score)).alias("o"), F.col(item).alias("item"), F.col(score).alias("score"))
    best = scored.groupBy(*group).agg(F.min(entry).alias("b")).select(*group, F.col("b.item").alias("positive"), F.col("b.score").alias("top"))
    return scored.join(best, group).filter(F.col(item) != F.col("positive")).select(*group, "positive", F.col(item).alias("negative"), (F.col("top") - F.col(score)).alias("margin"))


def drop_counts(groups: DataFrame) -> DataFrame:
    """Counters of a derivation: all groups, those kept, their pairs, and those dropped for each reason."""
    d = F.col("dropped")
    names = ("too_few_docs", "positive_margin", "positive_score", "no_negatives")
    return groups.agg(
        F.count("*").alias("groups_total"), F.count_if(d.isNull()).alias("groups_retained"),
        F.coalesce(F.sum(F.when(d.isNull(), F.size("negatives")).cast("long")), F.lit(0)).alias("pairs"), *(F.count_if(d == r).alias(r) for r in names),
    )


def candidate_filter(cands: DataFrame, group: list[str], text: str, score: str, samples: str, least: int, seq: str, key=plain_key) -> DataFrame:
    """``cands`` with ``filter_reason``: under_sampled, duplicate (of a better candidate with the same normalised text that
    is not itself under-sampled) or null."""
    under = F.col(samples) < least
    keyed = cands.withColumn("_k", key(F.col(text)))
    w = Window.partitionBy(*group, "_k", under).orderBy(F.desc(score), seq)
    return keyed.withColumn("filter_reason", F.when(under, "under_sampled").when(F.row_number().over(w) > 1, "duplicate")).drop("_k")


def winners(cands: DataFrame, group: list[str], score: str, seq: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(score), seq)
    return cands.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def within_pairs(cands: DataFrame, group: list[str], text: str, score: str, seq: str, margin: float, most_similar: float, similarity=None, floor: float | None = None) -> DataFrame:
    """Each group's winner as chosen and, as rejected, its worst candidate that is at least ``margin`` below and less
    similar than ``most_similar``. A group whose winner has less than ``floor``, or without such a candidate, gives no row.
    ``similarity`` of two texts is that of their normalised forms (``similarity_ratio``) unless another is given."""
    best = winners(cands, group, score, seq).select(*group, F.col(text).alias("chosen"), F.col(score).alias("chosen_score"), F.col(seq).alias("_s"))
    best = best if floor is None else best.filter(F.col("chosen_score") >= floor)
    pairs = cands.join(best, group).filter((F.col(seq) != F.col("_s")) & (F.col("chosen_score") - F.col(score) >= margin))
    pairs = pairs.withColumn("_sim", (similarity or similarity_ratio)(F.col("chosen"), F.col(text))).filter(F.col("_sim") < most_similar)
    w = Window.partitionBy(*group).orderBy(score, F.desc(seq))
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*group, "chosen", F.col(text).alias("rejected"), "chosen_score", F.col(score).alias("rejected_score"), (F.col("chosen_score") - F.col(score)).alias("margin"))


def widest_margins(cands: DataFrame, group: list[str], text: str, score: str, seq: str, most_similar: float, similarity=None, floor: float | None = None) -> DataFrame:
    """Per group with a candidate, ``widest``: the largest margin for which ``within_pairs`` still finds a pair, null if
    there is none."""
    pairs = within_pairs(cands, group, text, score, seq, 0.0, most_similar, similarity, floor)
    return cands.select(*group).distinct().join(pairs.select(*group, F.col("margin").alias("widest")), group, "left")


def survival_curve(cands: DataFrame, group: list[str], text: str, score: str, samples: str, least: int, seq: str, grid: list[float], most_similar: float, similarity=None, floor: float | None = None, key=None) -> DataFrame:
    """For every least margin of the grid the groups that still yield a pair, of all groups: candidates are filtered, then a
    pair is selected, as in production. A pair is found for a margin exactly if the worst dissimilar candidate is that far
    below the winner, so candidates meet the winner once, and the grid meets one number a group."""
    kept = candidate_filter(cands, group, text, score, samples, least, seq, key or rewrite_key).filter("filter_reason is null")
    widest = widest_margins(kept, group, text, score, seq, most_similar, similarity, floor)
    every = cands.select(*group).distinct()
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.col("widest") >= t))
    counted = every.join(widest, group, "left").groupBy(F.when(F.col("widest").isNull(), 0).otherwise(reached).alias("_r")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("min_margin"), (F.col("_r") > i).cast("long").alias("in")) for i, t in enumerate(sorted(grid))))).alias("x")
    out = counted.select("n", each).groupBy("x.min_margin").agg(F.sum(F.col("n") * F.col("x.in")).alias("groups_with_pair"), F.sum("n").alias("groups"))
    return out.withColumn("rate", F.try_divide(F.col("groups_with_pair"), F.col("groups")))


def cross_pairs(best: DataFrame, question: str, persona: str, text: str, own: str, scored_as: str, margin: float, floor: float | None = None, most_similar: float | None = None, similarity=None) -> DataFrame:
    """Each persona's winner against every other persona's winner scored under this persona: ``scored_as`` is a map from
    persona to score. Winners below ``floor``, foreign winners without a score for the persona, pairs below ``margin`` and
    pairs at least ``most_similar`` are left out. A question has one winner a persona, so the self-join is bounded by the
    personas."""
    a = best.select(question, F.col(persona).alias("persona"), F.col(text).alias("chosen"), F.col(own).alias("chosen_score"))
    a = a if floor is None else a.filter(F.col("chosen_score") >= floor)
    b = best.select(question, F.col(persona).alias("rejected_persona"), F.col(text).alias("rejected"), F.col(scored_as).alias("_m"))
    j = a.join(b, question).filter("persona != rejected_persona").withColumn("rejected_score", F.try_element_at("_m", F.col("persona"))).drop("_m")
    j = j.withColumn("margin", F.col("chosen_score") - F.col("rejected_score")).filter(F.col("margin") >= margin)
    return j if most_similar is None else j.filter((similarity or similarity_ratio)(F.col("chosen"), F.col("rejected")) < most_similar)


def best_and_worst(cands: DataFrame, group: list[str], text: str, score: str, seq: str) -> DataFrame:
    """The older pairing: first and last candidate of a group by descending score (of equal ones the earlier first), where
    the first has strictly more."""
    o = F.struct((F.lit(0.0) - F.col(score)).alias("o"), F.col(seq).alias("seq"), F.col(text).alias("text"), F.col(score).alias("score"))
    g = cands.groupBy(*group).agg(F.min(o).alias("f"), F.max(o).alias("l"))
    return g.filter("f.score > l.score").select(*group, F.col("f.text").alias("chosen"), F.col("l.text").alias("rejected"), (F.col("f.score") - F.col("l.score")).alias("margin"))


def both_orientations(best: DataFrame, question: str, persona: str, text: str, score: str, margin: float) -> DataFrame:
    """The older cross pairing: two personas' winners of a question whose scores differ by more than ``margin``, once for
    each persona."""
    x = best.select(question, F.col(persona).alias("p"), F.col(text).alias("t"), F.col(score).alias("s"))
    j = x.toDF(question, "pa", "ta", "sa").join(x.toDF(question, "pb", "tb", "sb"), question).filter((F.col("pa") < F.col("pb")) & (F.abs(F.col("sa") - F.col("sb")) > margin))
    win = F.col("sa") > F.col("sb")
    two = F.array(*(F.struct(F.col(p).alias("persona"), F.when(win, F.col("ta")).otherwise(F.col("tb")).alias("chosen"), F.when(win, F.col("tb")).otherwise(F.col("ta")).alias("rejected")) for p in ("pa", "pb")))
    return j.select(question, F.explode(two).alias("x")).select(question, "x.*")


def average_samples(samples: DataFrame, group: list[str], weights: dict[str, float]) -> DataFrame:
    """Mean sub-scores over the successful samples and their weighted sum; a candidate without one gives no row."""
    ok = samples.dropna(subset=list(weights))
    agg = ok.groupBy(*group).agg(*(F.avg(c).alias(c) for c in weights), F.count("*").alias("judge_samples"))
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return agg.withColumn("score", total)


def pair_errors(pairs: DataFrame, key: str, texts: list[str], numbers: list[str], personas: list[str], persona: str, types: list[str], kind: str, version: str, current: int, chosen: str, rejected: str, margin: tuple[str, str, str] | None = None, repeated: bool = False) -> DataFrame:
    """``key`` and the ``errors`` of each preference row, an array that is empty for a valid row. ``margin`` names the
    margin and the two scores it must be the difference of; with ``repeated``, rows that are there more than once in every
    column are an error of each of them."""
    checks = [F.when(~F.col(version).eqNullSafe(current), "format_version")]
    checks += [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"empty:{c}") for c in texts]
    checks += [F.when(F.col(c).isNull() | F.isnan(c), f"number:{c}") for c in numbers]
    checks += [F.when(~F.coalesce(F.col(persona).isin(personas), F.lit(False)), "persona"), F.when(~F.coalesce(F.col(kind).isin(types), F.lit(False)), "pair_type")]
    checks += [F.when(squeeze(F.col(chosen)) == squeeze(F.col(rejected)), "equal_sides")]
    if margin:
        m, up, down = margin
        checks += [F.when(F.abs(F.col(m) - (F.col(up) - F.col(down))) > 1e-6, "margin")]
    if not repeated:
        return pairs.select(key, F.array_compact(F.array(*checks)).alias("errors"))
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in pairs.columns))), 256)
    checked = pairs.select(key, row.alias("_row"), F.array_compact(F.array(*checks)).alias("_errors"))
    again = checked.groupBy("_row").count().filter("count > 1").select("_row", F.lit("repeated").alias("_again"))
    return checked.join(again, "_row", "left").select(key, F.when(F.col("_again").isNotNull(), F.array_append("_errors", F.col("_again"))).otherwise(F.col("_errors")).alias("errors"))


def gold_errors(records: DataFrame, gold: DataFrame, ref: str, fields: dict[str, str]) -> DataFrame:
    """``records`` with ``error``: unknown, where ``gold`` has no row of the ref, the name of the first of ``fields`` (of the
    records, of gold) that differs, or null. Null equals null. ``gold`` has one row a ref."""
    g = gold.select(F.col(ref), F.lit(True).alias("_known"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(fields.values())))
    error = F.when(F.col("_known").isNull(), "unknown")
    for i, c in enumerate(fields):
        error = error.when(~F.col(c).eqNullSafe(F.col(f"_{i}")), c)
    j = records.join(g, ref, "left").withColumn("error", error)
    return j.drop("_known", *(f"_{i}" for i in range(len(fields))))


def cache_errors(expected: DataFrame, cached: DataFrame, keys: list[str], prompt: str, output: str) -> DataFrame:
    """Keys with an ``error`` of a cache of outputs: missing, unexpected, repeated, other_prompt or empty_output; keys
    without one are left out."""
    c = cached.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(prompt).alias("_p"), F.max(prompt).alias("_q"), F.min(F.trim(F.coalesce(F.col(output), F.lit("")))).alias("_o"))
    j = expected.select(*keys, F.col(prompt).alias("_want"), F.lit(True).alias("_e")).join(c, keys, "full_outer")
    same = F.col("_p").eqNullSafe(F.col("_want")) & F.col("_q").eqNullSafe(F.col("_want"))
    error = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated").when(~same, "other_prompt").when(F.col("_o") == "", "empty_output")
    return j.withColumn("error", error).filter("error is not null").select(*keys, "error")


def candidate_dump(filtered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is written of filtered candidates: all of them with ``filter_reason`` (unknown where it is missing for one that
    isn't kept), and the survivors. ``filtered`` has ``kept`` and ``filter_reason``."""
    reason = F.when(~F.col("kept"), F.coalesce("filter_reason", F.lit("unknown")))
    return filtered.withColumn("filter_reason", reason), filtered.filter("kept")


def budget_errors(pairs: DataFrame, lengths: dict[str, Column], limit: int) -> DataFrame:
    """One row per side: how many texts are over the ``limit`` together with their prompt, and how many are of no length.
    ``lengths`` holds the lengths of ``prompt`` and of the sides, by any tokenizer."""
    prompt = lengths["prompt"]
    sides = F.array(*(F.struct(F.lit(s).alias("side"), (prompt + n).alias("n"), n.alias("own")) for s, n in lengths.items() if s != "prompt"))
    x = pairs.select(F.explode(sides).alias("x")).select("x.*")
    return x.groupBy("side").agg(F.count_if(F.col("n") > limit).alias("over_limit"), F.count_if(F.coalesce("own", F.lit(0)) == 0).alias("without_tokens"), F.max("n").alias("longest"))


def split_leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both splits have."""
    return a.select(key).intersect(b.select(key))


def similarity_ratio(a: Column, b: Column, normalised: bool = True) -> Column:
    """Ratcliff-Obershelp similarity of two texts in their normalised form (``rewrite_key``), or as they are."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y)])

    return ratio(rewrite_key(a), rewrite_key(b)) if normalised else ratio(a, b)


def rewrite_divergence(rewrites: DataFrame, question: str, persona: str, tokens: Column) -> DataFrame:
    """One row on the questions that two personas or more have a rewrite of: ``questions``, ``identical``, those whose
    rewrites have all the same text, and ``mean_jaccard`` over all pairs of personas of a question. ``rewrites`` has
    ``text``, one row a question and persona; a question has a handful of personas."""
    per = rewrites.groupBy(question).agg(F.collect_list(tokens).alias("l"), F.countDistinct("text").alias("texts")).filter(F.size("l") >= 2)
    rest = lambda i: F.slice("l", i + 2, F.size("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(rest(i), lambda y: jaccard(x, y))))
    per = per.select("texts", F.size(pairs).alias("n"), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x).alias("sum"))
    return per.agg(F.count("*").alias("questions"), F.count_if(F.col("texts") == 1).alias("identical"), (F.sum("sum") / F.sum("n")).alias("mean_jaccard"))

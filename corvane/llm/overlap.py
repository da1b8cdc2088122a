"""Records that occur, exactly or almost, in the training split and in an evaluation split.

Which records are similar is told on sets of words, which know no order; in written order, too, the openings that many
texts share would make a candidate of every pair. So texts become sequences of their distinct words in one global order,
the rarest first. If two different word sets have a Jaccard similarity of at least ``share``, the first few common words
leave a pair of words that follow each other in both sequences (there are more gaps between them than words that differ).
The suffixes that can begin a shared span therefore start early in a sequence. They are partitioned by their first two
words and sorted; suffixes of different splits whose common prefix has two words or more are candidates, and an exact check
follows. Partitions of frequent beginnings are cut into a grid of cells, so that no task gets more than a bounded number of
suffixes.

What similar texts share is measured in written order: the texts of the pairs of a batch are concatenated, a suffix array
is built by prefix doubling, and long common prefixes of suffixes that stand next to each other across the splits are the
shared spans. Merged, they are a record's coverage."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .lookalike import mapper, table_form

WORD = re.compile(r"\w+")
# Letters that stand for one letter whatever their form, and marks inside words.
LIKE = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه", "‌": None, "‍": None, "ـ": None} | {chr(c): None for c in range(0x64B, 0x656)} | {c: str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")})
like = mapper(LIKE)
CELL = 2_048
#: Words that a shared span has at least.
SPAN = 5
#: Words of the texts that are concatenated at once.
BATCH_WORDS = 200_000


class _Words(dict):
    """The words in a token between blanks, remembered for at most ``room`` tokens."""

    room = 200_000

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = tuple(WORD.findall(like(table_form(token)).lower().replace("_", " ")))
        if self.room > 0 and len(token) < 100:
            self.room -= 1
            self[token] = words
        return words


_WORDS = _Words()


def written_words(text: str | None) -> list[str]:
    """The words of a text as they follow each other, look-alike characters in one form, case and punctuation ignored."""
    return [w for token in text.split() for w in _WORDS[token]] if text else []


def plain_words(text: str | None) -> list[str]:
    """The distinct words of a text in order of code point."""
    return sorted(set(written_words(text)))


def reach(n: int, share: float) -> int:
    """How many of a sequence's ``n`` words can hold the first shared pair of neighbours.

    With d words that differ, c common ones and c / (c + d) >= share, d + 2 common words have a gap that no differing word
    breaks; before them come at most the words of this sequence that the other lacks."""
    most = 0
    for lacking in range(n - math.ceil(share * n) + 1):
        d = int((n - lacking) * (1 - share) / share + 1e-9)
        if d >= lacking:
            most = max(most, lacking + d + 2)
    return min(n, most)


def suffix_array(codes: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes of ``codes`` and, for j = 0, 1, .., the ranks of their first 2**j codes, up to the first
    j where these reach ``most`` codes or tell all suffixes apart. Built by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    tables, step = [rank], 1
    while step < most and rank.max(initial=0) + 1 < len(rank):
        behind = np.full(len(rank), -1, np.int64)
        behind[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + behind + 1, return_inverse=True)[1].astype(np.int64)
        tables.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), tables


def _common(tables: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of the suffixes at x and at y."""
    x, y = x.copy(), y.copy()
    out = np.zeros(len(x), np.int64)
    n = len(tables[0])
    for j in [len(tables) - 1, *range(len(tables) - 1, -1, -1)]:  # the longest table may apply twice
        ok = (x < n) & (y < n)
        ok[ok] = tables[j][x[ok]] == tables[j][y[ok]]
        out[ok] += 1 << j
        x[ok] += 1 << j
        y[ok] += 1 << j
    return out


def shared_spans(pairs: list[tuple[list, list]], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each pair of word sequences (a, b) the spans (from, to) of b, merged, that a holds as well, of at least ``span``
    words, or of all words of b if they are fewer.

    All sequences are concatenated, each pair's words apart from those of other pairs and each sequence ended by a word of
    its own. In the suffix array, a suffix of b has its longest common prefix with one of the two suffixes of a next to it."""
    if not pairs:
        return []
    lengths = np.array([[len(a), len(b)] for a, b in pairs], np.int64)
    owner = np.repeat(np.arange(2 * len(pairs)), (lengths + 1).ravel())
    ends = np.cumsum((lengths + 1).ravel()) - 1
    starts = ends - lengths.ravel()
    words = pd.factorize(np.array([w for a, b in pairs for s in (a, b) for w in (*s, None)], dtype=object), use_na_sentinel=False)[0].astype(np.int64)
    size = words.max() + 1
    codes = (owner // 2) * size + words
    codes[ends] = len(pairs) * size + np.arange(len(ends))
    order, tables = suffix_array(codes, int(lengths.max()))
    of_a = owner[order] % 2 == 0
    place = np.arange(len(order))
    before = np.maximum.accumulate(np.where(of_a, place, -1))
    after = np.minimum.accumulate(np.where(of_a, place, len(order))[::-1])[::-1]
    longest = np.zeros(len(order), np.int64)
    rows = np.flatnonzero(~of_a)
    for near in (before[rows], after[rows]):
        ok = (near >= 0) & (near < len(order))
        at, mine = order[near[ok]], order[rows[ok]]
        longest[mine] = np.maximum(longest[mine], _common(tables, at, mine))  # another pair's words are never equal
    out = []
    for i, (_, b) in enumerate(pairs):
        first = starts[2 * i + 1]
        got = longest[first : first + len(b)]
        spans: list[tuple[int, int]] = []
        for p in np.flatnonzero(got >= max(1, min(span, len(b)))).tolist():
            to = p + int(got[p])
            if spans and p <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], to))
            else:
                spans.append((p, to))
        out.append(spans)
    return out


def _suffix_pairs(share: float):
    """Function on the suffixes of one cell: pairs of texts of different splits whose sequences share a span here."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sorts the cell's suffixes by their first two words; pairs whose word sets differ too much are left out by the
        bits of their word sets, of which each differing word changes at most one."""
        none = pd.DataFrame({"a": [], "b": []}, dtype=object)
        tail = np.stack(pdf.start.to_numpy())
        order = np.lexsort(tail.T[::-1])
        pdf, tail = pdf.iloc[order].reset_index(drop=True), tail[order]
        same = np.concatenate([[False], (tail[1:] == tail[:-1]).all(1)])
        run = np.cumsum(~same)  # runs of suffixes with the same two words in front
        bits = np.stack(pdf.bits.to_numpy()).view(np.uint64)
        cls, names = pd.factorize(pdf.cls.to_numpy(dtype=object))
        size = pdf.n.to_numpy()
        train, evals = np.flatnonzero(pdf.train.to_numpy()), np.flatnonzero(pdf.evals.to_numpy())
        out = []
        starts = np.searchsorted(run[train], run[evals], "left")
        ends = np.searchsorted(run[train], run[evals], "right")
        for lot in np.array_split(np.arange(len(evals)), max(1, int((ends - starts).sum()) // 500_000 + 1)):
            counts = (ends - starts)[lot]
            if not counts.sum():
                continue
            e = np.repeat(evals[lot], counts)
            t = train[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[lot], counts)]
            differ = (1 - share) / (1 + share) * (size[e] + size[t])
            ok = (cls[e] != cls[t]) & (np.abs(size[e] - size[t]) <= differ)
            e, t, differ = e[ok], t[ok], differ[ok]
            ok = np.bitwise_count(bits[e] ^ bits[t]).sum(1) <= differ + 1e-9
            out.append(pd.DataFrame({"a": names[cls[t[ok]]], "b": names[cls[e[ok]]]}))
        return pd.concat(out).drop_duplicates().astype(object) if out else none

    return pairs


class _Hashes(dict):
    """64 bits of each word, remembered for at most ``room`` words."""

    room = 500_000

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        if self.room > 0:
            self.room -= 1
            self[word] = h
        return h


_HASHES = _Hashes()


def _id(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def text_classes(records: DataFrame, text: str) -> DataFrame:
    """``records`` without their ``text``, but with ``seq``, the words as written, ``words``, the distinct ones as 64-bit
    numbers, and 128-bit ids of both: ``cls`` of the word set and ``sid`` of the sequence. Texts without words have null
    ids."""
    kept = [f for f in records.schema if f.name != text]
    schema = T.StructType([*kept, *(T.StructField(n, T.ArrayType(t)) for n, t in (("seq", T.StringType()), ("words", T.LongType()))), *(T.StructField(n, T.BinaryType()) for n in ("cls", "sid"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [written_words(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            different = [sorted(set(s)) for s in seqs]
            lists = []
            for rows, values in ((seqs, pa.array([w for s in seqs for w in s], pa.string())), (different, pa.array([_HASHES[w] for s in different for w in s], pa.int64()))):
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), values))
            ids = [pa.array([_id(s) if s else None for s in rows], pa.binary()) for rows in (different, seqs)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), *lists, *ids], names=schema.names)

    return records.mapInArrow(read, schema)


def similar_classes(records: DataFrame, share: float = 0.75) -> DataFrame:
    """Pairs (a, b) of word sets, a of a training and b of an evaluation record, with Jaccard similarity of at least
    ``share``, and ``similarity``. ``records`` has ``cls``, ``words`` and ``is_train``. A class occurs once however many
    records have it."""
    if not 0.75 <= share <= 1:
        raise ValueError("the share must be from 0.75 to 1")
    classes = records.filter("cls is not null").groupBy("cls").agg(
        F.first("words").alias("words"), F.max(F.col("is_train").cast("int")).alias("train"), F.max((~F.col("is_train")).cast("int")).alias("evals")
    )
    classes = materialize(classes)
    spread = classes.select("cls", F.explode("words").alias("w"))
    often = spread.groupBy("w").agg(F.count("*").alias("df"))
    ranked = spread.join(often, "w").select("cls", F.struct("df", "w").alias("r"))
    order = materialize(ranked.groupBy("cls").agg(F.array_sort(F.collect_list("r")).alias("s")))  # at most the words of one text
    n = F.size("s")
    seq = order.select("cls", F.transform("s", lambda x: F.pmod(x.w, F.lit(2**31 - 1))).alias("s"), n.alias("n"))
    bits = F.expr("transform(sequence(0, 3), k -> aggregate(filter(s, x -> pmod(shiftright(x, 6), 4) = k), 0L, (m, x) -> m | shiftleft(1L, cast(pmod(x, 64) as int))))")
    seq = seq.withColumn("bits", bits).join(classes.select("cls", "train", "evals"), "cls")
    most = 400
    table = F.array(*[F.lit(reach(i, share)) for i in range(most + 1)])
    # beyond the table by a bound that holds for all lengths
    reached = F.when(F.col("n") <= most, F.element_at(table, F.least(F.col("n"), F.lit(most)) + 1)).otherwise(F.least(F.col("n"), F.ceil(F.col("n") * (2 - 2 * share)) + 3)).cast("int")
    suffix = seq.filter("n >= 2").select("cls", "n", "bits", "train", "evals", "s", F.explode(F.sequence(F.lit(0), F.greatest(reached - 2, F.lit(0)))).alias("pos"))
    suffix = suffix.select("cls", "n", "bits", (F.col("train") == 1).alias("train"), (F.col("evals") == 1).alias("evals"), F.slice("s", F.col("pos") + 1, 2).alias("start"))
    suffix = materialize(suffix.withColumn("key", F.xxhash64(F.col("start")[0], F.col("start")[1])))
    # beginnings seen in both splits only; frequent ones get a grid of cells
    freq = suffix.groupBy("key").agg(F.sum(F.col("train").cast("long")).alias("nt"), F.sum(F.col("evals").cast("long")).alias("ne")).filter("nt > 0 and ne > 0")
    freq = freq.select("key", F.ceil(F.col("nt") / CELL).cast("int").alias("gt"), F.ceil(F.col("ne") / CELL).cast("int").alias("ge"))
    grid = suffix.join(freq, "key")
    own = lambda k: F.pmod(F.xxhash64("cls", F.lit(k)), F.col("gt" if k else "ge")).cast("int")
    left = grid.filter("train").withColumn("i", own(1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ge") - 1))).withColumn("evals", F.lit(False))
    right = grid.filter("evals").withColumn("j", own(0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("gt") - 1))).withColumn("train", F.lit(False))
    cells = left.unionByName(right).drop("gt", "ge")
    # small beginnings share a cell; a run of equal beginnings stays in one
    shared = max(16, suffix.count() // (2 * CELL))
    cells = cells.withColumn("cell", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod("key", F.lit(shared))).otherwise(F.xxhash64("key", "i", "j")))
    found = cells.select("cell", "cls", "n", "bits", "train", "evals", "start").groupBy("cell").applyInPandas(_suffix_pairs(share), "a binary, b binary")
    pairs = found.distinct()
    x, y = (classes.select(F.col("cls").alias(c), F.col("words").alias(f"w{c}")) for c in "ab")
    exact = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    exact = exact.withColumn("similarity", F.col("common") / (F.size("wa") + F.size("wb") - F.col("common")))
    exact = exact.filter(F.col("similarity") >= share - 1e-12).select("a", "b", "similarity")
    same = classes.filter("train = 1 and evals = 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity"))
    return exact.unionByName(same)


def _records(df: DataFrame, key: str, ref: str, text: str, split: str, source: str, train: str) -> DataFrame:
    """One row a key: k, r, s, o, is_train, seq, words, sid, cls."""
    cols = {"k": key, "r": ref, "t": text, "s": split, "o": source}
    rows = df.select(*(F.col(f"`{c}`").alias(a) for a, c in cols.items())).filter("k is not null and s is not null")
    rows = rows.groupBy("k").agg(F.max(F.struct("s", "o", "r", "t")).alias("x")).select("k", "x.*").withColumn("is_train", F.col("s") == train)
    return materialize(text_classes(rows, "t").select("k", "r", "s", "o", "is_train", "seq", "words", "sid", "cls"))


def text_spans(rows: DataFrame, alike: DataFrame) -> DataFrame:
    """Pairs (sa, sb) of the ids of different texts whose word sets are similar, with ``spans``, those of sb's words that
    sa has as well, and ``words``, sb's number of words. Texts are compared once however many records have them."""
    texts = rows.filter("cls is not null").groupBy("sid", "is_train").agg(F.first("cls").alias("cls"), F.first("seq").alias("seq"))
    a = texts.filter("is_train").select(F.col("cls").alias("a"), F.col("sid").alias("sa"), F.col("seq").alias("qa"))
    b = texts.filter("not is_train").select(F.col("cls").alias("b"), F.col("sid").alias("sb"), F.col("seq").alias("qb"))
    pairs = alike.select("a", "b").join(a, "a").join(b, "b").select("sa", "sb", "qa", "qb")

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            upto = (whole.qa.str.len() + whole.qb.str.len()).to_numpy().cumsum() // BATCH_WORDS
            for at in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(upto)) + 1):
                p = whole.iloc[at]
                found = shared_spans([(x.tolist(), y.tolist()) for x, y in zip(p.qa, p.qb)])
                yield pd.DataFrame({"sa": p.sa, "sb": p.sb, "words": p.qb.str.len(), "spans": pd.Series([[{"f": f, "t": t} for f, t in s] for s in found], index=p.index, dtype=object)})

    return pairs.mapInPandas(spans, "sa binary, sb binary, words int, spans array<struct<f: int, t: int>>")


def _covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s.t - s.f)


def cross_split_overlaps(df: DataFrame, key: str, ref: str, text: str, split: str, source: str, share: float = 0.75, train: str = "train") -> DataFrame:
    """Pairs of a training record ``a`` and an evaluation record ``b`` with the same ``ref`` or with texts of which at
    least ``share`` of the distinct words are common: a, b, same_ref, similarity (null if below), coverage, eval_split,
    eval_source. ``coverage`` is the share of b's words in spans of ``SPAN`` words or more that a's text has as well (of
    all its words, if they are fewer), null where similarity is.

    Rows with a null key or split are left out; a repeated key counts once (of different rows the greatest). A null ref
    and a text without words match nothing. Word sets are compared once however many records have them, and only then
    expanded. Other columns are not read."""
    rows = _records(df, key, ref, text, split, source, train)
    alike = similar_classes(rows, share)
    spans = text_spans(rows, alike).select("sa", "sb", (_covered(F.col("spans")) / F.col("words")).alias("coverage"))
    a, b = rows.filter("is_train"), rows.filter("not is_train")
    left = a.select(F.col("k").alias("a"), F.col("cls").alias("ca"), F.col("sid").alias("sa"))
    right = b.select(F.col("k").alias("b"), F.col("cls").alias("cb"), F.col("sid").alias("sb"), F.col("s").alias("eval_split"), F.col("o").alias("eval_source"))
    near = alike.withColumnsRenamed({"a": "ca", "b": "cb"}).join(left, "ca").join(right, "cb").join(spans, ["sa", "sb"], "left")
    near = near.select("a", "b", F.lit(False).alias("same_ref"), "similarity", "coverage", "eval_split", "eval_source")
    refs = a.select(F.col("k").alias("a"), "r").join(b.select(F.col("k").alias("b"), "r", F.col("s").alias("eval_split"), F.col("o").alias("eval_source")), "r")
    refs = refs.select("a", "b", F.lit(True).alias("same_ref"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("coverage"), "eval_split", "eval_source")
    both = near.unionByName(refs).groupBy("a", "b")
    return both.agg(*(F.max(c).alias(c) for c in ("same_ref", "similarity", "coverage", "eval_split", "eval_source")))


def overlap_pairs(df: DataFrame, key: str, ref: str, text: str, split: str, source: str, share: float = 0.75, train: str = "train") -> DataFrame:
    """The pairs (a, b) of ``cross_split_overlaps`` alone."""
    rows = _records(df, key, ref, text, split, source, train)
    alike = similar_classes(rows, share)
    a, b = (rows.filter(f).select(F.col("k").alias(c), F.col("cls").alias(f"c{c}"), "r") for f, c in (("is_train", "a"), ("not is_train", "b")))
    near = alike.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(a.drop("r"), "ca").join(b.drop("r"), "cb").select("a", "b")
    return near.unionByName(a.join(b, "r").select("a", "b")).distinct()


def overlap_report(df: DataFrame, key: str, ref: str, text: str, split: str, source: str, share: float = 0.75, train: str = "train") -> DataFrame:
    """What ``cross_split_overlaps`` finds, per ``eval_split`` and ``eval_source``: ``pairs``, ``eval_records`` (records
    with a pair), ``same_question`` and ``similar_query`` (pairs of either kind), ``mean_coverage`` and ``least_coverage``
    of the records with similar ones. A record is covered by the spans of all its similar texts together.

    Pairs are counted from how often texts and refs occur, and never listed, so copies cost nothing."""
    rows = _records(df, key, ref, text, split, source, train)
    alike = materialize(similar_classes(rows, share))
    where = [F.col("s").alias("eval_split"), F.col("o").alias("eval_source")]
    train_rows, eval_rows = rows.filter("is_train"), rows.filter("not is_train")
    of = lambda d, *by: d.groupBy(*by).agg(F.count("*").alias("n"))
    a_r, b_r = of(train_rows.select("cls", "r"), "cls", "r"), of(eval_rows.select("cls", "r", *where), "cls", "r", "eval_split", "eval_source")
    a_cls, b_cls = a_r.groupBy("cls").agg(F.sum("n").alias("na")), b_r.groupBy("cls", "eval_split", "eval_source").agg(F.sum("n").alias("nb"))
    ab = alike.select("a", "b")
    near = ab.join(a_cls.withColumnRenamed("cls", "a"), "a").join(b_cls.withColumnRenamed("cls", "b"), "b")
    refs = a_r.groupBy("r").agg(F.sum("n").alias("na")).join(b_r.groupBy("r", "eval_split", "eval_source").agg(F.sum("n").alias("nb")), "r")
    both = ab.join(a_r.select(F.col("cls").alias("a"), "r", F.col("n").alias("na")), "a").join(b_r.select(F.col("cls").alias("b"), "r", "eval_split", "eval_source", F.col("n").alias("nb")), ["b", "r"])
    counted = None
    for name, d in (("near", near), ("refs", refs), ("both", both)):
        one = d.select("eval_split", "eval_source", F.lit(name).alias("kind"), (F.col("na") * F.col("nb")).alias("n"))
        counted = one if counted is None else counted.unionByName(one)
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    pairs = counted.groupBy("eval_split", "eval_source").agg((total("near") + total("refs") - total("both")).alias("pairs"), total("refs").alias("same_question"), total("near").alias("similar_query"))
    hit = ab.select(F.col("b").alias("cls")).distinct().withColumn("near", F.lit(True))
    same = train_rows.select("r").filter("r is not null").distinct().withColumn("same", F.lit(True))
    seen = eval_rows.join(hit, "cls", "left").join(same, "r", "left")
    spans = text_spans(rows, ab).select("sb", "words", F.explode("spans").alias("x")).select("sb", "words", "x.f", "x.t").distinct()
    before = Window.partitionBy("sb").orderBy("f", "t").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("upto", F.coalesce(F.max("t").over(before), F.lit(0)))
    spans = spans.groupBy("sb").agg((F.sum(F.greatest(F.lit(0), F.col("t") - F.greatest("f", "upto"))) / F.first("words")).alias("coverage"))
    seen = seen.join(spans.withColumnRenamed("sb", "sid"), "sid", "left").withColumn("c", F.when(F.col("near"), F.coalesce("coverage", F.lit(0.0))))
    per = seen.groupBy(*where).agg(F.count(F.coalesce("near", "same")).alias("eval_records"), F.avg("c").alias("mean_coverage"), F.min("c").alias("least_coverage"))
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("eval_split", "eval_source")]
    out = pairs.alias("x").join(per.alias("y"), keys[0] & keys[1])
    return out.select("x.eval_split", "x.eval_source", "pairs", "eval_records", "same_question", "similar_query", "mean_coverage", "least_coverage")

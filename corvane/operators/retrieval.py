"""Chunking, lexical and dense retrieval, and the quality of rankings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from . import heaps


def chunk_windows(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """Character windows: ``key``, ``idx`` from 0 on, ``chunk``. Windows start every size - overlap code points and are
    stripped; empty ones are dropped and take no index. Null and empty texts give no rows."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below it")
    t = F.col(text)
    starts = F.sequence(F.lit(1), F.length(t), F.lit(size - overlap))
    cut = F.filter(F.transform(starts, lambda s: tx.strip(F.substring(t, s, F.lit(size)))), lambda c: c != "")
    return df.filter(F.length(t) > 0).select(key, F.posexplode(cut).alias("idx", "chunk"))


def _placed_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every term of every text in its normalised form: ``key``, ``len``, ``place`` (from 0 on), ``term``."""
    terms = df.select(key, tx.index_terms(tx.persian_letters(F.col(text))).alias("ts"))
    return terms.select(key, F.size("ts").alias("len"), F.posexplode("ts").alias("place", "term"))


def _grouped(flat: DataFrame, key: str) -> DataFrame:
    return flat.groupBy("term", key, "len").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("place")).alias("places"))  # at most one text's terms


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index: ``term``, ``key``, ``tf``, ``places`` (ascending, from 0 on) and ``len``, the number of terms of the
    text. Texts are read in their normalised form."""
    return _grouped(_placed_terms(df, key, text), key)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``term``, ``df``, the texts that hold it, and ``ctf``, how often it occurs in all of them. ``key`` is unique, so a
    text's own counts need no shuffle: each distinct term of a text counts once."""
    terms = df.select(tx.index_terms(tx.persian_letters(F.col(text))).alias("ts"))
    once = terms.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    every = terms.select(F.explode("ts").alias("term")).groupBy("term").agg(F.count("*").alias("ctf"))
    return once.join(every, "term")


def bm25(n_docs: Column, df: Column, tf: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Score of one term, more is better. The inverse document frequency is at least 1e-6."""
    idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


class LexicalIndex(NamedTuple):
    """A stored index: ``postings`` with ``bucket``, and ``lengths`` (key, len) of the documents that have terms."""

    postings: DataFrame
    lengths: DataFrame
    buckets: int


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def phrases(queries: DataFrame, query: str, text: str) -> DataFrame:
    """The terms that a search asks for: ``query``, ``phrase`` (a word between blanks as its terms with a blank between
    them, more than one where the index parts it) and ``qf``, how often it occurs."""
    asked = queries.select(query, F.explode(tx.words(tx.persian(F.col(text)))).alias("w"))
    asked = asked.groupBy(query, "w").agg(F.count("*").alias("n")).select(query, F.array_join(tx.index_terms(F.col("w")), " ").alias("phrase"), "n")
    return asked.filter("phrase != ''").groupBy(query, "phrase").agg(F.sum("n").alias("qf"))


def _terms_of(phrases: DataFrame) -> DataFrame:
    """``phrase``, ``terms`` (how many), ``at`` and ``term``."""
    return phrases.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("l")).select("phrase", F.size("l").alias("terms"), F.posexplode("l").alias("at", "term"))


def phrase_hits(asked: DataFrame, index: LexicalIndex, doc: str) -> DataFrame:
    """Where each distinct phrase occurs: ``phrase``, ``doc``, ``tf`` and ``len``. Terms are looked up by bucket and term, so
    only the buckets of terms that are asked for are read, and only their postings travel."""
    found = _terms_of(asked).withColumn("bucket", bucket(F.col("term"), index.buckets)).join(index.postings, ["bucket", "term"])
    single = found.filter("terms = 1").select("phrase", doc, "tf", "len")
    starts = found.filter("terms > 1").select("phrase", "terms", doc, "len", "at", F.explode("places").alias("place"))
    return single.unionByName(_phrases_at(starts.withColumn("start", F.col("place") - F.col("at")), doc))


def _phrases_at(starts: DataFrame, doc: str) -> DataFrame:
    """Phrases of several terms from where each of their terms would have them begin (phrase, terms, doc, len, start)."""
    n = starts.groupBy("phrase", "terms", doc, "len", "start").agg(F.count("*").alias("n"))
    return n.filter("n = terms").groupBy("phrase", doc, "len").agg(F.count("*").alias("tf")).select("phrase", doc, "tf", "len")


def _ranked(asked: DataFrame, hits: DataFrame, lengths: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    spark = asked.sparkSession
    # hits of frequent phrases multiply with the queries that ask for them: their partitions aren't to be joined by size
    hits = materialize(hits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "phrase", doc))
    of_phrase = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    weighed = hits.join(of_phrase, "phrase").crossJoin(whole)  # one row of totals
    weighed = weighed.select("phrase", doc, bm25(F.col("docs"), F.col("df"), F.col("tf"), F.col("len"), F.col("mean")).alias("w"))
    scored = asked.join(weighed, "phrase").groupBy(query, doc).agg(F.round(F.sum(F.col("qf") * F.col("w")), 6).alias("score"))
    best = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(query, doc, "score", "rank")


def search(queries: DataFrame, query: str, query_text: str, index: LexicalIndex, doc: str, k: int) -> DataFrame:
    """The ``k`` best documents of each query by BM25: ``query``, ``doc``, ``score``, ``rank``. A word of the query that the
    index holds as several terms must occur as a phrase; a word counts as often as it occurs; ties go to the smaller
    document; a query without terms finds nothing."""
    asked = phrases(queries, query, query_text)
    return _ranked(asked, phrase_hits(asked, index, doc), index.lengths, query, doc, k)


def lexical_top_k(queries: DataFrame, query: str, query_text: str, docs: DataFrame, doc: str, doc_text: str, k: int) -> DataFrame:
    """``search`` over documents that have no stored index: their terms meet those that are asked for without one. To
    search more than once, store the index."""
    asked = materialize(phrases(queries, query, query_text))
    found = _placed_terms(docs, doc, doc_text).join(_terms_of(asked), "term")
    single = found.filter("terms = 1").groupBy("phrase", doc, "len").agg(F.count("*").alias("tf")).select("phrase", doc, "tf", "len")
    several = _phrases_at(found.filter("terms > 1").select("phrase", "terms", doc, "len", (F.col("place") - F.col("at")).alias("start")), doc)
    lengths = docs.select(doc, F.size(tx.index_terms(tx.persian_letters(F.col(doc_text)))).alias("len")).filter("len > 0")
    return _ranked(asked, single.unionByName(several), lengths, query, doc, k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def _blocks(df: DataFrame, key: str, vector: str, rows: int, name: str) -> DataFrame:
    """Blocks of about ``rows`` rows as one row of two arrays."""
    n = max(1, -(-df.count() // rows))
    b = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{name}_block"), F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).alias("r"))
    rows_of = F.col("l")
    return b.groupBy(f"{name}_block").agg(F.collect_list("r").alias("l")).select(f"{name}_block", F.transform(rows_of, lambda x: x.k).alias(f"{name}_ids"), F.transform(rows_of, lambda x: x.v).alias(f"{name}_vecs"))


def dense_top_k(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block: int = 2_048) -> DataFrame:
    """Exact inner-product search: ``query_id``, ``doc_id``, ``score``, ``rank``. A stated query set meets all rows in
    blocks; each pair of blocks is one matrix product that leaves ``k`` candidates a query. Ties go to the smaller id."""
    q, c = _blocks(queries, key, vector, block, "q"), _blocks(corpus, key, vector, block, "c")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids = np.asarray(r.c_ids)
                order = np.argsort(ids, kind="stable")
                sims = np.round(np.vstack(r.q_vecs) @ np.vstack(r.c_vecs)[order].T, 6)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(r.q_ids), top.shape[1]), "doc_id": ids[order][top].ravel(), "score": np.take_along_axis(sims, top, 1).ravel()})

    pairs = q.crossJoin(c).select("q_ids", "q_vecs", "c_ids", "c_vecs")  # blocks, not rows
    found = pairs.repartition(max(8, pairs.sparkSession.sparkContext.defaultParallelism)).mapInPandas(search, "query_id long, doc_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def full_ranks(judged: DataFrame, queries: DataFrame, corpus: DataFrame, key: str, vector: str, block: int = 2_048) -> DataFrame:
    """``judged`` (query_id, doc_id, gain) with ``rank``, each judged document's place among all rows of the corpus by
    inner product, ties by smaller id. Ranks are counted block by block, so no query's full ranking is ever sorted; judged
    rows are blocked as well, and a pair of blocks is one matrix product."""
    vec = corpus.select(F.col(key).alias("doc_id"), F.col(vector).cast("array<double>").alias("dv"))
    j = judged.join(vec, "doc_id").join(queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("qv")), "query_id")
    own = j.select("query_id", "doc_id", "qv", F.round(dot(F.col("qv"), F.col("dv")), 6).alias("own"))
    lots = max(1, -(-judged.count() // block))
    entry = F.struct("query_id", "doc_id", "own", "qv")
    asked = own.groupBy(F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(lots)).alias("lot")).agg(F.collect_list(entry).alias("l"))  # about ``block`` rows
    field = lambda n: F.transform("l", lambda x: x[n])
    asked = asked.select(field("query_id").alias("q_ids"), field("doc_id").alias("d_ids"), field("own").alias("owns"), field("qv").alias("q_vecs"))
    pairs = asked.crossJoin(_blocks(corpus, key, vector, block, "c").select("c_ids", "c_vecs"))  # blocks, not rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                q_ids, d_ids, owns = np.asarray(r.q_ids), np.asarray(r.d_ids), np.asarray(r.owns)
                different, row = np.unique(q_ids, return_index=True)
                ids, sims = np.asarray(r.c_ids), np.round(np.vstack(r.q_vecs)[row] @ np.vstack(r.c_vecs).T, 6)
                before = np.zeros(len(q_ids), np.int64)
                place = np.searchsorted(different, q_ids)
                for at in range(0, len(q_ids), 256):
                    s, o, d, q = sims[place[at : at + 256]], owns[at : at + 256, None], d_ids[at : at + 256, None], q_ids[at : at + 256, None]
                    before[at : at + 256] = (((s > o) | ((s == o) & (ids[None, :] < d))) & (ids[None, :] != q)).sum(1)
                yield pd.DataFrame({"query_id": q_ids, "doc_id": d_ids, "before": before})

    counted = pairs.repartition(max(8, pairs.sparkSession.sparkContext.defaultParallelism)).mapInPandas(count, "query_id long, doc_id long, before long")
    ranks = counted.groupBy("query_id", "doc_id").agg((F.sum("before") + 1).alias("rank"))
    return judged.join(ranks, ["query_id", "doc_id"])


def gold_index_quality(queries: DataFrame, gold: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """One row over queries with one right document each (``gold``: query_id, doc_id): the share found among the first
    1..k of the whole corpus, and the mean reciprocal rank."""
    r = full_ranks(gold.withColumn("gain", F.lit(1.0)), queries, corpus, key, vector)
    return r.agg(F.count("*").alias("queries"), *(F.avg((F.col("rank") <= i).cast("double")).alias(f"recall{i}") for i in range(1, k + 1)), F.avg(1.0 / F.col("rank")).alias("mrr"))


def deciding_ranks(judged: DataFrame, queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 5, m: int = 3) -> DataFrame:
    """Those rows of ``judged``, with ``rank``, that ``ranking_quality`` can't do without: each query's ``max(k, m)`` best by
    gain and the judged ones among its ``k`` nearest. All other rows add nothing to any of its figures, so they equal those of
    ``full_ranks`` over all of ``judged``, while no query's judged documents are ever gathered."""
    best = judged.groupBy("query_id").agg(heaps.smallest(F.struct((-F.col("gain")).alias("g"), "doc_id"), max(k, m)).alias("b"))
    best = best.select("query_id", F.explode("b.doc_id").alias("doc_id"))
    near = dense_top_k(queries, corpus, key, vector, k + 1).filter("query_id != doc_id").select("query_id", "doc_id")  # the query itself may be one
    few = judged.join(best.unionByName(near).distinct(), ["query_id", "doc_id"])
    return full_ranks(few, queries, corpus, key, vector)


def ranking_quality(ranked: DataFrame, k: int = 5, m: int = 3) -> DataFrame:
    """Per query nDCG@1..k, Hit@1..k, Recall@k, the reciprocal rank in the full ranking and judged@k.

    ``ranked`` has query_id, doc_id, gain and rank of the judged documents that the corpus has. Relevant are the ``m`` with
    the highest gain; the ideal ranking is that of the judged documents. Gains are linear, discounted by log2(rank + 1)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    r = ranked.withColumn("ideal", F.row_number().over(best)).withColumn("rel", F.col("ideal") <= m)
    disc = lambda c: F.log2(c.cast("double") + 1)
    cols = []
    for i in range(1, k + 1):
        dcg = F.sum(F.when(F.col("rank") <= i, F.col("gain") / disc(F.col("rank"))).otherwise(0.0))
        ideal = F.sum(F.when(F.col("ideal") <= i, F.col("gain") / disc(F.col("ideal"))).otherwise(0.0))
        cols += [F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias(f"ndcg{i}"), F.max(F.when(F.col("rel") & (F.col("rank") <= i), 1.0).otherwise(0.0)).alias(f"hit{i}")]
    cols.append((F.sum((F.col("rel") & (F.col("rank") <= k)).cast("double")) / F.sum(F.col("rel").cast("double"))).alias("recall"))
    cols.append(F.coalesce(F.max(F.when(F.col("rel"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"))
    cols.append((F.sum((F.col("rank") <= k).cast("double")) / k).alias("judged"))
    return r.groupBy("query_id").agg(*cols)


def mnrl_loss(scores: Column, temperature: float) -> Column:
    """Cross-entropy of the first of an array of similarities against the rest."""
    s = F.transform(scores, lambda x: x / temperature)
    top = F.array_max(s)
    return F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.element_at(s, 1)


def kd_loss(teacher: Column, student: Column, t_teacher: float, t_student: float) -> Column:
    """KL divergence of the softened student from the softened teacher."""

    def log_softmax(v: Column, t: float) -> Column:
        s = F.transform(v, lambda x: x / t)
        top = F.array_max(s)
        z = F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
        return F.transform(s, lambda x: x - z)

    p, q = log_softmax(teacher, t_teacher), log_softmax(student, t_student)
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def whole_losses(judged: DataFrame, mnrl: float, t_teacher: float, t_student: float) -> DataFrame:
    """``mnrl_loss`` and ``kd_loss`` per query over all its rows of ``judged`` (query_id, doc_id, gain, sim), the smallest
    document being the positive one. Sums, not arrays, so a query may have any number of rows."""
    tops = judged.groupBy("query_id").agg(F.max("sim").alias("top"), F.max("gain").alias("gtop"), F.min_by("sim", "doc_id").alias("pos"))
    j = judged.join(tops, "query_id")
    s, g = F.col("sim") - F.col("top"), F.col("gain") - F.col("gtop")
    p = F.exp(g / t_teacher)
    sums = j.groupBy("query_id").agg(
        F.first("top").alias("top"), F.first("pos").alias("pos"), F.sum(F.exp(s / mnrl)).alias("zm"), F.sum(F.exp(s / t_student)).alias("zs"), F.sum(p).alias("zt"), F.sum(p * (g / t_teacher - s / t_student)).alias("d")
    )
    return sums.select("query_id", (F.log("zm") + (F.col("top") - F.col("pos")) / mnrl).alias("mnrl"), (F.col("d") / F.col("zt") - F.log("zt") + F.log("zs")).alias("kd"))


def anchor_penalty(df: DataFrame, vector: str, base: str) -> DataFrame:
    """One row: the mean of one less the inner product of unit vectors with what they were before training."""
    return df.agg(F.avg(1 - dot(F.col(vector), F.col(base))).alias("penalty"))


def hit_overlap(hits: DataFrame, keys: list[str], arm: str, before: str, after: str, doc: str, k: int = 5) -> DataFrame:
    """One row: the mean over keys that both arms have of their common hits by ``k``. ``hits`` has one row a hit."""
    of = lambda a: F.collect_set(F.when(F.col(arm) == a, F.col(doc)))
    wide = hits.groupBy(*keys).agg(of(before).alias("x"), of(after).alias("y")).filter("size(x) > 0 and size(y) > 0")
    return wide.agg(F.count("*").alias("n"), F.avg(F.size(F.array_intersect("x", "y")) / F.lit(k)).alias("overlap"))


def distinct_hit_sets(hits: DataFrame, question: str, member: str, arm: str, doc: str) -> DataFrame:
    """Per arm the mean number of different hit sets that a question has over its members."""
    sets = hits.groupBy(arm, question, member).agg(F.array_sort(F.collect_set(doc)).alias("s"))
    return sets.groupBy(arm, question).agg(F.countDistinct("s").alias("n")).groupBy(arm).agg(F.avg("n").alias("distinct_sets"))


def own_pool_quality(scored: DataFrame, group: list[str], doc: str, score: str, sim: str, k: int = 5) -> DataFrame:
    """One row over groups of two documents or more, each ranked within its own documents by ``sim``, ties by the smaller
    document: the share with a positive among the first 1..k, and nDCG@k. Positives are within 1e-6 of the best score."""
    own = Window.partitionBy(*group)
    r = scored.withColumn("size", F.count("*").over(own)).filter("size >= 2").withColumn("best", F.max(score).over(own))
    r = r.withColumn("rank", F.row_number().over(own.orderBy(F.desc(sim), doc))).withColumn("ideal", F.row_number().over(own.orderBy(F.desc(score), doc)))
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col(score) / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    first = F.min(F.when(F.col("best") - F.col(score) < 1e-6, F.col("rank")))
    per = r.groupBy(*group).agg(first.alias("first"), gain("rank").alias("dcg"), gain("ideal").alias("idcg"))
    recalls = [F.avg((F.col("first") <= i).cast("double")).alias(f"recall{i}") for i in range(1, k + 1)]
    return per.agg(F.count("*").alias("groups"), *recalls, F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias(f"ndcg{k}"))

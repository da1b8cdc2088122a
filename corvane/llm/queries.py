"""The queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import defects, langid, lookalike, mixing, overlap, packing, split_text, splits, topn

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def _chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_text.split_oversized(table(spark, d, "chunks"), "chunk_id", "text", 800, 150, ("source", "chunk_index"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return _chunk_pieces(spark, d).filter("piece = 1").select("chunk_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their source, chunk index and order."""
    return _chunk_pieces(spark, d)


def _ties(q: DataFrame) -> list:
    group = splits.code(F.col("group_id"))
    return [F.when(group.isNotNull(), F.concat_ws("\u0001", F.coalesce("exam", F.lit("")), group)), splits.code(F.col("writer"))]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each tied question with its anchor."""
    q = table(spark, d, "exam_questions")
    tied = splits.tied_records(q, "question_ref", _ties(q))
    return tied.filter("anchor != question_ref").select(F.col("anchor").alias("anchor_ref"), "question_ref")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every question, in proportions 80/10/10."""
    q = table(spark, d, "exam_questions")
    return splits.balanced_splits(q, "question_ref", _ties(q), SHARES)


def _vocabulary(spark: SparkSession, d: str) -> list[str]:
    return lookalike.vocabulary([(table(spark, d, "chunks"), "text"), (table(spark, d, "exam_questions"), "stem")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Stems that look the same, and hits that look like their chunk, with different characters."""
    words = _vocabulary(spark, d)
    stems = lookalike.same_look_pairs(table(spark, d, "exam_questions"), "question_ref", "stem", words)
    hits = lookalike.same_look_as_source(table(spark, d, "retrieved_chunks"), "hit_id", "chunk_id", "text", table(spark, d, "chunks"), words)
    return stems.select(F.lit("stem").alias("field"), "key_a", "key_b").unionByName(hits.select(F.lit("text").alias("field"), "key_a", "key_b"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every stem and of every stored text."""
    words = _vocabulary(spark, d)
    stems = lookalike.canonical_text(table(spark, d, "exam_questions").select("question_ref", "stem").distinct(), "stem", "form", words)
    hits = lookalike.canonical_text(table(spark, d, "retrieved_chunks").select("hit_id", "text").distinct(), "text", "form", words)
    return stems.select(F.lit("stem").alias("field"), F.col("question_ref").alias("key"), "form").unionByName(hits.select(F.lit("text").alias("field"), F.col("hit_id").alias("key"), "form"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective sides with their most likely defect."""
    labelled = defects.label_defects(table(spark, d, "dpo_pairs"))
    return labelled.filter("defect is not null").select("pair_id", "side", "defect")


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors of all defects, and every defect that reaches its cutoff."""
    labelled = defects.label_defects(table(spark, d, "dpo_pairs"))
    return labelled.select("pair_id", "side", *(F.round(c, 6).alias(c) for c in defects.DEFECTS), F.array_join("defects", ",").alias("defects"))


def _prompts(spark: SparkSession, d: str) -> tuple:
    profiles = table(spark, d, "profiles").select(F.col("id").alias("persona_id"), "split")
    records = table(spark, d, "prompt_records").select("case_id", "question_ref", "persona_id", "query").join(profiles, "persona_id")
    return records.withColumn("source", F.substring_index("question_ref", ":", 1)), "case_id", "question_ref", "query", "split", "source"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping records of the training split and another one, the smaller id first."""
    return overlap.overlap_pairs(*_prompts(spark, d)).select(F.least("a", "b").alias("case_a"), F.greatest("a", "b").alias("case_b"))


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs, the training record first, with what makes them overlap."""
    out = overlap.cross_split_overlaps(*_prompts(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "coverage")})


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source, with the coverage of the records with similar ones."""
    out = overlap.overlap_report(*_prompts(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_coverage", "least_coverage")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of every question and persona."""
    best = topn.top_n(table(spark, d, "retrieved_chunks"), ["question_ref", "persona_id"], "chunk_id", "score", 5)
    return best.select("question_ref", "persona_id", "chunk_id")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with scores and places."""
    return topn.top_n(table(spark, d, "retrieved_chunks"), ["question_ref", "persona_id"], "chunk_id", "score", 5)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents too big for any container, which had to be cut."""
    return packing.fill_containers(table(spark, d, "documents"), "doc_id", "text").filter("piece = 1").select("doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document or piece with its container."""
    return packing.fill_containers(table(spark, d, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their target share: the sampled mixture uses them up and still lacks some."""
    return _mixture(spark, d)[1].filter("capped").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares."""
    return _mixture(spark, d)[1]


def _language_model(spark: SparkSession, d: str) -> langid.Model:
    return langid.train(table(spark, d, "documents"), "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents without a right label and of those in several languages."""
    return langid.mislabelled(table(spark, d, "documents"), "doc_id", "text", "lang", _language_model(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document and of every passage of a mixed one, with confidences."""
    out = langid.languages(table(spark, d, "documents"), "doc_id", "text", _language_model(spark, d))
    return out.withColumn("confidence", F.round("confidence", 6))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_splits, p3_found, p3_forms, p4_found, p4_labels, p5_found, p5_overlaps, p5_report,
        p7_found, p7_ranked, p8_found, p8_containers, p9_found, p9_mixture, p9_shares, p10_found, p10_languages,
    )
}

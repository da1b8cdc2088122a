"""Readers: documents, JSON lines, exam files, split files, run logs, scored groups in both formats, and their digests."""

from __future__ import annotations

import hashlib
import json
import random
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.retrieval import LexicalIndex

#: Explicit schemas; nothing on a hot path is inferred.
CORPUS = "chunk_id string, source string, lesson_id string, section_type string, text string"
SCORED = "format_version int, question_ref string, query string, persona_id string, document string, score double, docs array<struct<chunk_id: string, text: string, teacher_score: double>>"
TRIPLETS = "query string, persona_id string, positive string, negatives array<string>"
TRAINING_LOG = "run string, epoch_metrics array<struct<epoch: int, recall: double, val_loss: double, mrr: double, persona_ids: array<string>, per_query: map<string, array<double>>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files (.txt, .md): ``path``, ``text``. Files of another kind raise when they are read; PDF needs a parser
    that is not part of this package."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    fine = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("txt", "md")
    return d.withColumn("text", F.when(fine, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("unsupported document: "), F.col("path")))))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def strict_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every line that isn't blank as a VARIANT object; anything else is an error that shows the line."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    v = F.try_parse_json("value")
    fine = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return lines.select(F.when(fine, v).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200)))).alias("value"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus chunks. A missing id or text raises; ``require_rows`` guards against an empty corpus."""
    c = json_lines(spark, path, CORPUS)
    need = lambda name: F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"corpus row without {name}")))
    return c.withColumn("chunk_id", need("chunk_id")).withColumn("text", need("text"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def exam_files(spark: SparkSession, path: str) -> DataFrame:
    """Questions of exam files, one JSON document a file: ``exam`` (the file's name), ``payload``."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("exam"), F.col("value").alias("payload"))


def split_refs(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """``exam:id`` lines: ``exam``, ``qid``; split at the first colon, both halves stripped. Blank lines are skipped, lines
    that start with # too unless ``comments`` is off; lines without a colon are left out."""
    line = strip(F.col("value"))
    rows = spark.read.text(path).select(line.alias("l")).filter("l != ''")
    if comments:
        rows = rows.filter(~F.col("l").startswith("#"))
    parts = F.split("l", ":", 2)
    return rows.filter(F.size(parts) == 2).select(strip(parts[0]).alias("exam"), strip(parts[1]).alias("qid"))


def first_split_wins(splits: dict[str, DataFrame]) -> DataFrame:
    """References of several splits, each in the first split that names it."""
    parts = [df.select("exam", "qid", F.lit(i).alias("_o"), F.lit(name).alias("split")) for i, (name, df) in enumerate(splits.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("exam", "qid").agg(F.min_by("split", "_o").alias("split"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Per-query metrics in long form: run, epoch, pos, persona, metric, value. A log without them raises."""
    e = spark.read.schema(TRAINING_LOG).json(path, multiLine=True).select("run", F.explode("epoch_metrics").alias("e"))
    m = e.select("run", "e.epoch", "e.persona_ids", F.explode(F.when(F.col("e.per_query").isNotNull(), F.col("e.per_query")).otherwise(F.raise_error(F.lit("epoch without per-query metrics")).cast("map<string,array<double>>"))).alias("metric", "vals"))
    return m.select("run", "epoch", "metric", F.posexplode(F.arrays_zip("persona_ids", "vals")).alias("pos", "z")).select("run", "epoch", "pos", F.col("z.persona_ids").alias("persona"), "metric", F.col("z.vals").alias("value"))


def results_of_one_config(records: DataFrame, digest: str = "config_sha256", status: str = "status") -> DataFrame:
    """``records`` if they are all ``ok`` and of one configuration, else an error."""
    seen = records.agg(F.count_distinct(digest).alias("configs"), F.count_if(F.col(status) != "ok").alias("failed")).first()
    if seen.configs != 1 or seen.failed:
        raise ValueError(f"{seen.configs} configurations and {seen.failed} failed rows")
    return records


def scored_groups(rows: DataFrame, most: int, unknown: str = "skip") -> DataFrame:
    """Scored documents in long form from both formats: one document a line, or a list ``docs``. Rows of neither are left
    out, or with ``unknown`` = error end the job. Columns query, persona_id, chunk_id, document, score; groups keep their ``most`` best documents, groups of fewer
    than two are left out."""
    from pyspark.sql import Window

    new = F.col("docs").isNotNull()
    one = F.array(F.struct(F.lit(None).cast("string").alias("chunk_id"), F.col("document").alias("text"), F.col("score").alias("teacher_score")))
    docs = F.when(new, F.col("docs")).when(F.col("document").isNotNull() & F.col("score").isNotNull(), one)
    if unknown == "error":
        docs = F.coalesce(docs, F.raise_error(F.lit("row of neither format")).cast("array<struct<chunk_id: string, text: string, teacher_score: double>>"))
    flat = rows.select("query", "persona_id", F.explode(docs).alias("d")).select("query", "persona_id", "d.chunk_id", F.col("d.text").alias("document"), F.col("d.teacher_score").alias("score"))
    best = flat.groupBy("query", "persona_id", "document").agg(F.max("score").alias("score"), F.max("chunk_id").alias("chunk_id"))
    w = Window.partitionBy("query", "persona_id")
    ranked = best.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "document"))).filter(F.col("n") <= most)
    return ranked.withColumn("of", F.count("*").over(w)).filter("of >= 2").drop("n", "of")


def triplet_rows(rows: DataFrame, most: int) -> DataFrame:
    """Triplets with at most ``most`` negatives; rows without one are left out."""
    return rows.withColumn("negatives", F.slice("negatives", 1, most)).filter(F.size("negatives") > 0)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def config_digest(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def adapter_base(line: Column) -> Column:
    """The base model that an adapter's configuration names; null if it is absent or the JSON malformed."""
    return F.get_json_object(line, "$.base_model_name_or_path")


def lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index that ``sinks.write_lexical_index`` stored, for ``retrieval.search``."""
    lengths = spark.read.parquet(f"{path}/lengths")
    first = lengths.select("buckets").first()
    return LexicalIndex(spark.read.parquet(f"{path}/postings"), lengths.drop("buckets"), first.buckets if first else 1)


def index_count(index: LexicalIndex) -> int:
    """How many documents with terms the index holds."""
    return index.lengths.count()


def vector_table(spark: SparkSession, path: str) -> DataFrame:
    """Unit vectors and their payload as ``sinks.write_vectors`` stored them, for ``retrieval.dense_top_k``."""
    return spark.read.parquet(path)


def config_mapping(text: str, path: str = "") -> dict[str, Any]:
    """A configuration from JSON or, where a YAML parser is there, YAML text; anything but a mapping is an error."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ModuleNotFoundError:
            raise ValueError(f"{path or 'the configuration'} is no JSON, and there is no YAML parser") from None
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path or 'the configuration'} is no mapping")
    return found


def load_config(path: str, seed: bool = False) -> dict[str, Any]:
    """A configuration file on the driver; with ``seed``, its ``seed`` also seeds the generators of the driver."""
    with open(path, encoding="utf-8") as f:
        found = config_mapping(f.read(), path)
    if seed and found.get("seed") is not None:
        random.seed(found["seed"])
        np.random.seed(found["seed"])
    return found


OUTPUTS = "question_ref string, persona_id string, rewrite string, query string"
JUDGMENTS = "job_key string, model_left string, model_right string, candidate_a string, candidate_b string, question_ref string, persona_id string, winner string, status string"


def tournament_outputs(spark: SparkSession, run: str) -> DataFrame:
    """All candidates' outputs of a tournament run (outputs/<candidate>.jsonl): candidate, question_ref, persona_id,
    rewrite, query."""
    o = json_lines(spark, f"{run.rstrip('/')}/outputs", OUTPUTS)
    return o.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "").alias("candidate"), "question_ref", "persona_id", "rewrite", "query")


def tournament_judgments(spark: SparkSession, run: str) -> DataFrame:
    """The judgments of a run (judgments.jsonl) with ``result``, that of the left model, null without a verdict."""
    j = json_lines(spark, f"{run.rstrip('/')}/judgments.jsonl", JUDGMENTS)
    won = F.when(F.col("winner") == "A", F.col("candidate_a")).when(F.col("winner") == "B", F.col("candidate_b"))
    result = F.when(F.col("status") != "ok", None).when(F.col("winner") == "TIE", "tie").when(won == F.col("model_left"), "win").when(won == F.col("model_right"), "loss")
    return j.withColumn("result", result)


def tournament_manifests(spark: SparkSession, run: str) -> DataFrame:
    """What each candidate's outputs were made from (manifests/<candidate>.json): candidate, manifest as a VARIANT."""
    m = spark.read.text(f"{run.rstrip('/')}/manifests", wholetext=True)
    return m.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("candidate"), F.parse_json("value").alias("manifest"))


def tournament_summary(spark: SparkSession, run: str) -> DataFrame:
    """The run's summary.json as one VARIANT."""
    return spark.read.text(f"{run.rstrip('/')}/summary.json", wholetext=True).select(F.parse_json("value").alias("summary"))

"""Sinks: JSON lines with sorted keys, CSV reports, manifests, the lexical index and the vector table."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.preferences import candidate_dump
from ..operators.retrieval import bucket, postings, unit


def sorted_json(df: DataFrame) -> DataFrame:
    """One column ``value``: every row as JSON with its keys in order; nulls are written."""
    cols = sorted(df.columns)
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return where, where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, write) -> None:
    """Write aside, then put the new folder in the old one's place: ``write(writer, path)`` may read from ``path`` itself,
    and a job that fails leaves the old rows where they are."""
    where, fs = _files(df.sparkSession, path)
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    try:
        write(df.write, new)
    except BaseException:
        fs.delete(where(new), True)
        raise
    had = fs.exists(where(path))
    if had and not fs.rename(where(path), where(old)):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(where(new), where(path)):
        if had:
            fs.rename(where(old), where(path))
        raise OSError(f"could not put {new} in place")
    if had:
        fs.delete(where(old), True)


def overwrite_json(df: DataFrame, path: str) -> None:
    """Replace the folder by JSON lines with sorted keys, old rows staying until the new ones are written."""
    replace(sorted_json(df), path, lambda w, p: w.text(p))


def append_json(df: DataFrame, path: str) -> None:
    """Append in one atomic commit."""
    sorted_json(df).write.mode("append").text(path)


def csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report with a fixed header; a null becomes blank."""
    replace(df.select(*columns), path, lambda w, p: w.csv(p, header=True, nullValue=""))


def manifest(df: DataFrame, path: str, fields: dict[str, Any], counts: dict[str, Any]) -> None:
    """One row of settings and counts beside an output; ``counts`` are aggregate columns over ``df``."""
    row = df.agg(*(c.alias(n) for n, c in counts.items()))
    for name, value in fields.items():
        row = row.withColumn(name, F.lit(value if isinstance(value, str | int | float | bool) else json.dumps(value, sort_keys=True)))
    overwrite_json(row, path)


def write_lexical_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = 256) -> None:
    """Postings with places, partitioned by a hash of the term, so that a lookup reads few files, and the documents' lengths
    beside them. ``readers.lexical_index`` reads it back."""
    p = postings(docs, key, text).withColumn("bucket", bucket(F.col("term"), buckets))
    replace(p.repartition("bucket").sortWithinPartitions("bucket", "term"), f"{path}/postings", lambda w, to: w.partitionBy("bucket").parquet(to))
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    replace(stored.groupBy(key).agg(F.sum("tf").alias("len")).withColumn("buckets", F.lit(buckets)), f"{path}/lengths", lambda w, to: w.parquet(to))


def clear_index(spark: SparkSession, path: str) -> None:
    """Remove a stored index."""
    where, fs = _files(spark, path)
    fs.delete(where(path), True)


# The columns of the reports.
REPORTS = {
    "summary": ("arm", "persona", "judge", "metric", "mean", "sd", "n_valid", "n_failed"),
    "paired_deltas": ("comparison", "persona", "persona_split", "judge", "metric", "before", "after", "delta", "ci_lo", "ci_hi", "p", "p_holm", "n"),
    "judge_agreement": ("arm", "persona", "metric", "n", "exact_agreement_rate", "mean_abs_diff", "pearson_r"),
    "head_to_head": ("left", "right", "n", "missing", "left_wins", "ties", "left_losses", "left_score", "left_score_ci95", "sign_flip_p", "holm_p"),
}


def report(df: DataFrame, name: str, path: str, rename: dict[str, str] | None = None) -> None:
    """One of the ``REPORTS`` with exactly its columns in their order; ``rename`` maps columns of ``df`` to them. A column
    that is missing is an error. A report has a row a cell of an evaluation, so it is written as one file."""
    df = df.withColumnsRenamed(rename or {})
    if missing := [c for c in REPORTS[name] if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    csv_report(df.coalesce(1), path, list(REPORTS[name]))


def candidate_dumps(filtered: DataFrame, every: str, survivors: str) -> None:
    """All candidates with why they were dropped, and the survivors, as JSON lines."""
    dump, kept = candidate_dump(filtered)
    overwrite_json(dump, every)
    overwrite_json(kept, survivors)


def write_vectors(df: DataFrame, key: str, vector: str, path: str) -> None:
    """L2-normalised vectors with their payload columns."""
    df.withColumn(vector, unit(F.col(vector)).cast("array<float>")).sortWithinPartitions(key).write.mode("overwrite").parquet(path)

"""Queries on nested exam records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import nested
from ..session import table


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.tables(nested.flatten(table(spark, d, "exam_records")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Elements under questions and sub-questions."""
    return _tables(spark, d)["children"].select("record_id", "question_id", "child_kind", "child_no").distinct()


def p6_exams(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["exams"]


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["passages"]


def p6_questions(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["questions"]


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["children"]


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every payload with its parent, whatever the schema."""
    return nested.nodes(table(spark, d, "exam_records"))


QUERIES = {f.__name__: f for f in (p6_found, p6_exams, p6_passages, p6_questions, p6_children, p6_nodes)}
ORACLE: dict[str, str] = {}

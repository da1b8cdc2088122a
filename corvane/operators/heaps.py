"""Mergeable aggregates with bounded heaps, built before the shuffle and merged behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def smallest(value: Column, n: int) -> Column:
    """Aggregate: the ``n`` smallest values, ascending."""
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", value, F.lit(n), F.lit(True))


def largest(value: Column, n: int) -> Column:
    """Aggregate: the ``n`` largest values, descending."""
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", value, F.lit(n), F.lit(False))

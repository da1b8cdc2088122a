"""Joins by time and range, and an SQL entry point."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, into: str, bucket: str = "day") -> DataFrame:
    """``left`` with ``into``, the ``value`` of the latest row of ``right`` with equal keys at or before its ``time``; null if
    there is none. Of equal times the greatest value counts. Null keys and times match nothing.

    Rows are brought together by keys and time bucket, so that a key with any number of rows is spread over its buckets;
    only the last value of each bucket is carried into the next ones."""
    cols = left.columns
    row = F.struct(*(F.col(f"`{c}`") for c in cols))
    at = lambda d: F.date_trunc(bucket, d[time])
    a = left.select(*(left[k].alias(f"_k{i}") for i, k in enumerate(keys)), at(left).alias("_b"), left[time].alias("_t"), F.lit(1).alias("_s"), row.alias("_r"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    one = right.groupBy(*keys, time).agg(F.max(value).alias("_v")).filter(F.col(time).isNotNull() & F.col("_v").isNotNull())
    b = one.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.date_trunc(bucket, F.col(time)).alias("_b"), F.col(time).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(a.schema["_r"].dataType).alias("_r"), "_v")
    known = [f"_k{i}" for i in range(len(keys))]
    for k in known:
        b = b.filter(F.col(k).isNotNull())
    inside = Window.partitionBy(*known, "_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).filter("_s = 1")
    ends = b.groupBy(*known, "_b").agg(F.max_by("_v", "_t").alias("_e")).unionByName(a.select(*known, "_b").distinct().withColumn("_e", F.lit(None).cast(right.schema[value].dataType)))
    ends = ends.groupBy(*known, "_b").agg(F.max("_e").alias("_e"))
    before = Window.partitionBy(*known).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_c", F.last("_e", ignorenulls=True).over(before)).drop("_e")
    same = [both[k].eqNullSafe(carried[k]) for k in (*known, "_b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = both.join(carried, on, "left")
    fine = F.lit(True)
    for k in known:
        fine = fine & both[k].isNotNull()
    return out.select(*(F.col("_r")[c].alias(c) for c in cols), F.when(fine & F.col("_t").isNotNull(), F.coalesce("_own", "_c")).alias(into))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, seconds: int = 3_600) -> DataFrame:
    """Points with the intervals of their key that hold them, both ends included: all columns of both, the key once. An
    interval is matched in each of the buckets of ``seconds`` that it touches, a point in its own, so the join is on
    equal keys and buckets. Null keys, times and ends match nothing; an interval that ends before it starts is empty."""
    slot = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    i = intervals.filter(F.col(start) <= F.col(end)).withColumn("_slot", F.explode(F.sequence(slot(F.col(start)), slot(F.col(end)))))
    p = points.withColumn("_slot", slot(F.col(time)))
    return p.join(i, [key, "_slot"]).filter(F.col(time).between(F.col(start), F.col(end))).drop("_slot")


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """A temporary view for every Parquet table of a local folder; their names."""
    names = sorted(f.removesuffix(".parquet") for f in os.listdir(folder) if f.endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
    return names


def sql(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """A query over the tables of a folder by their names."""
    register_views(spark, folder)
    return spark.sql(query)


def sketch(df: DataFrame, by: list[str], distinct: str, value: str, error: float = 0.02) -> DataFrame:
    """Approximate figures that merge: distinct values within a relative standard error, and the median by rank within
    1 / 10,000 of the rows."""
    middle: Column = F.percentile_approx(value, 0.5, 10_000)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.approx_count_distinct(distinct, error).alias("distinct"), middle.alias("median"))

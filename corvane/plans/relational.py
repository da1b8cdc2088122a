"""Queries on joins by time and range, windows, cubes and sets over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational
from ..session import table

_SQL = """
select r_name, count(*) as customers, cast(round(sum(c_acctbal), 2) as double) as balance
from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by r_name"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it."""
    e = _events(spark, d)
    out = relational.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", "view_id")
    return out.select("event_id", "user_id", "view_id")


def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Events within six hours behind a user's signups, counted per signup."""
    e = _events(spark, d)
    spans = e.filter("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 6 hours")).alias("end"))
    j = relational.interval_join(e.filter("event_type != 'signup'"), spans, "user_id", "ts", "start", "end")
    return j.groupBy("signup_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def event_cube(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("part", F.col("user_id") % 3)
    return e.cube("event_type", "part").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Quartile of an event's value in its type, the user's value before it, and the type's values of the hour before it."""
    e = _events(spark, d)
    kind, user = Window.partitionBy("event_type").orderBy("value", "event_id"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    hour = Window.partitionBy("event_type").orderBy(F.unix_timestamp("ts")).rangeBetween(-3_600, 0)
    return e.select("event_id", F.ntile(4).over(kind).alias("quartile"), F.lag("value").over(user).alias("before"), F.count("*").over(hour).alias("in_hour"))


def event_sets(spark: SparkSession, d: str) -> DataFrame:
    """Users by how many more clicks than views they have, and how many of both they have together."""
    e = _events(spark, d)
    clicks, views = e.filter("event_type = 'click'").select("user_id"), e.filter("event_type = 'view'").select("user_id")
    more, common = clicks.exceptAll(views).withColumn("kind", F.lit("more clicks")), clicks.intersectAll(views).withColumn("kind", F.lit("common"))
    return more.unionByName(common).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


def sql_entry(spark: SparkSession, d: str) -> DataFrame:
    return relational.sql(spark, d, _SQL)


def event_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct users and median values per event type."""
    return relational.sketch(_events(spark, d), ["event_type"], "user_id", "value")


QUERIES = {f.__name__: f for f in (asof_join, interval_join, event_cube, event_windows, event_sets, sql_entry, event_sketch)}
ORACLE = {
    "asof_join": """
 with v as (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by 1, 2)
 select event_id, p.user_id, view_id from (select * from events where event_type = 'purchase') p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""",
    "interval_join": """
 select s.event_id as signup_id, count(*) as n, round(sum(e.value), 4) as value from events s join events e on e.user_id = s.user_id and e.ts between s.ts and s.ts + interval 6 hours
 where s.event_type = 'signup' and e.event_type != 'signup' group by 1""",
    "event_cube": "with e as (select *, user_id % 3 as part from events) select event_type, part, grouping_id(event_type, part) as level, count(*) as n, round(sum(value), 2) as value from e group by cube (event_type, part)",
    "event_windows": """
 select event_id, cast(ntile(4) over (partition by event_type order by value, event_id) as integer) as quartile, lag(value) over (partition by user_id order by ts, event_id) as before,
  count(*) over (partition by event_type order by cast(floor(epoch(ts)) as bigint) range between 3600 preceding and current row) as in_hour from events""",
    "event_sets": """
 with c as (select user_id from events where event_type = 'click'), v as (select user_id from events where event_type = 'view')
 select user_id, kind, count(*) as n from (select user_id, 'more clicks' as kind from (select * from c except all select * from v) union all select user_id, 'common' from (select * from c intersect all select * from v)) group by 1, 2""",
    "sql_entry": _SQL,
}

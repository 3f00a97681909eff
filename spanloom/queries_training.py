"""Queries of the general training-data problems, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.activity import sessions_by_gap
from spanloom.operators.packed import unpack_fields
from spanloom.operators.skew import fragment_replicate_join, heavy_keys, per_key, plan_loads
from spanloom.runtime import micros, read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions_by_gap(read(spark, d, "interactions"), "entity_id", "timestamp").select("entity_id", "start_us", "end_us")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Number, start, end, duration and row count of every session."""
    return sessions_by_gap(read(spark, d, "interactions"), "entity_id", "timestamp")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack_fields(read(spark, d, "items"), "meta_id", ["genres", "tags"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(read(spark, d, "interactions"), ["entity_id", "item_id"], 0.02).select("key_field", "key_id")


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: rows, different items, first and last time."""
    log = read(spark, d, "interactions").select("entity_id", "item_id", micros(F.col("timestamp")).alias("t"))
    return per_key(
        log, plan_loads(log, "entity_id"),
        {"n": F.count(F.lit(1)), "m": F.countDistinct("item_id"), "lo": F.min("t"), "hi": F.max("t")},
        {"n_rows": F.sum("n"), "n_items": F.sum("m"), "first_us": F.min("lo"), "last_us": F.max("hi")},
        spread_by=F.col("item_id"),
    )


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: rows, different entities, and the title of its first metadata row (null without one)."""
    log = read(spark, d, "interactions").select("item_id", "entity_id")
    meta = read(spark, d, "items").groupBy("item_id").agg(F.min_by("title", "meta_id").alias("title"))
    plan = plan_loads(log, "item_id")
    joined = fragment_replicate_join(log, meta, plan, "left", F.col("entity_id"), keep_place=True)
    return per_key(
        joined, plan,
        {"n": F.count(F.lit(1)), "m": F.countDistinct("entity_id"), "t": F.max("title")},
        {"n_rows": F.sum("n"), "n_entities": F.sum("m"), "title": F.max("t")},
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_sessions, p4_found, p6_found, p6_entities, p6_items)}

_P2 = """
with e as (select entity_id, epoch_us("timestamp") as t from interactions where "timestamp" is not null),
g as (select *, case when t - lag(t) over w <= 1800000000 then 0 else 1 end as s from e window w as (partition by entity_id order by t)),
n as (select *, sum(s) over (partition by entity_id order by t rows unbounded preceding) as session_no from g),
o as (select entity_id, cast(session_no as bigint) as session_no, min(t) as start_us, max(t) as end_us, max(t) - min(t) as duration_us, count(*) as n_events from n group by all)
"""
SQL: dict[str, str] = {
    "p2_found": _P2 + "select entity_id, start_us, end_us from o",
    "p2_sessions": _P2 + "select * from o",
    "p6_found": """
with n as (select count(*) as n from interactions)
select 'entity_id' as key_field, entity_id as key_id from interactions, n where entity_id is not null group by entity_id, n having count(*) >= 0.02 * n
union all select 'item_id', item_id from interactions, n where item_id is not null group by item_id, n having count(*) >= 0.02 * n""",
    "p6_entities": """select entity_id, count(*) as n_rows, count(distinct item_id) as n_items, min(epoch_us("timestamp")) as first_us, max(epoch_us("timestamp")) as last_us
from interactions group by entity_id""",
    "p6_items": """
with m as (select item_id, arg_min(title, meta_id) as title from items group by 1)
select item_id, count(*) as n_rows, count(distinct entity_id) as n_entities, max(title) as title from interactions left join m using (item_id) group by item_id""",
}

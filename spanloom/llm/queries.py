"""Queries of the training-data problems tagged llm, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.cooccurrence import items_together
from spanloom.llm.fusion import fuse_rankings
from spanloom.llm.leakage import leaked_items
from spanloom.llm.overlap import cross_split_overlaps, overlap_report
from spanloom.llm.packing import pack_all, token_counts
from spanloom.llm.sentences import sentence_units
from spanloom.llm.topn import top_n_per_group
from spanloom.runtime import read, stage


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(read(spark, d, "recommendations"), "entity_id", "item_id", "score", 5).select("entity_id", "rank_no", "item_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_overlaps(read(spark, d, "split_records"))
    return pairs.select(F.least("train_id", "test_id").alias("id_a"), F.greatest("train_id", "test_id").alias("id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source: records, records that overlap the other split, and pairs they are in."""
    return overlap_report(read(spark, d, "split_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "interactions").where("session_id <> 0")
    pairs = items_together(log, ["entity_id", "session_id"], "item_id", "loaded_at", min_together=5)
    # in whole numbers, as n_ab * n may pass 2^53
    return pairs.where(F.expr("cast(n_ab as decimal(38,0)) * n >= cast(4 * n_a as decimal(20,0)) * n_b")).select("item_a", "item_b")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    state = F.broadcast(read(spark, d, "engine_state").select("run_id", "trend_alpha", "user_cf_alpha", "transition_alpha"))  # a row per run
    scores = read(spark, d, "channel_scores").join(state, "run_id", "left")
    weights = {"trend_score": F.col("trend_alpha"), "user_cf_score": F.col("user_cf_alpha"), "transition_score": F.col("transition_alpha")}
    return fuse_rankings(scores, "list_id", "item_id", weights)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where("rank_no = 1").select("list_id", "item_id")


def p7_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The whole fused order of every list."""
    return _fused(spark, d).select("list_id", "item_id", F.round("fused_score", 9).alias("fused_score"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where every post goes for each container size."""
    return pack_all(read(spark, d, "documents"), read(spark, d, "pack_targets"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per container size: documents placed, and what may not be: overfull containers, small documents divided, tokens lost or doubled."""
    docs, targets = read(spark, d, "documents"), read(spark, d, "pack_targets")
    sizes = stage(token_counts(docs))
    size, total = stage(pack_all(docs, targets, sizes=sizes)), sizes.agg(F.sum("n_tokens").alias("total"))
    full = size.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("fill")).join(targets, "target_id")
    full = full.groupBy("target_id").agg(F.count_if(F.col("fill") > F.col("capacity_tokens")).alias("overfull"), (F.sum("fill") >= 0.99 * F.sum("capacity_tokens")).alias("filled_99"), F.sum("fill").alias("placed"))
    placed = size.groupBy("target_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).join(sizes, "doc_id").join(targets, "target_id")
    placed = placed.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("pieces") != F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))).alias("wrongly_divided"), F.count_if(F.col("n") != F.col("n_tokens")).alias("wrong_tokens")
    )
    both = placed.join(full, "target_id").crossJoin(F.broadcast(total))  # one row
    return both.select("target_id", "n_docs", "overfull", "wrongly_divided", "wrong_tokens", (F.col("total") - F.col("placed")).alias("lost_tokens"), "filled_99")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "eval_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per test item that leaked: documents that hold a passage of it, and the longest overlap in runs."""
    return leaked_items(read(spark, d, "documents"), read(spark, d, "eval_items")).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("matched_runs").alias("most_runs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(read(spark, d, "documents")).select("doc_id", "end_pos")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p3_found, p3_report, p5_found, p7_found, p7_rankings, p8_containers, p8_invariants, p9_found, p9_report, p10_found)
}

_P3 = """
with r as (
  select record_id, source, split, epoch_us("timestamp") as t, rating,
    regexp_replace(regexp_replace(lower(entity_id), '[^a-z0-9]+', '', 'g'), '(^|[a-z])0+([0-9])', '\\1\\2', 'g') as e,
    regexp_replace(regexp_replace(lower(item_id), '[^a-z0-9]+', '', 'g'), '(^|[a-z])0+([0-9])', '\\1\\2', 'g') as i,
    list_distinct(regexp_extract_all(lower(remark), '[a-z0-9]+')) as w
  from split_records),
pairs as (
  select a.record_id as x, b.record_id as y from r a join r b on a.split = 'train' and b.split = 'test'
    and a.source = b.source and a.e = b.e and a.i = b.i and abs(a.t - b.t) <= 300000000
    and (a.rating is null or b.rating is null or abs(a.rating - b.rating) <= 0.5)
  union
  select a.record_id, b.record_id from r a join r b on a.split = 'train' and b.split = 'test' and len(a.w) >= 8 and len(b.w) >= 8
    and least(len(a.w), len(b.w)) >= 0.6 * greatest(len(a.w), len(b.w))
    and len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9)
"""
_P7 = """
with c as (
  select list_id, run_id, item_id, max(case when isnan(trend_score) then null else trend_score end) as a,
    max(case when isnan(user_cf_score) then null else user_cf_score end) as b, max(case when isnan(transition_score) then null else transition_score end) as c
  from channel_scores where item_id is not null group by all),
f as (
  select list_id, item_id, coalesce(trend_alpha, 0) as wa, coalesce(user_cf_alpha, 0) as wb, coalesce(transition_alpha, 0) as wc,
    coalesce(a, min(a) over l) as a, coalesce(b, min(b) over l) as b, coalesce(c, min(c) over l) as c,
    max(a) over l is not distinct from min(a) over l as fa, max(b) over l is not distinct from min(b) over l as fb, max(c) over l is not distinct from min(c) over l as fc
  from c left join engine_state using (run_id) window l as (partition by list_id)),
s as (
  select list_id, item_id,
    case when fa then 0.0::double else wa / (60.0::double + rank() over (partition by list_id order by a desc nulls last)) end
    + case when fb then 0.0::double else wb / (60.0::double + rank() over (partition by list_id order by b desc nulls last)) end
    + case when fc then 0.0::double else wc / (60.0::double + rank() over (partition by list_id order by c desc nulls last)) end as fused_score
  from f)
"""
SQL: dict[str, str] = {
    "p1_found": """
with c as (
  select entity_id, item_id, max(case when score = 0 then 0.0 else score end) as s from recommendations
  where score is not null and not isnan(score) and not isinf(score) and item_id is not null group by all),
r as (select entity_id, item_id, row_number() over (partition by entity_id order by s desc, item_id) as rn from c)
select entity_id, cast(rn as integer) as rank_no, item_id from r where rn <= 5""",
    "p3_found": _P3 + "select least(x, y) as id_a, greatest(x, y) as id_b from pairs",
    "p3_report": _P3
    + """, s as (select x as record_id from pairs union all select y from pairs), n as (select record_id, count(*) as c from s group by 1)
select split, source, count(*) as n_records, count(c) as n_overlapping, cast(coalesce(sum(c), 0) as bigint) as n_pairs
from split_records left join n using (record_id) group by all""",
    "p5_found": """
with m as (select distinct entity_id, session_id, item_id from interactions where session_id <> 0 and entity_id is not null and item_id is not null),
n as (select count(*) as n from (select distinct entity_id, session_id from m)),
c as (select item_id, count(*) as n from m group by 1),
p as (select a.item_id as item_a, b.item_id as item_b, count(*) as n_ab from m a join m b using (entity_id, session_id) where a.item_id < b.item_id group by all having count(*) >= 5)
select item_a, item_b from p join c x on x.item_id = item_a join c y on y.item_id = item_b, n where n_ab * n.n >= 4 * x.n * y.n""",
    "p7_found": _P7 + "select list_id, item_id from (select list_id, item_id, row_number() over (partition by list_id order by fused_score desc, item_id) as rn from s) where rn = 1",
    "p8_invariants": """
select target_id, (select count(distinct doc_id) from documents where text <> '') as n_docs, 0::bigint as overfull, 0::bigint as wrongly_divided, 0::bigint as wrong_tokens, 0::bigint as lost_tokens, true as filled_99
from pack_targets""",
    "p7_rankings": _P7 + "select list_id, item_id, round(fused_score, 9) as fused_score from s",
}

"""Queries of the recommendation operators over views of the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import decay
from spanloom.operators import channels as ch
from spanloom.operators import contract as ct
from spanloom.operators import edges as ed
from spanloom.operators import evaluate as ev
from spanloom.operators import features as ft
from spanloom.operators import profile as pf
from spanloom.operators import repeat as rp
from spanloom.operators.activity import label_sessions
from spanloom.operators.ease import fit_ease
from spanloom.operators.infer_sessions import cart_outcomes, infer_sessions
from spanloom.operators.pairs import cooc_edges
from spanloom.plans import score as sc
from spanloom.plans import packed as pk
from spanloom.runtime import cut, read, seconds, stage
from spanloom.sources.loaders import latest_property

#: EASE is solved on one machine; its queries take the event log (100 items) at every scale.
TOP, BUDGET = 10, 500


# ---------------------------------------------------------------- views of the test tables


def ix_orders(spark: SparkSession, d: str) -> DataFrame:
    """entity = customer, item = part, session = order, time = ship date, rating from the quantity."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("entity_id"), F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_orderkey").alias("session_id"),
        (1 + F.pmod(F.col("l_quantity").cast("int"), F.lit(5))).cast("double").alias("rating"),
    )


def ix_events(spark: SparkSession, d: str) -> DataFrame:
    """entity = user, item = the number in props, time = ts."""
    return read(spark, d, "events").select(
        F.col("user_id").alias("entity_id"), F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), F.col("ts").alias("timestamp"), "event_type", "event_id"
    )


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    return ct.to_log(ix_orders(spark, d).drop("rating"))


def rated_log(spark: SparkSession, d: str) -> DataFrame:
    return ct.to_log(ix_orders(spark, d))


def events_log(spark: SparkSession, d: str) -> DataFrame:
    return ct.to_log(ix_events(spark, d).select("entity_id", "item_id", "timestamp"))


def meta_part(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_IXO = """ixo as (select o_custkey as entity_id, l_partkey as item_id, l_orderkey as session_id, epoch_us(l_shipdate) / 1000000.0 as ts,
  1.0::double as weight, 1 + cast(l_quantity as integer) % 5 as rating from lineitem join orders on l_orderkey = o_orderkey)"""
_IXE = """ixe as (select user_id as entity_id, cast(json_extract_string(props, '$.k') as bigint) as item_id, epoch_us(ts) / 1000000.0 as ts, cast(null as bigint) as session_id,
  1.0::double as weight, event_type from events)"""
_O, _E = f"with {_IXO} ", f"with {_IXE} "
_W = "least(1.0, greatest(0.0, (rating - 2.5) / 2.5))"

# ---------------------------------------------------------------- contract and profile


@query(_O + "select count(*) as n_rows, 0::bigint as null_entity, 0::bigint as null_item, 0::bigint as bad_timestamp, 0::bigint as unknown_action, 0::bigint as null_session from ixo")
def validation_counts(spark, d):
    return ct.violations(ix_orders(spark, d))


@query(
    """select count(*) as n_rows, count(*) filter (entity_id is null) as null_entity, count(*) filter (item_id is null) as null_item, count(*) filter ("timestamp" is null) as bad_timestamp,
count(*) filter (action_type is not null and action_type not in ('add','remove','positive_rating','negative_rating','rate','view','review','purchase','checkin')) as unknown_action, count(*) filter (session_id is null) as null_session from interactions"""
)
def validation_counts_raw(spark, d):
    """The same over the raw log, which has nulls and actions of its own."""
    return ct.violations(read(spark, d, "interactions"))


@query(_O + f"select rating::double as rating, round({_W}, 6) as weight, count(*) as n from ixo group by all")
def interaction_weights(spark, d):
    return ct.weighted(ix_orders(spark, d)).groupBy("rating", r6("weight")).agg(F.count(F.lit(1)).alias("n"))


@query(_O + "select count(*) as n_rows, count(distinct (entity_id, item_id)) as n_pairs, round(1 - count(distinct (entity_id, item_id)) / count(*), 6) as repeat_rate from ixo")
def repeat_rate_profile(spark, d):
    return pf.repeat_rate(orders_log(spark, d)).select("n_rows", "n_pairs", r6("repeat_rate"))


@query(
    _E
    + """, x as (select ts - lag(ts) over (partition by entity_id order by ts) as delta from ixe)
select count(delta) as n_deltas, round(median(delta), 3) as median_delta, median(delta) < 300 as is_burst from x"""
)
def burst_profile(spark, d):
    return pf.burst(events_log(spark, d)).select("n_deltas", F.round("median_delta", 3).alias("median_delta"), "is_burst")


@query(_O + ", s as (select session_id, count(distinct item_id) as m from ixo group by 1) select count(*) as n_sessions, round(avg(case when m >= 2 then 1.0 else 0.0 end), 6) as deep_session_fraction from s")
def deep_session_fraction(spark, d):
    return pf.deep_sessions(orders_log(spark, d)).select("n_sessions", r6("deep_session_fraction"))


@query(
    _O
    + """select count(*) as n_rows, count(distinct entity_id) as n_users, count(distinct item_id) as n_items,
round(count(*) / (count(distinct entity_id) * count(distinct item_id)::double), 9) as density, round(count(*) / count(distinct entity_id)::double, 6) as avg_per_user from ixo"""
)
def log_shape(spark, d):
    return pf.shape(orders_log(spark, d)).select("n_rows", "n_users", "n_items", F.round("density", 9).alias("density"), r6("avg_per_user"))


@query(_O + ", n as (select count(*) as n from ixo group by entity_id) select median(n) as median_history from n")
def history_median(spark, d):
    return pf.median_history(orders_log(spark, d))


@query(
    _O
    + """, p as (select rating::double as v from ixo where rating > 0),
a as (select count(*) as n, count(distinct v) as n_distinct, avg(v) as m, stddev_pop(v) as s, quantile_cont(v, 0.5) as q5, quantile_cont(v, 0.99) as q99, max(v) as hi from p)
select case when n_distinct <= 1 or s / m < 0.05 then 'binary' when q5 > 0 and q99 / q5 > 10 then 'counts' when hi <= 10 and n_distinct >= 3 then 'ratings' else 'counts' end as signal, n, n_distinct from a"""
)
def rating_signal(spark, d):
    return pf.rating_signal(ix_orders(spark, d), "rating")


@query(_O + ", i as (select distinct item_id from ixo) select item_id, row_number() over (order by item_id) - 1 as item_idx, true as is_train from i")
def catalog_index(spark, d):
    return ct.catalog(orders_log(spark, d))


@query(
    _O
    + """, i as (select distinct item_id from ixo), x as (select p_partkey as item_id from part where p_partkey not in (select item_id from i)),
u as (select item_id, row_number() over (order by item_id) - 1 as item_idx, true as is_train from i
union all select item_id, row_number() over (order by item_id) - 1 + (select count(*) from i), false from x) select * from u"""
)
def open_catalog_extension(spark, d):
    return ct.catalog(orders_log(spark, d), meta_part(spark, d))


@query(_O + "select entity_id, item_id, session_id, row_number() over (partition by entity_id order by ts, session_id, item_id, weight)::integer as pos from ixo")
def history_order(spark, d):
    return ct.history(orders_log(spark, d)).select("entity_id", "item_id", "session_id", "pos")


# ---------------------------------------------------------------- edges

_G = ", g as (select entity_id as k, item_id, sum(weight) as w from ixo group by all)"
_PAIRS = _G + ", p as (select a.item_id as i, b.item_id as j, sum(a.w * b.w) as w from g a join g b on a.k = b.k and a.item_id < b.item_id group by all)"


@query(_O + _PAIRS + " select i, j, w from p")
def cooc_pure_count(spark, d):
    return ed.cooc_counts(orders_log(spark, d))


@query(_O + ", g as (select session_id as k, item_id, sum(weight) as w from ixo group by all) select a.item_id as i, b.item_id as j, sum(a.w * b.w) as w from g a join g b on a.k = b.k and a.item_id < b.item_id group by all")
def cooc_session(spark, d):
    return ed.cooc_counts(orders_log(spark, d), "session_id")


_TEMP = "select a.item_id as i, b.item_id as j, sum(1 + 1 / (1 + exp(abs(a.ts - b.ts)::double / 2592000))) as w from {x} a join {x} b on a.entity_id = b.entity_id and a.item_id < b.item_id group by all"


@query(_O + ", p as (" + _TEMP.format(x="ixo") + ") select i, j, round(w, 6) as w from p")
def cooc_hybrid_temporal(spark, d):
    return ed.cooc_temporal(orders_log(spark, d)).select("i", "j", r6("w"))


_M = ", m as (select item_id, greatest(count(*), 1)::double as n from ixo group by 1), e as (select p.*, x.n as ni, y.n as nj from p join m x on x.item_id = i join m y on y.item_id = j)"
_LB = "((least(w / {n}, 1.0) + 3.8416 / (2 * {n}) - 1.96 * sqrt(least(w / {n}, 1.0) * (1 - least(w / {n}, 1.0)) / {n} + 3.8416 / (4 * {n} * {n}))) / (1 + 3.8416 / {n}))"


def _transform(how: str, expr: str) -> None:
    def f(spark, d):
        log = stage(orders_log(spark, d).select("entity_id", "item_id", "weight"))
        return cooc_edges(log, how).select("i", "j", r6("w"))

    f.__name__ = f"cooc_transform_{how}"
    query(_O + _PAIRS + _M + f" select i, j, round({expr}, 6) as w from e")(f)


_transform("cosine", "w / sqrt(ni * nj)")
_transform("jaccard", "w / greatest(ni + nj - w, 1.0)")
_transform("wilson", f"least({_LB.format(n='ni')}, {_LB.format(n='nj')})")

_MAXG = f", x as (select entity_id, item_id, max({_W}) as x from ixo group by all having max({_W}) > 0), p as (select a.item_id as i, b.item_id as j, sum(a.x * b.x) as w from x a join x b on a.entity_id = b.entity_id and a.item_id < b.item_id group by all)"


@query(_O + _MAXG + " select i, j, round(w, 6) as w from p")
def item_graph_max_weight(spark, d):
    return ed.ItemGraph.build(rated_log(spark, d)).edges.select("i", "j", r6("w"))


@query(
    _O
    + _MAXG
    + """, b as (select i, j, w from p union all select j, i, w from p), r as (select i, j, w, row_number() over (partition by i order by round(w, 9) desc, j) as rank from b)
select i, j, round(w, 6) as w, rank::integer as rank from r where rank <= 10"""
)
def item_graph_neighbors(spark, d):
    g = ed.ItemGraph(ed.ItemGraph.build(rated_log(spark, d)).edges.withColumn("w", F.round("w", 9)))
    return g.neighbors(10).select("i", "j", r6("w"), "rank")


_STEP = """, s as (select item_id as i, lead(item_id) over w as j, weight * lead(weight) over w as p from {x} where weight > 0 window w as (partition by entity_id order by ts, session_id, item_id, weight)),
t as (select i, j, sum(p) as w from s where j is not null and i <> j group by all)"""


@query(_O + _STEP.format(x="ixo") + " select i, j, w from t")
def directional_cooc(spark, d):
    return ed.transitions(orders_log(spark, d))


@query(_O + _STEP.format(x="ixo") + ", b as (select i, j, w from t union all select j, i, w from t) select i, j, sum(w) as w from b group by all")
def symmetrized_transitions(spark, d):
    return ed.symmetrized(ed.transitions(orders_log(spark, d)))


@query(_O + ", x as (select distinct entity_id, item_id from ixo) select a.item_id as i, b.item_id as j, count(*)::double as w from x a join x b on a.entity_id = b.entity_id and a.item_id <= b.item_id group by all")
def gram_binary(spark, d):
    return ed.gram(orders_log(spark, d))


@query(_O + _MAXG.replace("a.item_id < b.item_id", "a.item_id <= b.item_id") + " select i, j, round(w, 6) as w from p")
def gram_rating_weighted(spark, d):
    return ed.gram(rated_log(spark, d), use_weights=True).select("i", "j", r6("w"))


@query()
def ease_weights(spark, d):
    log = events_log(spark, d)
    return fit_ease(log).edges(log).select("i", "j", r6("w"))


# ---------------------------------------------------------------- channels


@query(_O + "select item_id, count(*) as n from ixo group by 1")
def popularity(spark, d):
    return ch.popularity(orders_log(spark, d))


@query("with i as (select p_partkey as item_id from part), n as (select l_partkey as item_id, count(*) as n from lineitem group by 1) select item_id, round(greatest(0.0, least(1.0, 1 - coalesce(n, 0) / 20.0)), 6)::double as coldness from i left join n using (item_id)")
def coldness(spark, d):
    items = ch.popularity(orders_log(spark, d), meta_part(spark, d))
    return items.select("item_id", F.round(ch.coldness(F.col("n")), 6).alias("coldness"))


_TREND = """, h as (select min(ts) as lo, max(ts) as hi from {x}), c as (select item_id, sum(case when ts >= hi - (hi - lo) * 0.10 then 1 else 0 end) as n_recent from {x}, h group by 1),
tz as (select item_id, n_recent::bigint as n_recent, (n_recent - avg(n_recent) over ()) / stddev_pop(n_recent) over () as trend_z from c)"""


@query(_O + _TREND.format(x="ixo") + " select item_id, n_recent, round(trend_z, 6) as trend_z from tz")
def trend_z(spark, d):
    log = orders_log(spark, d)
    return ch.trend(log, log).select("item_id", "n_recent", r6("trend_z"))


@query(_O + ", r as (select *, row_number() over (partition by entity_id order by ts desc, session_id desc, item_id desc) as rn from ixo) select entity_id, item_id from r where rn = 1")
def last_item(spark, d):
    return ch.last_items(orders_log(spark, d)).select("entity_id", "item_id")


_VOTE = """, r as (select entity_id, item_id, row_number() over (partition by entity_id order by ts desc, session_id desc, item_id desc, weight desc) - 1 as age from {x}),
v as (select entity_id, t.j as item_id, sum(pow(0.7, age) * t.w) as trans from r join t on t.i = r.item_id where age < 5 group by all)"""


@query(_O + _STEP.format(x="ixo") + _VOTE.format(x="ixo") + " select entity_id, item_id, round(trans, 6) as trans from v")
def transition_vote(spark, d):
    log = orders_log(spark, d)
    return ch.transition_votes(log, ed.transitions(log)).select("entity_id", "item_id", r6("trans"))


_UCF = """, hi as (select entity_id, item_id, count(*) as cnt from ixe group by all), dg as (select entity_id, count(*) as deg, sum(cnt) as len from hi group by 1),
ov as (select a.entity_id, b.entity_id as neighbor, sum(a.cnt) as overlap from hi a join hi b on a.item_id = b.item_id and a.entity_id <> b.entity_id group by all),
sm as (select ov.*, overlap / (sqrt(x.deg) * sqrt(y.len)) as sim from ov join dg x on x.entity_id = neighbor join dg y on y.entity_id = ov.entity_id),
nb as (select *, row_number() over (partition by entity_id order by sim desc, neighbor) as rank from sm)"""


@query(_E + _UCF + " select entity_id, neighbor, overlap::bigint as overlap, round(sim, 6) as sim, rank::integer as rank from nb where rank <= 100")
def user_cf_neighbors(spark, d):
    log = events_log(spark, d)
    return pk.user_neighbors(ch.multiplicity(log), log.select("entity_id", "item_id").distinct()).select("entity_id", "neighbor", "overlap", r6("sim"), "rank")


@query(_E + _UCF + " select nb.entity_id, hi.item_id, round(sum(sim), 6) as ucf from nb join hi on hi.entity_id = nb.neighbor where rank <= 100 group by all")
def user_cf_scores(spark, d):
    log = events_log(spark, d)
    pairs = log.select("entity_id", "item_id").distinct()
    return ch.user_cf(pk.user_neighbors(ch.multiplicity(log), pairs), pairs).select("entity_id", "item_id", r6("ucf"))


_FEAT = """with q as (select quantile_cont(p_size, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]) as qs, quantile_cont(p_retailprice, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]) as qp from part),
raw as (select p_partkey as item_id, 'p_name=' || lower(trim(p_name)) as feature from part union all select p_partkey, 'p_brand=' || lower(trim(p_brand)) from part union all select p_partkey, 'p_type=' || lower(trim(p_type)) from part
union all select p_partkey, 'p_size=bin' || len([x for x in list_distinct(qs) if x < p_size]) from part, q
union all select p_partkey, 'p_retailprice=bin' || len([x for x in list_distinct(qp) if x < p_retailprice]) from part, q),
nn as (select count(*) as n from part), df as (select feature, count(distinct item_id) as df from raw, nn group by feature, n having count(distinct item_id) >= 2 and count(distinct item_id) <= greatest(n // 2, 1)),
idf as (select feature, ln((1 + n) / (1.0 + df)) + 1 as idf from df, nn), wr as (select item_id, raw.feature, idf from raw join idf using (feature)),
f as (select item_id, feature, idf / sqrt(sum(idf * idf) over (partition by item_id)) as w from wr)
"""


def part_features(spark, d):
    """Features of all columns of the parts: name, brand, type, size and price."""
    return ft.item_features(meta_part(spark, d))


@query(_FEAT + "select item_id, feature, round(w, 6) as w from f")
def content_features(spark, d):
    return part_features(spark, d).select("item_id", "feature", r6("w"))


@query()
def text_features(spark, d):
    """Features of the items' metadata, whose titles, genres, tags and release dates take the text role."""
    return ft.item_features(read(spark, d, "items").drop("meta_id")).select("item_id", "feature", r6("w"))


@query(
    _FEAT
    + f", {_IXO}"
    + """, hi as (select entity_id, item_id, count(*) as cnt from ixo group by all), pr as (select entity_id, feature, sum(cnt * w) as p from hi join f using (item_id) group by all)
select entity_id, item_id, round(sum(p * w), 6) as content from pr join f using (feature) group by all"""
)
def content_scores(spark, d):
    return pk.content_scores(ch.multiplicity(orders_log(spark, d)), stage(part_features(spark, d)), 6)


_KNN = """, sm as (select a.item_id as i, b.item_id as j, sum(a.w * b.w) as sim from f a join f b on a.feature = b.feature and a.item_id <> b.item_id group by all),
kn as (select i, j, sim, row_number() over (partition by i order by round(sim, 9) desc, j) as rank from sm where sim > 0)"""


@query(_FEAT + _KNN + "select i, j, round(sim, 6) as sim, rank::integer as rank from kn where rank <= 20")
def metadata_knn(spark, d):
    return pk.nearest_items(stage(part_features(spark, d)), 20).select("i", "j", r6("sim"), "rank")


@query(
    _FEAT
    + _KNN
    + f", {_IXO} {_PAIRS}"
    + """, b as (select i, j, w from p union all select j, i, w from p), e as (select kn.i, kn.j, sim, coalesce(w, 0) as t from kn left join b on b.i = kn.i and b.j = kn.j where rank <= 20)
select round(regr_slope(t, sim), 6) as slope, round(regr_intercept(t, sim), 6) as intercept, count(*) as n from e"""
)
def smoothing_dose_ols(spark, d):
    log = stage(orders_log(spark, d).select("entity_id", "item_id", "weight"))
    near = pk.nearest_items(stage(part_features(spark, d)), 20).select("i", "j", "sim")
    fit = ft.fit_rows(stage(pk.dose_rows(near, log)), "ols")
    return spark.createDataFrame([(round(fit["slope"], 6), round(fit["intercept"], 6), fit["n"])], "slope double, intercept double, n bigint")


@query(
    """with r as (select o_orderkey as item_id, (epoch_us(max(o_orderdate) over ()) - epoch_us(o_orderdate)) / 86400000000.0 as d from orders)
select item_id, round(max(exp(-floor(d) / 180)), 6) as recency from r group by 1"""
)
def release_recency(spark, d):
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("released"))
    return ft.release_recency(items).select("item_id", r6("recency"))


# ---------------------------------------------------------------- repeats

_REP = """, s as (select entity_id, item_id, ts, ts - lag(ts) over (partition by entity_id, item_id order by ts) as gap from ixe),
rp as (select entity_id, item_id, count(*) as cnt, max(ts) as last_ts, count(*) filter (gap > 0) as n_gaps, median(gap) filter (gap > 0) as period, case when count(*) filter (gap > 0) > 0 then 0.3 else 0.0 end as quality
from s group by all having count(*) >= 2)"""


@query(_E + _REP + "select entity_id, item_id, cnt, n_gaps::integer as n_gaps, round(period, 3)::double as period, quality::double as quality from rp where n_gaps < 10")
def repeat_profile_median(spark, d):
    p = rp.repeat_profile(events_log(spark, d))
    return p.select("entity_id", "item_id", "cnt", "n_gaps", F.round("period", 3).alias("period"), "quality")


@query()
def repeat_profile_density(spark, d):
    p = rp.repeat_profile(events_log(spark, d).withColumn("item_id", F.pmod("item_id", F.lit(5)))).where("n_gaps >= 10")
    return p.select("entity_id", "item_id", "cnt", "n_gaps", F.round("period", 1).alias("period"), F.round("quality", 3).alias("quality"))


@query(
    _E
    + _REP
    + """, nw as (select max(ts) as now from ixe)
select entity_id, item_id, round(case when period is null then 1.0 else quality * (1 / (1 + exp(-6.0 * (greatest(now - last_ts, 0)::double / greatest(period, 1e-9) - 0.7)))) + 1 - quality end, 6) as multiplier from rp, nw where n_gaps < 10"""
)
def repeat_multiplier(spark, d):
    log = events_log(spark, d)
    now = log.agg(F.max("ts")).first()[0] or 0.0
    p = rp.repeat_profile(log)
    return p.select("entity_id", "item_id", F.round(rp.repeat_multiplier(F.lit(now) - F.col("last_ts"), F.col("period"), F.col("quality")), 6).alias("multiplier"))


# ---------------------------------------------------------------- scoring

_WIL = _PAIRS + _M + f", wl as (select i, j, least({_LB.format(n='ni')}, {_LB.format(n='nj')}) as w from e), wb as (select i, j, w from wl union all select j, i, w from wl)"
_HIST = ", hi as (select entity_id, item_id, count(*) as cnt from ixo group by all)"
_BASE = ", bs as (select entity_id, j as item_id, sum(cnt * w) as base from hi join wb on wb.i = hi.item_id group by all)"


def _wilson_half(log: DataFrame) -> DataFrame:
    return cooc_edges(log, "wilson")


def _wilson(log: DataFrame) -> DataFrame:
    return ed.mirrored(_wilson_half(log))


@query(
    _O
    + _WIL
    + _HIST
    + _BASE
    + """, mk as (select bs.* from bs anti join hi using (entity_id, item_id)), r as (select *, row_number() over (partition by entity_id order by round(base, 9) desc, item_id) as rank from mk where base > 0)
select entity_id, rank::integer as rank, item_id, round(base, 6) as score from r where rank <= 10"""
)
def base_scores_topk(spark, d):
    log = stage(orders_log(spark, d).select("entity_id", "item_id", "weight"))
    top = pk.top_by_log(log, log, "wilson", TOP)
    top = pk.top_by_edges(log, _wilson_half(log), TOP) if top is None else top
    return top.select("entity_id", "rank", "item_id", r6("score"))


@query(
    _O
    + _WIL
    + _HIST
    + _BASE
    + """, mk as (select bs.* from bs anti join hi using (entity_id, item_id)), r as (select *, row_number() over (partition by entity_id order by round(base, 9) desc, item_id) as rank from mk where base > 0)
select entity_id, rank::integer as rank, item_id, round(base, 6) as score, 'cooc' as base_kind from r where rank <= 10"""
)
def engine_topk(spark, d):
    """The engine itself: fit on the log without times (Wilson co-occurrence alone), lists for all entities."""
    from spanloom.plans.engine import Engine

    engine = Engine(base_scorer="cooc", repeat_recommend=False).fit(ix_orders(spark, d).select("entity_id", "item_id"))
    return engine.recommend_batch(n=TOP).select("entity_id", "rank", "item_id", r6("score"), "base_kind")


@query(
    _E
    + (_WIL + _HIST + _BASE).replace("ixo", "ixe")
    + _REP
    + """, nw as (select max(ts) as now from ixe),
du as (select rp.entity_id, rp.item_id, (coalesce(base, 0) + 50 * ln(1 + rp.cnt)) * case when period is null then 1.0
  else quality * (1 / (1 + exp(-6.0 * (greatest(now - last_ts, 0)::double / greatest(period, 1e-9) - 0.7)))) + 1 - quality end as score from rp left join bs using (entity_id, item_id), nw),
al as (select entity_id, item_id, base as score from bs anti join hi using (entity_id, item_id) union all select * from du),
r as (select *, row_number() over (partition by entity_id order by round(score, 9) desc, item_id) as rank from al where score > 0)
select entity_id, rank::integer as rank, item_id, round(score, 6) as score from r where rank <= 10"""
)
def repeat_resurface(spark, d):
    """Lists in which repeat items come back at their affinity and frequency, by how due they are."""
    log = stage(events_log(spark, d))
    scores = stage(ch.base_scores(ch.multiplicity(log), _wilson(log)).withColumnRenamed("base", "score"))
    now = log.agg(F.max("ts")).first()[0] or 0.0
    due = rp.due_items(rp.repeat_profile(log), scores, now)
    pooled = sc.pool(sc.mask_owned(scores, log, due), BUDGET)
    return sc.top_n(pooled.withColumn("composite", F.col("score")), TOP, "cooc").select("entity_id", "rank", "item_id", r6("score"))


# the whole user x catalog square, zeros written out
_SQUARE = """, us as (select distinct entity_id from ixo), it as (select distinct item_id from ixo),
sq as (select us.entity_id, it.item_id, coalesce(base, 0) as base, coalesce(trans, 0) as trans from us cross join it left join bs using (entity_id, item_id) left join v using (entity_id, item_id)),
mo as (select entity_id, avg(base) as bm, stddev_pop(base) as bd, avg(trans) as tm, stddev_pop(trans) as td from sq group by 1),
bl as (select sq.entity_id, sq.item_id, case when bd > 0 then (base - bm) / bd else base end + 0.5 * tz.trend_z + 0.25 * case when td > 0 then (trans - tm) / td else 0 end as score from sq join mo using (entity_id) join tz using (item_id))"""
_POOL = ", ms as (select bl.* from bl anti join hi using (entity_id, item_id)), pl as (select *, row_number() over (partition by entity_id order by round(score, 9) desc, item_id) as place from ms qualify place <= 500)"


#: Weights of the fused channels beside the base.
BLEND = {"transitions": 0.25, "trend": 0.5}


def _blended_pool(log: DataFrame, layers: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Pool of the fused co-occurrence base (Wilson edges, trend and transitions), and the layers' values (entity_id, item_id, value)."""
    half, steps, trend = stage(_wilson_half(log)), stage(ed.transitions(log)), stage(ch.trend(log, log))
    pooled = pk.blended_pool(log, half, steps, trend, BLEND, BUDGET, layers)
    if pooled is not None:
        pooled = stage(pooled) if layers else pooled
        return pooled, [pooled.select("entity_id", "item_id", F.col(f"v{k}").alias("value")) for k in range(len(layers))]
    hist = ch.multiplicity(log)
    blend = sc.Blend(
        sc.Channel("base", ch.base_scores(hist, ed.mirrored(half)), 1.0), [sc.Channel("trans", ch.transition_votes(log, steps), 0.25)], trend.select("item_id", F.col("trend_z").alias("term")), 0.5
    )
    scores = sc.blend(blend, log.select("item_id").distinct().count(), log.select("entity_id").distinct(), BUDGET)
    return stage(sc.pool(sc.mask_owned(scores, log), BUDGET)), [ch.base_scores(hist, ed.mirrored(e), "value") for e in layers]


_BLEND = _O + _WIL + _HIST + _BASE + _STEP.format(x="ixo") + _VOTE.format(x="ixo") + _TREND.format(x="ixo") + _SQUARE + _POOL


@query(_BLEND + " select entity_id, place::integer as rank, item_id, round(score, 6) as score from pl where place <= 10")
def blended_topk(spark, d):
    log = stage(orders_log(spark, d))
    top = pk.top_blended(log, ed.transitions(log), ch.trend(log, log), BLEND, TOP)
    if top is not None:
        return top.select("entity_id", "rank", "item_id", r6("score"))
    pooled, _ = _blended_pool(log, [])
    return sc.top_n(pooled.withColumn("composite", F.col("score")), TOP, "cooc_fused").select("entity_id", "rank", "item_id", r6("score"))


@query(
    _BLEND
    + """, gs as (select session_id as k, item_id, sum(weight) as w from ixo group by all), sp as (select a.item_id as i, b.item_id as j, sum(a.w * b.w) as w from gs a join gs b on a.k = b.k and a.item_id <> b.item_id group by all),
ly as (select entity_id, sp.j as item_id, sum(cnt * sp.w) as value from hi join sp on sp.i = hi.item_id group by all),
lz as (select entity_id, item_id, (value - avg(value) over p) / greatest(stddev_pop(value) over p, 1e-9) as z, count(*) over p as n from pl join ly using (entity_id, item_id) where value > 0 window p as (partition by entity_id)),
gp as (select entity_id, quantile_cont(g, 0.5) as gap from (select entity_id, score - lead(score) over (partition by entity_id order by place) as g from pl where place <= 20) where g > 0 group by 1),
cm as (select pl.*, score + 3.0 * coalesce(gap, 0) * case when z > 2.5 and n >= 3 then 1 else 0 end as composite from pl left join lz using (entity_id, item_id) left join gp using (entity_id)),
rk as (select *, row_number() over (partition by entity_id order by round(composite, 9) desc, place) as rank from cm)
select entity_id, rank::integer as rank, item_id, round(composite, 6) as score from rk where rank <= 10"""
)
def layered_boost(spark, d):
    log = stage(orders_log(spark, d))
    top = pk.top_blended(log, ed.transitions(log), ch.trend(log, log), BLEND, TOP, BUDGET, session=True)
    if top is not None:
        return top.select("entity_id", "rank", "item_id", r6("score"))
    pooled, layers = _blended_pool(log, [ed.cooc_counts(log, "session_id")])
    return sc.top_n(sc.boosted(pooled, layers), TOP, "cooc_fused").select("entity_id", "rank", "item_id", r6("score"))


@query()
def ease_topk(spark, d):
    log = cut(events_log(spark, d))
    hist = ch.multiplicity(log)
    model = fit_ease(log)
    last = ch.last_items(log).select("entity_id", "item_id", F.lit(1).alias("cnt"))
    pairs = log.select("entity_id", "item_id").distinct()
    blend = sc.Blend(
        sc.Channel("base", model.scores(hist), 1.0),
        [sc.Channel("last", model.scores(last, "last"), 0.25), sc.Channel("ucf", ch.user_cf(pk.user_neighbors(hist, pairs), pairs), 1.0), sc.Channel("trans", ch.transition_votes(log, ed.transitions(log)), 0.25)],
        cut(ch.trend(log, log).select("item_id", F.col("trend_z").alias("term"))), 0.5,
    )
    pooled = sc.pool(sc.mask_owned(sc.blend(blend, model.n, log.select("entity_id").distinct(), BUDGET), log), BUDGET)
    return sc.top_n(pooled.withColumn("composite", F.col("score")), TOP, "ease").select("entity_id", "rank", "item_id", r6("score"))


#: Rows at which an item of the orders view stops being cold; every part has more than the default of 20.
WARM = 100
_COLD = (
    _FEAT
    + f", {_IXO}"
    + """, hi as (select entity_id, item_id, count(*) as cnt from ixo group by all), pr as (select entity_id, feature, sum(cnt * w) as p from hi join f using (item_id) group by all),
cn as (select entity_id, item_id, sum(p * w) as content from pr join f using (feature) group by all), c0 as (select item_id, count(*) as n from ixo group by 1),
cd as (select p_partkey as item_id from part left join c0 on c0.item_id = p_partkey where 1 - coalesce(n, 0) / 100.0 >= 0.75), us as (select distinct entity_id from ixo),
mo as (select entity_id, sum(content) / n as m, sqrt(sum(content * content) / n - pow(sum(content) / n, 2)) as s from cn, nn group by entity_id, n),
z as (select us.entity_id, cd.item_id, coalesce((coalesce(content, 0) - m) / s, 0) as score from us cross join cd left join cn using (entity_id, item_id) left join mo using (entity_id) anti join hi using (entity_id, item_id))"""
)


def _cold_shelf(log: DataFrame, meta: DataFrame, slots: int, listed: DataFrame | None = None) -> DataFrame:
    items = ch.popularity(log, meta).withColumn("coldness", ch.coldness(F.col("n"), WARM))
    cold = items.where("coldness >= 0.75").select("item_id", F.lit(0.0).alias("recency"))
    return pk.cold_shelf(ch.multiplicity(log), stage(ft.item_features(meta)), cold, meta.count(), 2.0, slots, listed)


@query(
    _COLD
    + """, r as (select *, row_number() over (partition by entity_id order by round(score, 9) desc, item_id) as rank from z)
select entity_id, rank::integer as rank, item_id, round(score, 5) as score from r where rank <= 10"""
)
def cold_slot_topk(spark, d):
    log, meta = stage(orders_log(spark, d).select("entity_id", "item_id")), meta_part(spark, d)
    best = sc.pool(_cold_shelf(log, meta, TOP), TOP)
    return best.select("entity_id", F.col("place").alias("rank"), "item_id", F.round("score", 5).alias("score"))


@query(
    _COLD
    + """, n0 as (select item_id, count(*)::double as n from ixo group by 1),
li as (select us.entity_id, n0.item_id, n as score, row_number() over (partition by us.entity_id order by n desc, n0.item_id) as rank from us cross join n0 anti join hi using (entity_id, item_id) qualify rank <= 10),
pk as (select z.*, row_number() over (partition by entity_id order by round(z.score, 9) desc, item_id) as k from z anti join li using (entity_id, item_id) qualify k <= 3),
np as (select entity_id, count(*) as picks from pk group by 1), kp as (select li.* from li left join np using (entity_id) where rank <= 10 - coalesce(picks, 0)), ln as (select entity_id, count(*) as have from kp group by 1)
select entity_id, rank::integer as rank, item_id, round(score, 5) as score, 'popularity' as base_kind from kp
union all select entity_id, (coalesce(have, 0) + k)::integer, item_id, round(score, 5), 'cold_content' from pk left join ln using (entity_id)"""
)
def cold_slot_lists(spark, d):
    """Popularity lists whose last three places are reserved for cold items by content."""
    log, meta = stage(orders_log(spark, d).select("entity_id", "item_id")), meta_part(spark, d)
    top = stage(ev.popularity_lists(log, log, TOP).withColumn("base_kind", F.lit("popularity")))
    return sc.with_cold_slots(top, _cold_shelf(log, meta, 3, top), 3, TOP).select("entity_id", "rank", "item_id", F.round("score", 5).alias("score"), "base_kind")


_SEED = """, sd as (select entity_id, min(item_id) as item_id from ixo group by 1 union select entity_id, max(item_id) from ixo group by 1), ns as (select entity_id, count(*) as n_seeds from sd group by 1),
sb as (select entity_id, j as item_id, sum(w) as base from sd join wb on wb.i = sd.item_id group by all), lp as (select item_id, ln(1 + count(*)) as l from ixo group by 1), pz as (select item_id, (l - avg(l) over ()) / stddev_pop(l) over () as pz from lp),
sq as (select ns.entity_id, pz.item_id, coalesce(base, 0) + 8.0 / n_seeds * pz as score from ns cross join pz left join sb using (entity_id, item_id)),
r as (select sq.*, row_number() over (partition by entity_id order by round(score, 9) desc, item_id) as rank from sq anti join sd using (entity_id, item_id))
select entity_id, rank::integer as rank, item_id, round(score, 6) as score from r where rank <= 10"""


@query(_O + _WIL + _SEED)
def seed_recommend(spark, d):
    """Visitors with the first and last item id of each customer as their seeds."""
    from spanloom.plans.engine import Engine

    log = cut(orders_log(spark, d))
    seeds = log.groupBy("entity_id").agg(F.array_distinct(F.array(F.min("item_id"), F.max("item_id"))).alias("s")).select("entity_id", F.explode("s").alias("item_id"))
    return Engine.from_log(log, "wilson").recommend_for_items(seeds, TOP).select("entity_id", "rank", "item_id", r6("score"))


@query(_O + ", n as (select item_id, count(*)::double as score from ixo group by 1) select item_id, score, row_number() over (order by score desc, item_id)::integer as rank, 'cold_popularity' as base_kind from n order by score desc, item_id limit 10")
def popularity_fallback(spark, d):
    return ch.fallback(ch.popularity(orders_log(spark, d)), TOP)


# ---------------------------------------------------------------- splits, metrics, baselines

_ORD = "ts, entity_id, session_id, item_id, weight"


@query(_O + f", r as (select *, row_number() over (order by {_ORD}) as rn, count(*) over () as n from ixo) select entity_id, item_id, session_id, rn <= floor(n * 0.9) as is_train, count(*) as n from r group by all")
def chrono_split(spark, d):
    return ev.chronological_split(orders_log(spark, d), 0.1).groupBy("entity_id", "item_id", "session_id", "is_train").agg(F.count(F.lit(1)).alias("n"))


@query(_O + ", q as (select entity_id, quantile_cont(ts::double, 0.8) as q from ixo group by 1) select entity_id, ts <= q as is_train, count(*) as n from ixo join q using (entity_id) group by all")
def per_user_quantile_split(spark, d):
    return ev.quantile_split(orders_log(spark, d), 0.2).groupBy("entity_id", "is_train").agg(F.count(F.lit(1)).alias("n"))


_R = ", r as (select *, row_number() over (partition by entity_id order by ts, session_id, item_id, weight) as pos, count(*) over (partition by entity_id) as n from ixo)"


@query(_O + _R + "select entity_id, item_id, session_id from r where pos = n and n >= 2")
def leave_last_out(spark, d):
    return ev.leave_last_out(orders_log(spark, d)).where("is_held").select("entity_id", "item_id", "session_id")


@query(_O + _R + "select entity_id, item_id, session_id, count(*) as n_rows from r where n >= 5 and pos > n - greatest(1, n // 5) group by all")
def leave_last_fraction(spark, d):
    return ev.leave_last_fraction(orders_log(spark, d)).where("is_held").groupBy("entity_id", "item_id", "session_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(_O + ", q as (select quantile_cont(ts::double, 0.85) as q from ixo), x as (select entity_id, ts >= q as is_held from ixo, q), b as (select entity_id from x group by 1 having bool_or(is_held) and not bool_and(is_held)) select entity_id, is_held, count(*) as n from x semi join b using (entity_id) group by all")
def global_time_holdout(spark, d):
    return ev.global_time_holdout(orders_log(spark, d)).groupBy("entity_id", "is_held").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = f", sp as (select *, row_number() over (order by {_ORD}) <= floor(count(*) over () * 0.9) as is_train from ixo)"


@query(_O + _SPLIT + ", u as (select distinct entity_id from sp where is_train intersect select distinct entity_id from sp where not is_train), k as (select entity_id, row_number() over (order by entity_id::varchar) - 1 as r, greatest(1, count(*) over () // 500) as step from u) select entity_id from k where r % step = 0 and r / step < 500")
def strided_eval_set(spark, d):
    s = cut(ev.chronological_split(orders_log(spark, d), 0.1))
    return ev.strided_users(s.where("is_train"), s.where("not is_train"), 500)


_POPL = """, tr as (select distinct entity_id, item_id from sp where is_train), pn as (select item_id, count(*) as n from sp where is_train group by 1), us as (select distinct entity_id from sp where is_train),
pr as (select us.entity_id, pn.item_id, n, row_number() over (partition by us.entity_id order by n desc, pn.item_id) as rank from us cross join pn anti join tr using (entity_id, item_id))"""


@query(_O + _SPLIT + _POPL + "select entity_id, rank::integer as rank, item_id, n::double as score from pr where rank <= 10")
def popularity_baseline(spark, d):
    train = cut(ev.chronological_split(orders_log(spark, d), 0.1).where("is_train"))
    return ev.popularity_lists(train, train, TOP)


_REL = """, rel as (select distinct s.entity_id, s.item_id from sp s anti join tr using (entity_id, item_id) where not is_train and entity_id in (select entity_id from us)), nr as (select entity_id, count(*) as n_rel from rel group by 1),
ht as (select entity_id, count(*) as hits, sum(1 / log2(rank + 1.0)) as dcg, min(rank) as first from pr join rel using (entity_id, item_id) where rank <= 10 group by 1),
pe as (select nr.entity_id, coalesce(hits, 0) / 10.0 as precision, coalesce(hits, 0) / n_rel as recall, coalesce(dcg, 0) / list_sum([1 / log2(x + 1.0) for x in range(1, least(n_rel, 10) + 1)]) as ndcg, coalesce(1.0 / first, 0) as rr, case when hits > 0 then 1.0 else 0.0 end as hit from nr left join ht using (entity_id))"""


@query(
    _O
    + _SPLIT
    + _POPL
    + _REL
    + """select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(ndcg), 6) as ndcg, round(avg(rr), 6) as rr, round(avg(hit), 6) as hit, count(*) as n_entities,
round((select count(distinct item_id) from pr where rank <= 10) / (select count(*) from pn)::double, 6) as coverage from pe"""
)
def metrics_at_k(spark, d):
    s = cut(ev.chronological_split(orders_log(spark, d), 0.1))
    train, test = s.where("is_train"), s.where("not is_train")
    recs = cut(ev.popularity_lists(train, train, TOP))
    known = train.select("entity_id").distinct()
    rel = test.join(train.select("entity_id", "item_id").distinct(), ["entity_id", "item_id"], "left_anti").join(known, "entity_id", "left_semi")
    return ev.metrics(recs, rel, train.select("item_id").distinct().count(), 10).select(*[r6(c) for c in ("precision", "recall", "ndcg", "rr", "hit", "coverage")], "n_entities")


@query(_O + ", c as (select entity_id, item_id, count(*) as cnt from ixo group by all), r as (select *, row_number() over (partition by entity_id order by cnt desc, item_id) as rank from c) select entity_id, rank::integer as rank, item_id, cnt::double as score from r where rank <= 10")
def personal_frequency_baseline(spark, d):
    return ev.personal_frequency(orders_log(spark, d), TOP)


@query(
    _E
    + """, x as (select distinct entity_id, item_id from ixe), n as (select item_id, count(*) as n from x group by 1),
c as (select a.item_id as i, b.item_id as j, count(*) as c from x a join x b on a.entity_id = b.entity_id and a.item_id <> b.item_id group by all),
w as (select i, j, c / sqrt(p.n * q.n) as w from c join n p on p.item_id = i join n q on q.item_id = j), k as (select *, row_number() over (partition by i order by round(w, 12) desc, j) as r from w),
s as (select entity_id, j as item_id, sum(w) as score from x join k on k.i = x.item_id where r <= 200 group by all), o as (select s.*, row_number() over (partition by entity_id order by round(score, 9) desc, item_id) as rank from s anti join x using (entity_id, item_id))
select entity_id, rank::integer as rank, item_id, round(score, 6) as score from o where rank <= 10"""
)
def item_knn_baseline(spark, d):
    return ev.item_knn(events_log(spark, d), TOP).select("entity_id", "rank", "item_id", r6("score"))


@query()
def als_baseline(spark, d):
    return ev.als_lists(events_log(spark, d), TOP)


@query(_O + ", n as (select entity_id, count(*) as rows from ixo group by 1) select case when rows < 5 then '1-4' when rows < 20 then '5-19' else '20+' end as bucket, count(*) as n_entities, sum(rows)::bigint as n_rows from n group by 1")
def history_buckets(spark, d):
    n = orders_log(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows"))
    return n.groupBy(ev.warmth(F.col("rows")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("rows").alias("n_rows"))


# ---------------------------------------------------------------- sessions, decay, small joins


@query(
    """with x as (select event_id, user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 1800000000 then 0 else 1 end as s from events)
select event_id, user_id as entity_id, sum(s) over (partition by user_id order by ts range unbounded preceding)::bigint as session_no from x"""
)
def sessions_gap(spark, d):
    return label_sessions(ix_events(spark, d).select("event_id", "entity_id", "timestamp"), "entity_id", "timestamp").select("event_id", "entity_id", "session_no")


@query(_O + "select session_id, count(*) as n from ixo group by 1")
def sessions_explicit(spark, d):
    return infer_sessions(orders_log(spark, d)).rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def sessions_inferred(spark, d):
    s = infer_sessions(events_log(spark, d))
    return s.rows.groupBy("entity_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.lit(s.strategy).alias("strategy"))


@query(
    """with e as (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) % 10 as item, epoch_us(ts) as t, case event_type when 'click' then 'addtocart' when 'purchase' then 'transaction' else 'view' end as event from events)
select event_id, case when event = 'transaction' then 'add' when event = 'view' then 'view' when exists (select 1 from e b where b.event = 'transaction' and b.user_id = e.user_id and b.item = e.item and b.t >= e.t and b.t - e.t <= 86400000000) then 'add' else 'remove' end as action_type from e"""
)
def cart_abandonment_interval_join(spark, d):
    ev_ = ix_events(spark, d).select("event_id", "entity_id", F.pmod("item_id", F.lit(10)).alias("item_id"), seconds(F.col("timestamp")).alias("ts"), F.when(F.col("event_type") == "click", "addtocart").when(F.col("event_type") == "purchase", "transaction").otherwise("view").alias("event"))
    return cart_outcomes(ev_).select("event_id", "action_type")


@query(
    """with a as (select o_orderkey, (epoch_us(max(o_orderdate) over ()) - epoch_us(o_orderdate)) / 86400000000.0 as age from orders)
select o_orderkey, round(exp(-ln(2) * age / 180), 6) as exponential, round(greatest(0, 1 - age / 365), 6)::double as linear, 1.0::double as none from a"""
)
def decay_weights(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", seconds(F.col("o_orderdate")).alias("t"))
    hi = o.agg(F.max("t").alias("hi"))
    a = o.crossJoin(F.broadcast(hi)).withColumn("age", (F.col("hi") - F.col("t")) / 86400.0)  # one row
    return a.select("o_orderkey", *[F.round(f(F.col("age")), 6).alias(n) for n, f in (("exponential", decay.exponential()), ("linear", decay.linear()), ("none", decay.none()))])


@query("select cast(json_extract_string(props, '$.k') as bigint) as item_id, arg_max(event_type, (ts, event_type)) as category from events group by 1")
def latest_item_property(spark, d):
    return latest_property(ix_events(spark, d).select("item_id", seconds(F.col("timestamp")).alias("ts"), F.col("event_type").alias("category")))


_TEXT = "md5(concat_ws('|', '0', entity_id::varchar, item_id::varchar, ts::decimal(38,6)::varchar, session_id::varchar, weight::decimal(38,6)::varchar))"


@query(_O + f", r as (select entity_id, row_number() over (order by {_TEXT}) as k, count(*) over () as n from ixo) select entity_id, count(*) as n from r where k <= round_even(n * 0.25, 0) group by 1")
def nested_subsample(spark, d):
    log = orders_log(spark, d).select("entity_id", "item_id", "ts", "session_id", "weight")
    return ev.nested_subsample(log, 0.25).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))

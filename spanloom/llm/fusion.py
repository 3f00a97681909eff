"""One ranking from several differently scaled scores, by reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import cut

#: Lists longer than this are ranked through their distinct scores in shards.
LONG_LIST = 1_000_000
_SHARDS = 256


def _clean(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c), None).when(c == 0, F.lit(0.0)).otherwise(c)


def _above(cuts: str, value: str) -> Column:
    """How many different cut points lie above the value: the number of its shard, counted from the top."""
    return F.size(F.filter(F.array_distinct(cuts), lambda x: x > F.col(value)))


def _window_ranks(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Rank and spread of every channel in lists that fit a task: 1 + number of higher scores."""
    whole = Window.partitionBy("_l")
    out = rows
    for c in channels:
        low = F.min(c).over(whole)
        out = out.withColumn(c, F.coalesce(F.col(c), low)).withColumn(f"_flat_{c}", F.max(c).over(whole).eqNullSafe(low))
    for c in channels:
        out = out.withColumn(f"_rank_{c}", F.rank().over(whole.orderBy(F.col(c).desc_nulls_last())))
    return out


def _sharded_ranks(rows: DataFrame, channels: list[str]) -> DataFrame:
    """The same for long lists: distinct scores counted, cut into score ranges, ranked range by range."""
    lows = rows.groupBy(F.col("_l").alias("_ll")).agg(
        *[F.min(c).alias(f"_low_{c}") for c in channels],
        *[F.max(c).eqNullSafe(F.min(c)).alias(f"_flat_{c}") for c in channels],
        *[F.percentile_approx(c, [i / _SHARDS for i in range(1, _SHARDS)], 10 * _SHARDS).alias(f"_cuts_{c}") for c in channels],
    )
    rows = rows.join(lows, F.col("_l") == F.col("_ll")).drop("_ll")
    for c in channels:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.col(f"_low_{c}"))).withColumn(
            f"_shard_{c}", F.coalesce(_above(f"_cuts_{c}", c), F.lit(0))
        )
    rows = rows.drop(*[f"_{k}_{c}" for k in ("low", "cuts") for c in channels])
    for c in channels:
        counts = rows.groupBy("_l", f"_shard_{c}", c).agg(F.count(F.lit(1)).alias("_n"))
        shard_sizes = counts.groupBy("_l", f"_shard_{c}").agg(F.sum("_n").alias("_m"))
        above = Window.partitionBy("_l").orderBy(f"_shard_{c}").rowsBetween(Window.unboundedPreceding, -1)
        offsets = shard_sizes.withColumn("_off", F.coalesce(F.sum("_m").over(above), F.lit(0))).drop("_m")
        higher = Window.partitionBy("_l", f"_shard_{c}").orderBy(F.col(c).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        ranks = (
            counts.withColumn("_in", F.coalesce(F.sum("_n").over(higher), F.lit(0)))
            .join(offsets, ["_l", f"_shard_{c}"])
            .select(F.col("_l").alias("_rl"), F.col(c).alias("_rv"), (F.col("_off") + F.col("_in") + 1).alias(f"_rank_{c}"))
        )
        rows = rows.join(ranks, (F.col("_l") == F.col("_rl")) & F.col(c).eqNullSafe(F.col("_rv")), "left").drop("_rl", "_rv", f"_shard_{c}")
    return rows


def fuse_rankings(
    df: DataFrame, list_id: str, item: str, channels: dict[str, Column | float], k: float = 60.0, long_list: int = LONG_LIST
) -> DataFrame:
    """``(list_id, item, fused_score, rank_no)``: every item of every list in one fused order.

    ``channels`` maps score columns to weights (columns of ``df``, equal within a list, or
    numbers). Items are ranked within each channel on their own, the fused score is the sum of
    weight / (k + rank), so no channel wins by its scale. Equal scores share a rank. A missing
    (null or NaN) score counts as the lowest of its list; a channel with one value for all items,
    or none at all, decides nothing; a null or zero weight turns a channel off. Of repeated rows of
    an item the highest score per channel counts. Equal totals are ordered by item. Rows with a
    null item are left out; a null list is a list of its own.

    Lists of up to ``long_list`` rows are ranked by a window each. Longer ones (at most all rows /
    ``long_list`` many) are ranked through shards of their distinct scores, so that no task ever
    holds a whole list.
    """
    names = list(channels)
    alias = {c: f"_c{i}" for i, c in enumerate(names)}
    weight = [F.coalesce(w.cast("double") if isinstance(w, Column) else F.lit(float(w)), F.lit(0.0)) for w in channels.values()]
    inner = list(alias.values())
    rows = df.select(
        F.struct(F.col(list_id).alias("k")).alias("_l"),
        F.col(item).alias("_i"),
        *[_clean(F.col(c)).alias(alias[c]) for c in names],
        *[w.alias(f"_a{i}") for i, w in enumerate(weight)],
    ).where(F.col("_i").isNotNull())
    rows = rows.groupBy("_l", "_i").agg(*[F.max(c).alias(c) for c in inner], *[F.max(f"_a{i}").alias(f"_a{i}") for i in range(len(names))])
    sizes = df.groupBy(F.col(list_id).alias("_hk")).count().where(F.col("count") > long_list).select("_hk")
    heavy = cut(sizes)
    n_heavy = heavy.count()
    if n_heavy:
        is_long = F.col("_l.k").eqNullSafe(F.col("_hk"))
        long = _sharded_ranks(rows.join(F.broadcast(heavy), is_long, "left_semi"), inner)
        ranked = _window_ranks(rows.join(F.broadcast(heavy), is_long, "left_anti"), inner).unionByName(long)
    else:
        ranked = _window_ranks(rows, inner)
    parts = [
        F.when(F.col(f"_flat_{c}") | (F.col(f"_a{i}") == 0), F.lit(0.0)).otherwise(F.col(f"_a{i}") / (F.lit(k) + F.col(f"_rank_{c}")))
        for i, c in enumerate(inner)
    ]
    scored = ranked.select("_l", "_i", sum(parts[1:], parts[0]).alias("_f"))
    order = Window.partitionBy("_l").orderBy(F.col("_f").desc(), F.col("_i"))
    if n_heavy:
        # the final order of long lists is found the same way: by shards of the fused score
        is_long = F.col("_l.k").eqNullSafe(F.col("_hk"))
        long = scored.join(F.broadcast(heavy), is_long, "left_semi")
        cuts = long.groupBy("_l").agg(F.percentile_approx("_f", [i / _SHARDS for i in range(1, _SHARDS)], 10 * _SHARDS).alias("_cuts"))
        long = long.join(cuts, "_l").withColumn("_s", _above("_cuts", "_f")).drop("_cuts")
        sizes = long.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("_m"))
        off = sizes.withColumn("_off", F.coalesce(F.sum("_m").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
        inside = Window.partitionBy("_l", "_s").orderBy(F.col("_f").desc(), F.col("_i"))
        long = long.withColumn("_r", F.row_number().over(inside)).join(off, ["_l", "_s"]).select("_l", "_i", "_f", (F.col("_r") + F.col("_off")).alias("_r"))
        short = scored.join(F.broadcast(heavy), is_long, "left_anti").withColumn("_r", F.row_number().over(order).cast("long"))
        done = short.unionByName(long)
    else:
        done = scored.withColumn("_r", F.row_number().over(order).cast("long"))
    return done.select(F.col("_l.k").alias(list_id), F.col("_i").alias(item), F.col("_f").alias("fused_score"), F.col("_r").alias("rank_no"))

"""Per-item statistics and per-user channels, in long form: one row per non-zero value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.contract import history


def popularity(log: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``(item_id, n)``: rows per item, 0 for catalog items without any."""
    n = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return n if catalog is None else catalog.select("item_id").join(n, "item_id", "left").fillna(0, ["n"])


def with_z(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the population z-score of a column over all its rows; null where it has no spread."""
    m = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(m)).withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")  # one row


def trend(log: DataFrame, items: DataFrame, window_fraction: float = 0.10) -> DataFrame:
    """``(item_id, n_recent, trend_z)`` for all ``items``: rows in the last part of the time span, as z-score.

    Null z where all times are equal, absent, or all items are alike.
    """
    span = log.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    recent = (
        log.crossJoin(F.broadcast(span))  # one row
        .where((F.col("hi") > F.col("lo")) & (F.col("ts") >= F.col("hi") - (F.col("hi") - F.col("lo")) * window_fraction))
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("n_recent"))
    )
    return with_z(items.select("item_id").distinct().join(recent, "item_id", "left").fillna(0, ["n_recent"]), "n_recent", "trend_z")


def coldness(n: Column, threshold: int = 20) -> Column:
    """1 for items without rows, falling to 0 at ``threshold`` rows."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - n / float(threshold)))


def last_items(log: DataFrame) -> DataFrame:
    """``(entity_id, item_id, ts)``: the newest row of each entity in history order."""
    return history(log).where("pos = n").select("entity_id", "item_id", "ts")


def multiplicity(log: DataFrame) -> DataFrame:
    """``(entity_id, item_id, cnt)``: the history with repeated rows counted."""
    return log.groupBy("entity_id", "item_id").agg(F.count(F.lit(1)).alias("cnt"))


def base_scores(hist: DataFrame, edges: DataFrame, name: str = "base") -> DataFrame:
    """``(entity_id, item_id, base)``: sum of the edges from every history row; edges are directed ``(i, j, w)``."""
    return hist.join(edges, hist["item_id"] == edges["i"]).groupBy("entity_id", F.col("j").alias("item_id")).agg(F.sum(F.col("cnt") * F.col("w")).alias(name))


def recent_rows(log: DataFrame, last_k: int = 5, decay: float = 0.7) -> DataFrame:
    """``(entity_id, i, d)``: the last ``last_k`` rows of each history, weighted by ``decay`` to the power of their age."""
    recent = history(log).withColumn("age", F.col("n") - F.col("pos")).where(F.col("age") < last_k)
    return recent.select("entity_id", F.col("item_id").alias("i"), F.pow(F.lit(decay), F.col("age").cast("double")).alias("d"))


def transition_votes(log: DataFrame, edges: DataFrame, last_k: int = 5, decay: float = 0.7) -> DataFrame:
    """``(entity_id, item_id, trans)``: transitions out of the last ``last_k`` rows, decayed by age."""
    recent = recent_rows(log, last_k, decay)
    return recent.join(edges, "i").groupBy("entity_id", F.col("j").alias("item_id")).agg(F.sum(F.col("d") * F.col("w")).alias("trans"))


def user_neighbors(hist: DataFrame, user_items: DataFrame, k: int = 100, known: bool = True) -> DataFrame:
    """``(entity_id, neighbor, overlap, sim, rank)``: the ``k`` users most alike by shared items.

    sim = overlap / (sqrt(items of the neighbour) x sqrt(rows of the history)); overlap counts
    history rows. An entity is not its own neighbour (``known=False`` for histories of visitors who
    are no users). Ties go to the smaller user id.
    """
    degree = user_items.groupBy("entity_id").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("entity_id", "neighbor")
    length = hist.groupBy("entity_id").agg(F.sum("cnt").alias("len"))
    them = user_items.select(F.col("entity_id").alias("neighbor"), "item_id")
    shared = hist.join(them, "item_id")
    if known:
        shared = shared.where(F.col("entity_id") != F.col("neighbor"))
    shared = shared.groupBy("entity_id", "neighbor").agg(F.sum("cnt").alias("overlap"))
    sims = shared.join(degree, "neighbor").join(length, "entity_id").withColumn("sim", F.col("overlap") / (F.sqrt("deg") * F.sqrt("len")))
    order = Window.partitionBy("entity_id").orderBy(F.col("sim").desc(), F.col("neighbor"))
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("entity_id", "neighbor", "overlap", "sim", "rank")


def user_cf(neighbors: DataFrame, user_items: DataFrame) -> DataFrame:
    """``(entity_id, item_id, ucf)``: similarity-weighted votes of the neighbours for their items."""
    them = user_items.select(F.col("entity_id").alias("neighbor"), "item_id")
    return neighbors.join(them, "neighbor").groupBy("entity_id", "item_id").agg(F.sum("sim").alias("ucf"))


def content_scores(hist: DataFrame, features: DataFrame) -> DataFrame:
    """``(entity_id, item_id, content)``: features of the history summed to a profile, dotted with every item's."""
    profile = hist.join(features, "item_id").groupBy("entity_id", "feature").agg(F.sum(F.col("cnt") * F.col("w")).alias("p"))
    f = features.select(F.col("item_id"), "feature", F.col("w").alias("fw"))
    return profile.join(f, "feature").groupBy("entity_id", "item_id").agg(F.sum(F.col("p") * F.col("fw")).alias("content"))


def fallback(items: DataFrame, n: int = 10) -> DataFrame:
    """``(item_id, score, rank)``: most rows first, then item id; what visitors without history get."""
    order = Window.orderBy(F.col("score").desc(), F.col("item_id"))
    best = items.select("item_id", F.col("n").cast("double").alias("score")).orderBy(F.col("score").desc(), "item_id").limit(n)
    return best.withColumn("rank", F.row_number().over(order)).withColumn("base_kind", F.lit("cold_popularity"))  # n rows

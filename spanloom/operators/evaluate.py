"""Splits, strided evaluation users, list metrics and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.channels import multiplicity, popularity
from spanloom.operators.contract import HISTORY_ORDER, history
from spanloom.operators.edges import key_pairs
from spanloom.operators.order import first_rows_by_hash, quantiles, ranked
from spanloom.runtime import stage


def chronological_split(log: DataFrame, test_fraction: float = 0.1, order: list[str] | None = None) -> DataFrame:
    """``log`` with ``is_train``: the first int(n (1 - f)) rows in time order.

    The cut row is found by counting per second and then ordering the rows of the cut's own second
    only; no task sorts the log. Rows without time come first.
    """
    order = order or [*HISTORY_ORDER[:1], "entity_id", *HISTORY_ORDER[1:]]
    t = F.coalesce(F.floor(F.col(order[0])), F.lit(-(2**62)))
    n = log.count()
    cut = int(n * (1 - test_fraction))
    # days, then seconds of the day that holds the cut
    rows, before, lo = log.withColumn("_t", t), 0, None
    for width in (86_400, 1):
        cell = F.floor(F.col("_t") / width)
        counts = rows.where(lo if lo is not None else F.lit(True)).groupBy(cell.alias("c")).count()
        w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)  # one row per day, then per second of a day
        hit = counts.withColumn("cum", F.sum("count").over(w) + before).where(F.col("cum") > cut).orderBy("c").limit(1).collect()
        if not hit:
            return log.withColumn("is_train", F.lit(True))
        before = hit[0]["cum"] - hit[0]["count"]
        lo = cell == F.lit(hit[0]["c"])
    second = hit[0]["c"]
    edge = rows.where(F.col("_t") == second).withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # rows of one second
    rest = rows.where(F.col("_t") != second)
    return rest.withColumn("is_train", F.col("_t") < second).drop("_t").unionByName(edge.withColumn("is_train", F.col("_r") <= cut - before).drop("_t", "_r"))


def quantile_split(log: DataFrame, test_fraction: float = 0.2, by: str = "ts") -> DataFrame:
    """``log`` with ``is_train``: rows up to the entity's own (1 - f) quantile of time."""
    q = log.groupBy("entity_id").agg(F.percentile(by, 1 - test_fraction).alias("_q"))
    return log.join(q, "entity_id").withColumn("is_train", F.col(by) <= F.col("_q")).drop("_q")


def leave_last_out(log: DataFrame) -> DataFrame:
    """``log`` with ``is_held``: the newest row of every entity with at least two."""
    return history(log).withColumn("is_held", (F.col("pos") == F.col("n")) & (F.col("n") >= 2)).drop("pos", "n")


def leave_last_fraction(log: DataFrame, least: int = 5) -> DataFrame:
    """Entities with ``least`` rows and more: ``is_held`` marks their last max(1, n // 5) rows."""
    h = history(log).where(F.col("n") >= least)
    held = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    return h.withColumn("is_held", F.col("pos") > F.col("n") - held).drop("pos", "n")


def global_time_holdout(log: DataFrame, quantile: float = 0.85) -> DataFrame:
    """Entities with rows on both sides of a quantile of all times: ``is_held`` marks those at or after it."""
    q = quantiles(log, "ts", [quantile])
    rows = log.withColumn("is_held", F.col("ts") >= F.lit(q[0] if q else None).cast("double"))
    both = rows.groupBy("entity_id").agg(F.bool_or("is_held").alias("a"), F.bool_and("is_held").alias("b")).where("a and not b")
    return rows.join(both.select("entity_id"), "entity_id", "left_semi")


def strided_users(train: DataFrame, test: DataFrame, max_users: int = 500) -> DataFrame:
    """``(entity_id)``: users of both splits, every k-th in order of their id as text."""
    users = train.select("entity_id").distinct().join(test.select("entity_id").distinct(), "entity_id", "left_semi")
    step = max(1, users.count() // max_users)
    places = ranked(users, [F.col("entity_id").cast("string")], "_r").withColumn("_r", F.col("_r") - 1)
    return places.where((F.col("_r") % step == 0) & (F.col("_r") / step < max_users)).select("entity_id")


def nested_subsample(log: DataFrame, fraction: float, seed: int = 0, earliest: bool = False) -> DataFrame:
    """Exactly round(n x ``fraction``) rows: a smaller fraction is part of every larger one.

    The rows come in a random order fixed by ``seed``; with ``earliest`` they are the first in time.
    """
    n = log.count()
    want = round(n * fraction)
    if earliest:
        return chronological_split(log, 1 - want / n).where("is_train").drop("is_train") if n else log
    return first_rows_by_hash(log, want, seed)


def user_row_cap(log: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows per entity, chosen by hash (a benchmark option, off everywhere else)."""
    w = Window.partitionBy("entity_id").orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in log.columns]), *HISTORY_ORDER)
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).drop("_r")


def warmth(rows: Column) -> Column:
    """History length bucket: 1-4, 5-19, 20+."""
    return F.when(rows < 5, "1-4").when(rows < 20, "5-19").otherwise("20+")


def per_entity_metrics(recs: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per entity with relevant items: precision, recall, ndcg, rr, hit at ``k``; 0 where it got no list."""
    rel = relevant.select("entity_id", "item_id").distinct()
    n_rel = rel.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = recs.where(F.col("rank") <= k).join(rel, ["entity_id", "item_id"]).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
    return n_rel.join(hits, "entity_id", "left").select(
        "entity_id", "n_rel",
        (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.col("n_rel")).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
    )


def metrics(recs: DataFrame, relevant: DataFrame, catalog_size: int, k: int = 10) -> DataFrame:
    """One row: means over entities with relevant items, and coverage over all lists."""
    m = per_entity_metrics(recs, relevant, k).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "ndcg", "rr", "hit")], F.count(F.lit(1)).alias("n_entities")
    )
    cover = recs.where(F.col("rank") <= k).agg((F.countDistinct("item_id") / F.lit(float(max(catalog_size, 1)))).alias("coverage"))
    return m.crossJoin(cover)  # one row each


def list_diversity(recs: DataFrame, similarity: DataFrame, k: int = 10) -> DataFrame:
    """``(entity_id, diversity)``: mean of 1 - similarity over the pairs of a list; ``similarity`` is ``(i, j, sim)``, i < j."""
    a = recs.where(F.col("rank") <= k)
    pairs = a.select("entity_id", F.col("item_id").alias("i")).join(a.select("entity_id", F.col("item_id").alias("j")), "entity_id").where("i < j")
    return pairs.join(similarity, ["i", "j"], "left").groupBy("entity_id").agg(F.avg(1.0 - F.coalesce("sim", F.lit(0.0))).alias("diversity"))


def popularity_lists(log: DataFrame, users: DataFrame, n: int = 10, mask: bool = True) -> DataFrame:
    """Everyone gets the most popular items they do not own.

    Items are numbered by popularity. An entity's own items leave gaps between their numbers, and
    its list is the first ``n`` numbers in those gaps: no entity is paired with more than ``n``
    items, however many another one owns.
    """
    places = stage(ranked(popularity(log), [F.col("n").desc(), F.col("item_id")], "pop_rank"))
    everyone = users.select("entity_id").distinct()
    end = everyone.withColumn("pop_rank", F.lit(places.count() + 1).cast("long"))
    taken = end
    if mask:
        owned = log.select("entity_id", "item_id").distinct().join(everyone, "entity_id", "left_semi")
        taken = owned.join(places.select("item_id", "pop_rank"), "item_id").select("entity_id", "pop_rank").unionByName(end)
    w = Window.partitionBy("entity_id").orderBy("pop_rank")
    gaps = taken.withColumn("low", F.coalesce(F.lag("pop_rank").over(w), F.lit(0))).withColumn("free", F.col("low") - F.row_number().over(w) + 1)
    gaps = gaps.withColumn("take", F.least(F.col("pop_rank") - F.col("low") - 1, F.lit(n) - F.col("free"))).where("take > 0")
    lists = gaps.select("entity_id", "low", "free", F.explode(F.sequence(F.lit(1), F.col("take").cast("int"))).alias("k"))
    lists = lists.select("entity_id", (F.col("free") + F.col("k")).cast("int").alias("rank"), (F.col("low") + F.col("k")).alias("pop_rank"))
    return lists.join(places, "pop_rank").select("entity_id", "rank", "item_id", F.col("n").cast("double").alias("score"))


def personal_frequency(log: DataFrame, n: int = 10) -> DataFrame:
    """Each entity's own most frequent items."""
    w = Window.partitionBy("entity_id").orderBy(F.col("cnt").desc(), F.col("item_id"))
    return multiplicity(log).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("entity_id", "rank", "item_id", F.col("cnt").cast("double").alias("score"))


def item_knn_edges(log: DataFrame, k: int = 200) -> DataFrame:
    """``(i, j, w)``: cosine of the binary item columns, the ``k`` strongest per item."""
    x = log.select("entity_id", "item_id").distinct()
    n = x.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    c = key_pairs(x.withColumnRenamed("entity_id", "k")).groupBy(F.col("x.item_id").alias("i"), F.col("y.item_id").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    c = c.join(n.select(F.col("item_id").alias("i"), F.col("n").alias("ni")), "i").join(n.select(F.col("item_id").alias("j"), F.col("n").alias("nj")), "j")
    half = c.select("i", "j", (F.col("c") / F.sqrt(F.col("ni") * F.col("nj"))).alias("w"))
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    w = Window.partitionBy("i").orderBy(F.round("w", 12).desc(), F.col("j"))
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def item_knn(log: DataFrame, n: int = 10, k: int = 200) -> DataFrame:
    """Lists by summed similarity of the entity's different items to their nearest items, owned ones left out."""
    owned = log.select("entity_id", "item_id").distinct()
    scores = owned.join(item_knn_edges(log, k), owned["item_id"] == F.col("i")).groupBy("entity_id", F.col("j").alias("item_id")).agg(F.sum("w").alias("score"))
    scores = scores.join(owned, ["entity_id", "item_id"], "left_anti")
    w = Window.partitionBy("entity_id").orderBy(F.round("score", 9).desc(), F.col("item_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("entity_id", "rank", "item_id", "score")


def als_lists(log: DataFrame, n: int = 10, factors: int = 64, reg: float = 0.01, iterations: int = 15, seed: int = 0) -> DataFrame:
    """Implicit ALS lists without owned items; ids must be whole numbers within INT."""
    from pyspark.ml.recommendation import ALS

    data = multiplicity(log).select(F.col("entity_id").cast("int").alias("u"), F.col("item_id").cast("int").alias("i"), F.col("cnt").cast("float").alias("r"))
    model = ALS(rank=factors, regParam=reg, maxIter=iterations, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="r", seed=seed).fit(data)
    # entities with up to 1, 2, 4, ... items of their own need that many candidates beyond n, and no others do
    sizes = stage(data.groupBy("u").agg(F.ceil(F.log2(F.count(F.lit(1)))).cast("int").alias("c")))
    raw = None
    for c in sorted(r[0] for r in sizes.select("c").distinct().collect()):  # about 30 classes at most
        part = model.recommendForUserSubset(sizes.where(F.col("c") == c).select("u"), n + 2**c)
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        raw = model.recommendForAllUsers(n)
    raw = raw.select("u", F.explode("recommendations").alias("e")).select("u", F.col("e.i").alias("i"), F.col("e.rating").alias("score"))
    raw = raw.join(data.select("u", "i"), ["u", "i"], "left_anti")
    w = Window.partitionBy("u").orderBy(F.col("score").desc(), F.col("i"))
    return raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(F.col("u").cast("bigint").alias("entity_id"), "rank", F.col("i").cast("bigint").alias("item_id"), F.col("score").cast("double").alias("score"))


def metrics_by_warmth(recs: DataFrame, relevant: DataFrame, train: DataFrame, k: int = 10) -> DataFrame:
    """Means of the metrics per history length bucket."""
    n = train.groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows"))
    m = per_entity_metrics(recs, relevant, k).join(n, "entity_id").withColumn("bucket", warmth(F.col("rows")))
    return m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_entities"), *[F.avg(c).alias(c) for c in ("precision", "recall", "ndcg", "rr", "hit")])

"""Item-item edges: co-occurrence by user, session and time, transitions, Gram matrix, transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.contract import HISTORY_ORDER

DAY = 86_400.0
#: Entries of a key up to which they are packed into one row and paired in place.
BLOCK = 2048


def mirrored(half: DataFrame, value: str = "w") -> DataFrame:
    """Both directions of edges given once as (i, j)."""
    return half.select("i", "j", value).unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), value))


def key_pairs(rows: DataFrame, key: str = "k") -> DataFrame:
    """``(x, y)``: structs of every two rows of a key with x.item_id < y.item_id; ``rows`` has the key, item_id and more.

    The rows of a key are counted where they lie after one shuffle by key. Keys of up to ``BLOCK``
    rows are packed to one row each there and paired in place. Larger ones are never brought to one
    task as pairs: their rows are dealt to blocks of about ``BLOCK`` and paired block against block.
    """
    more = [c for c in rows.columns if c not in (key, "item_id")]
    e = F.struct("item_id", *more)
    sized = rows.select(key, e.alias("e"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy(key)) / BLOCK).cast("int").alias("blocks"))
    packed = sized.where("blocks = 1").groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("l"))  # at most BLOCK rows
    left = packed.select("l", F.posexplode("l").alias("p", "x"))
    small = left.select("x", F.explode(F.expr("slice(l, p + 2, size(l))")).alias("y"))
    large = sized.where("blocks > 1").withColumn("b", F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int"))
    reach = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # a row of block b meets block c as the first of cell (b, c) or the second of cell (c, b)
    first = large.select(key, F.col("b").alias("bx"), reach.alias("by"), F.col("e").alias("x"))
    second = large.select(key, reach.alias("bx"), F.col("b").alias("by"), F.col("e").alias("y"))
    cells = first.hint("shuffle_merge").join(second, [key, "bx", "by"]).select("x", "y")
    return small.unionByName(cells).where(F.col("x.item_id") < F.col("y.item_id"))


def _summed(pairs: DataFrame, value: Column) -> DataFrame:
    rows = pairs.select(F.col("x.item_id").alias("i"), F.col("y.item_id").alias("j"), value.alias("w"))
    return rows.groupBy("i", "j").agg(F.sum("w").alias("w"))


def cooc_counts(log: DataFrame, key: str = "entity_id") -> DataFrame:
    """``(i, j, w)``, i < j: sum over the key's rows of the products of their weights.

    Rows are first folded to one weight per key and item, which gives the same sums as pairing
    every row with every other (the product of sums is the sum of products). Repeated rows thus
    count by multiplicity; pairs without any weight are left out.
    """
    g = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), "item_id").agg(F.sum("weight").alias("w")).where("w > 0")
    return _summed(key_pairs(g), F.col("x.w") * F.col("y.w"))


def cooc_temporal(log: DataFrame, half_life_days: float = 30.0, alpha: float = 1.0, key: str = "entity_id") -> DataFrame:
    """``(i, j, w)``, i < j: like ``cooc_counts``, each pair of rows lifted by how close in time it is.

    The lift is 1 + alpha / (1 + exp(dt / half life)), from 1 + alpha / 2 down to 1. Rows of one
    instant are folded first; a row without time gets no lift.
    """
    g = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), "item_id", "ts").agg(F.sum("weight").alias("w")).where("w > 0")
    lift = 1.0 + alpha / (1.0 + F.exp(F.abs(F.col("x.ts") - F.col("y.ts")) / (half_life_days * DAY)))
    return _summed(key_pairs(g), F.col("x.w") * F.col("y.w") * F.coalesce(lift, F.lit(1.0)))


def item_rows(log: DataFrame) -> DataFrame:
    """``(item_id, n)``: rows per item, the marginals of the transforms."""
    return log.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def transform_edges(edges: DataFrame, marginals: DataFrame, how: str, z: float = 1.96) -> DataFrame:
    """``(i, j, w)`` with w rescaled by the items' marginals (floored at 1): raw, cosine, jaccard or wilson.

    wilson is the smaller of the two lower bounds of w successes in n_i and in n_j trials.
    """
    if how == "raw":
        return edges
    a = marginals.select(F.col("item_id").alias("i"), F.greatest(F.col("n"), F.lit(1)).cast("double").alias("ni"))
    b = marginals.select(F.col("item_id").alias("j"), F.greatest(F.col("n"), F.lit(1)).cast("double").alias("nj"))
    e = edges.join(a, "i").join(b, "j")
    w, ni, nj = F.col("w"), F.col("ni"), F.col("nj")
    union = F.greatest(ni + nj - w, F.lit(1.0))
    if how == "cosine":
        out = w / F.sqrt(ni * nj)
    elif how == "jaccard":
        out = w / union
    elif how == "wilson":
        out = F.least(wilson_lower(w, ni, z), wilson_lower(w, nj, z))
    else:
        raise ValueError(f"unknown transform {how!r}")
    return e.select("i", "j", out.alias("w"))


def wilson_lower(hits: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval; the share is clipped to [0, 1]."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), hits / trials))
    zz = z * z
    spread = z * F.sqrt(p * (1.0 - p) / trials + zz / (4.0 * trials * trials))
    return (p + zz / (2.0 * trials) - spread) / (1.0 + zz / trials)


def transitions(log: DataFrame) -> DataFrame:
    """``(i, j, w)``: how often item j comes right after item i, by the product of the rows' weights.

    Rows without weight are skipped before adjacency; an item following itself makes no edge.
    """
    w = Window.partitionBy("entity_id").orderBy(*HISTORY_ORDER)
    step = log.where("weight > 0").select(
        F.col("item_id").alias("i"), F.lead("item_id").over(w).alias("j"), (F.col("weight") * F.lead("weight").over(w)).alias("p")
    )
    return step.where(F.col("j").isNotNull() & (F.col("i") != F.col("j"))).groupBy("i", "j").agg(F.sum("p").alias("w"))


def symmetrized(edges: DataFrame) -> DataFrame:
    """``(i, j, w)``: the edges plus their reverse, summed."""
    return mirrored(edges).groupBy("i", "j").agg(F.sum("w").alias("w"))


def gram(log: DataFrame, use_weights: bool = False) -> DataFrame:
    """``(i, j, w)``, i <= j: X'X of the entity-item matrix, binary or with the largest weight per cell.

    With weights, cells of weight 0 are left out; without, every row makes its cell 1.
    """
    cells = log.groupBy(F.col("entity_id").alias("k"), "item_id").agg((F.max("weight") if use_weights else F.lit(1.0)).alias("w")).where("w > 0")
    diagonal = cells.groupBy(F.col("item_id").alias("i")).agg(F.sum(F.col("w") * F.col("w")).alias("w"))
    return _summed(key_pairs(cells), F.col("x.w") * F.col("y.w")).unionByName(diagonal.select("i", F.col("i").alias("j"), "w"))


class ItemGraph:
    """Symmetric item graph without loops: largest weight per entity and item, then X'X."""

    def __init__(self, edges: DataFrame):
        self.edges = edges  # i < j, w > 0

    @classmethod
    def build(cls, log: DataFrame) -> ItemGraph:
        return cls(gram(log, use_weights=True).where("i < j"))

    def neighbors(self, top_k: int, item: object | None = None) -> DataFrame:
        """``(i, j, w, rank)``: the strongest neighbours of one or all items; unknown items have none."""
        both = mirrored(self.edges).where("w > 0")
        if item is not None:
            both = both.where(F.col("i") == F.lit(item))
        order = Window.partitionBy("i").orderBy(F.col("w").desc(), F.col("j"))
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)

    def prune_below(self, threshold: float) -> tuple[ItemGraph, int, float]:
        """The graph without edges lighter than the threshold, the directed entries cut and their weight."""
        gone = self.edges.where(F.col("w") < threshold).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
        return ItemGraph(self.edges.where(F.col("w") >= threshold)), 2 * gone["n"], 2 * gone["w"]

"""The N best items of every group, with one fixed order among equal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import cut

#: Buckets per doubling of the score in the histograms (one bucket is about 1.1 % wide).
RESOLUTION = 64
#: At most this many groups can count as heavy; it bounds what is broadcast.
MAX_HEAVY = 20_000


def score_bucket(s: Column, resolution: int = RESOLUTION) -> Column:
    """A whole number that never falls when the score rises, over the whole range of DOUBLE."""
    size = F.floor(F.log2(F.abs(s)) * resolution).cast("long") + 1100 * resolution
    return F.when(s > 0, size).when(s < 0, -size).otherwise(F.lit(0).cast("long"))


def safe_thresholds(rows: DataFrame, n: int) -> DataFrame:
    """``(_g, _floor)``: per group the highest bucket with at least ``n`` different items in or above it.

    A histogram cell does not hold a count (repeated rows would make it too high) but words of
    bits, one bit set per hashed item. The bits set are a lower bound of the different items, so
    the threshold is safe: whatever is dropped below it cannot be among the first ``n``. Groups
    for which the bound stays under ``n`` get no threshold and keep all rows.
    """
    words = max(1, -(-n // 24))
    h = F.xxhash64(F.col("_i"))
    cells = rows.withColumn("_b", score_bucket(F.col("_s"))).groupBy("_g", "_b").agg(
        *[
            F.bit_or(F.when(F.pmod(h, F.lit(words)) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}")
            for w in range(words)
        ]
    )
    down = Window.partitionBy("_g").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    bits = sum((F.bit_count(F.bit_or(f"_w{w}").over(down)) for w in range(1, words)), F.bit_count(F.bit_or("_w0").over(down)))
    return cells.withColumn("_bits", bits).where(F.col("_bits") >= n).groupBy("_g").agg(F.max("_b").alias("_floor"))


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5, heavy_rows: int | None = None) -> DataFrame:
    """``(group, rank_no, item, score)``: the ``n`` best items of every group, ranks from 1.

    Groups of at least ``heavy_rows`` rows get a score histogram from which a safe threshold is
    read; their rows below it are dropped where they are read, before any shuffle. What is left is
    folded to one row per group and item and ranked exactly, ties by the smaller item; the ranking
    keeps at most ``n`` rows per group and task before it shuffles. ``heavy_rows`` is at least a
    ``MAX_HEAVY``-th of all rows, so the broadcast thresholds are bounded whatever the data.

    Null, NaN and infinite scores and null items do not count. Of several rows for one item the
    highest score counts; 0.0 and -0.0 are equal. A null group is a group of its own. Groups with
    fewer than ``n`` items give what they have; an empty table gives no row.
    """
    s = F.col(score).cast("double")
    rows = (
        df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.when(s == 0, F.lit(0.0)).otherwise(s).alias("_s"))
        .where(F.col("_i").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
        .where(F.abs("_s") < F.lit(float("inf")))
    )
    total = rows.count()
    limit = max(heavy_rows or 50 * n, -(-total // MAX_HEAVY), 1)
    heavy = cut(rows.groupBy("_g").count().where(F.col("count") >= limit).select(F.col("_g").alias("_hg")))
    of_heavy = rows.join(F.broadcast(heavy), F.col("_g").eqNullSafe(F.col("_hg")), "left_semi")
    floors = safe_thresholds(of_heavy, n).withColumnRenamed("_g", "_hg")
    kept = (
        rows.join(F.broadcast(floors), F.col("_g").eqNullSafe(F.col("_hg")), "left")
        .where(F.col("_floor").isNull() | (score_bucket(F.col("_s")) >= F.col("_floor")))
        .groupBy("_g", "_i")
        .agg(F.max("_s").alias("_s"))
    )
    order = Window.partitionBy("_g").orderBy(F.col("_s").desc(), F.col("_i"))
    return (
        kept.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= n)
        .select(F.col("_g").alias(group), F.col("_r").cast("int").alias("rank_no"), F.col("_i").alias(item), F.col("_s").alias(score))
    )

"""Ranks, quantiles and first rows of a whole table without bringing it to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import stage

#: Values up to which one task may sort them.
FEW = 1_000_000


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1: ranges are sorted apart and offset by the rows before them."""
    tasks = max(2, df.sparkSession.sparkContext.defaultParallelism)
    parts = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    parts = stage(parts.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_k")))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = parts.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_k") + 1).drop("_p", "_k", "_o")


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles (linear between neighbours) of the known values of a column; None where there are none.

    Up to ``FEW`` values are sorted by one task. Beyond, a bracket around each wanted place is taken
    from an approximate sketch and narrowed by counting until it holds few values.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = v.count()
    if n == 0:
        return None
    if n <= FEW:
        return list(v.agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares]))).first()[0])
    out = []
    for s in shares:
        at = s * (n - 1)
        low = _kth(v, math.floor(at), n)
        high = low if at == math.floor(at) else _kth(v, math.floor(at) + 1, n)
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def _kth(v: DataFrame, k: int, n: int) -> float:
    """The k-th smallest value, from 0."""
    while n > FEW:
        p = k / (n - 1)
        a, b = v.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, p - 0.001)), F.lit(min(1.0, p + 0.001))), 10_000)).first()[0]
        c = v.agg(F.count_if(F.col("v") < a).alias("below"), F.count_if(F.col("v").between(a, b)).alias("inside")).first()
        if not c["below"] <= k < c["below"] + c["inside"]:  # the sketch was off: go to the right side of it
            inside = F.col("v") < a if k < c["below"] else F.col("v") > b
            k, n = (k, c["below"]) if k < c["below"] else (k - c["below"] - c["inside"], n - c["below"] - c["inside"])
            v = v.where(inside)
            continue
        if a == b:
            return a
        v, k = v.where(F.col("v").between(a, b)), k - c["below"]
        if c["inside"] == n:
            break
        n = c["inside"]
    return v.agg(F.percentile("v", k / max(n - 1, 1))).first()[0]


def first_rows_by_hash(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly the first ``n`` rows in the order of an md5 of their values; fewer rows are part of more.

    The last hash that is in is found by counting its leading digits, then the next ones; of equal
    rows with that hash as many as there is room for are taken.
    """
    text = [F.col(c).cast("decimal(38,6)").cast("string") if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes]
    rows = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(t, F.lit("")) for t in text])))
    if n <= 0:
        return df.where(F.lit(False))
    prefix, room = "", n
    for digits in (4, 8, 32):
        head = F.substring("_h", 1, digits)
        counts = rows.where(F.col("_h").startswith(prefix)).groupBy(head.alias("c")).count()
        w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 rows, then those of one prefix
        hit = counts.withColumn("cum", F.sum("count").over(w)).where(F.col("cum") >= room).orderBy("c").limit(1).collect()
        if not hit:
            return df
        prefix, room = hit[0]["c"], room - (hit[0]["cum"] - hit[0]["count"])
    return rows.where(F.col("_h") < prefix).unionByName(rows.where(F.col("_h") == prefix).limit(room)).drop("_h")

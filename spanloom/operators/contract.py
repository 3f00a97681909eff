"""The interaction contract: validation, canonical columns, weights, catalog and history order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.runtime import cut, seconds

CORE = ["entity_id", "item_id"]
OPTIONAL = ["timestamp", "session_id", "action_type", "rating"]
#: Actions an interaction may carry.
ACTIONS = ["add", "remove", "positive_rating", "negative_rating", "rate", "view", "review", "purchase", "checkin"]
WEIGHT = "weight"


class ContractError(ValueError):
    """An interaction table that breaks the contract."""


@dataclass(frozen=True)
class InteractionSchema:
    has_timestamp: bool
    has_session: bool
    has_action: bool
    has_rating: bool


def violations(df: DataFrame) -> DataFrame:
    """One row of counts: rows, null ids, unreadable times, unknown actions, null sessions. Columns that are absent count 0."""
    types = dict(df.dtypes)

    def count(c: str, bad) -> Column:
        return F.count_if(bad(F.col(c))) if c in types else F.lit(0).cast("long")

    bad_time = (lambda c: c.isNotNull() & F.try_to_timestamp(c).isNull()) if types.get("timestamp") == "string" else (lambda c: c.isNull())
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count("entity_id", lambda c: c.isNull()).alias("null_entity"),
        count("item_id", lambda c: c.isNull()).alias("null_item"),
        count("timestamp", bad_time).alias("bad_timestamp"),
        count("action_type", lambda c: c.isNotNull() & ~c.isin(ACTIONS)).alias("unknown_action"),
        count("session_id", lambda c: c.isNull()).alias("null_session"),
    )


def validate(df: DataFrame) -> InteractionSchema:
    """Check a table against the contract in one pass; raise ``ContractError`` with the reason, else say what it has."""
    missing = [c for c in CORE if c not in df.columns]
    if missing:
        raise ContractError(f"interactions lack required columns: {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    if "rating" in types and not isinstance(types["rating"], T.NumericType):
        raise ContractError(f"rating must be numeric, got {types['rating'].simpleString()}")
    if "timestamp" in types and not isinstance(types["timestamp"], (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType, T.NumericType)):
        raise ContractError(f"timestamp can't be read as a time: {types['timestamp'].simpleString()}")
    n = violations(df).first()
    if n["n_rows"] == 0:
        raise ContractError("interactions are empty")
    for c in ("entity", "item"):
        if n[f"null_{c}"]:
            raise ContractError(f"{c}_id has {n[f'null_{c}']} nulls")
    if n["bad_timestamp"]:
        raise ContractError(f"timestamp has {n['bad_timestamp']} rows that are no time")
    if n["unknown_action"]:
        seen = sorted(r[0] for r in df.where(F.col("action_type").isNotNull() & ~F.col("action_type").isin(ACTIONS)).select("action_type").distinct().limit(20).collect())
        raise ContractError(f"unknown action_type values: {seen}")
    if n["null_session"]:
        raise ContractError(f"session_id has {n['null_session']} nulls")
    return InteractionSchema("timestamp" in types, "session_id" in types, "action_type" in types, "rating" in types)


def canonical(df: DataFrame) -> DataFrame:
    """Core and known optional columns in fixed order; times as TIMESTAMP_NTZ or numbers; all else dropped."""
    out = []
    for c in CORE + [c for c in OPTIONAL if c in df.columns]:
        col = F.col(c)
        if c == "timestamp" and dict(df.dtypes)[c] in ("string", "date", "timestamp"):
            col = F.try_to_timestamp(col).cast("timestamp_ntz") if dict(df.dtypes)[c] == "string" else col.cast("timestamp_ntz")
        out.append(col.alias(c))
    return df.select(*out)


def rating_weight(rating: Column, threshold: float = 2.5, top: float = 5.0) -> Column:
    """0 at or below the threshold, 1 at the top of the scale, linear between; a missing rating weighs 1."""
    r = rating.cast("double")
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (r - threshold) / (top - threshold)))
    return F.when(r.isNull() | F.isnan(r), F.lit(1.0)).otherwise(scaled)


def weighted(df: DataFrame, use_ratings: bool | None = None, threshold: float = 2.5, top: float = 5.0) -> DataFrame:
    """``df`` with a weight in [0, 1] per row: from the rating where there is one and it is wanted, else 1."""
    has = "rating" in df.columns
    if use_ratings and not has:
        raise ContractError("use_ratings needs a rating column")
    if top <= threshold:
        raise ValueError("the top of the scale must lie above the threshold")
    use = has if use_ratings is None else use_ratings
    return df.withColumn(WEIGHT, rating_weight(F.col("rating"), threshold, top) if use else F.lit(1.0))


def to_log(df: DataFrame, use_ratings: bool | None = None) -> DataFrame:
    """The internal form of a log: ``entity_id, item_id, ts (epoch seconds), session_id, weight``."""
    types = dict(df.dtypes)
    ts = F.lit(None).cast("double")
    if "timestamp" in types:
        t = F.col("timestamp")
        ts = t.cast("double") if types["timestamp"] in ("int", "bigint", "double", "float", "smallint") or types["timestamp"].startswith("decimal") else seconds(t)
    sid = F.col("session_id") if "session_id" in types else F.lit(None).cast("long")
    return weighted(df, use_ratings).select("entity_id", "item_id", ts.alias("ts"), sid.alias("session_id"), F.col(WEIGHT).cast("double").alias("weight"))


#: The total order of a history: time first, then what tells rows of one instant apart.
HISTORY_ORDER = ["ts", "session_id", "item_id", "weight"]


def history(log: DataFrame) -> DataFrame:
    """``log`` with ``pos`` (1 = oldest) and ``n`` (length) within each entity, repeated rows kept."""
    w = Window.partitionBy("entity_id")
    return log.withColumn("pos", F.row_number().over(w.orderBy(*HISTORY_ORDER))).withColumn("n", F.count(F.lit(1)).over(w))


def dense_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """``(col, name)``: the distinct values numbered from 0 in ascending order.

    Values are range-partitioned and written once; a partition's numbers start where the counts of
    those before it end. No task sorts more than its range.
    """
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    ranged = cut(df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(parts, col).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = F.broadcast(sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy("_p").orderBy(col)
    return ranged.join(offsets, "_p").select(col, (F.col("_off") + F.row_number().over(inside) - 1).alias(name))


def catalog(log: DataFrame, metadata: DataFrame | None = None, max_extension: int | None = None) -> DataFrame:
    """``(item_id, item_idx, is_train)``: items of the log first, then items only the metadata knows.

    ``max_extension`` keeps the first so many extension items in id order (None: all).
    """
    train = dense_index(log, "item_id", "item_idx").withColumn("is_train", F.lit(True))
    if metadata is None or max_extension == 0:
        return train
    extra = metadata.select("item_id").where(F.col("item_id").isNotNull()).distinct().join(train, "item_id", "left_anti")
    if max_extension is not None:
        extra = extra.orderBy("item_id").limit(max_extension)
    n = train.count()
    return train.unionByName(dense_index(extra, "item_id", "item_idx").select("item_id", (F.col("item_idx") + n).alias("item_idx"), F.lit(False).alias("is_train")))


def extension_cap(total_ram: int, n_rows: int, n_items: int, override: int | None = None) -> int:
    """How many metadata-only items a machine of ``total_ram`` bytes can take on, by the reference's memory model."""
    if override is not None:
        return override
    gib = 1024**3
    usable = min(0.8 * total_ram, total_ram - 6 * gib)
    room = usable - (400 * n_rows + 39_800 * n_items)
    return max(0, int(room // 30_000))

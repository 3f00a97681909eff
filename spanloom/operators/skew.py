"""Per-key results where a few keys hold most rows: fragment-replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import stage


@dataclass
class LoadPlan:
    """Where the rows of each key go.

    ``shards`` lists the heavy keys with the tasks that hold one shard each; every other key falls
    into one of ``len(bins)`` hash bins, and ``bins`` gives each bin's task. ``loads`` are the
    rows planned per task.
    """

    key: str
    tasks: int
    total: int
    shards: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    bins: list[int] = field(default_factory=list)
    loads: list[int] = field(default_factory=list)

    def slots(self) -> list[int]:
        """For each task a number that Spark's hash partitioning into ``tasks`` parts sends there.

        Rows partitioned by such a number lie where the plan wants them, and Spark knows the
        partitioning: aggregations and joins that have the number among their keys move nothing.
        """
        found: dict[int, int] = {}
        n = 0
        while len(found) < self.tasks:
            found.setdefault(_hash_of_int(n) % self.tasks, n)
            n += 1
        return [found[t] for t in range(self.tasks)]

    def bin_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(len(self.bins))).cast("int")

    def frame(self, df: DataFrame) -> DataFrame:
        """``(_hk, _tasks)`` of the heavy keys; at most ``4 x tasks`` rows by construction."""
        spark, kind = df.sparkSession, dict(df.dtypes)[self.key]
        rows = [(k, t) for k, t in self.shards.items()]
        return spark.createDataFrame(rows, f"_hk {kind}, _tasks array<int>")


def _hash_of_int(value: int, seed: int = 42) -> int:
    """Murmur3 (32 bits, x86) of one INT, signed: what ``hash()`` and hash partitioning use."""
    mask = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    h = seed ^ turn(value * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h = (turn(h, 13) * 5 + 0xE6546B64) & mask ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def plan_loads(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """Count rows per key, split keys heavier than a quarter of a task's share, bin-pack the rest.

    The counts combine map-side. Only keys of at least total / (4 x tasks) rows are heavy, so at
    most 4 x tasks of them come to the driver, with one number per hash bin. A heavy key of w
    rows gets ceil(w / share) shards, share being total / tasks; shards and bins are then put,
    largest first, on the task with the least load. Null keys are not heavy keys: they belong to
    no key and are left to their hash bin.
    """
    tasks = tasks or max(2, df.sparkSession.sparkContext.defaultParallelism)
    counts = stage(df.groupBy(F.col(key).alias("_hk")).count())  # the only read of ``df``
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    plan = LoadPlan(key, tasks, total, bins=[0] * (8 * tasks), loads=[0] * tasks)
    if total == 0:
        return plan
    floor = -(-total // (4 * tasks))
    heavy = counts.where((F.col("count") >= floor) & F.col("_hk").isNotNull()).collect()  # at most 4 x tasks rows
    plan.counts = {r["_hk"]: r["count"] for r in heavy}
    light = counts.where((F.col("count") < floor) | F.col("_hk").isNull())
    bin_rows = {r["b"]: r["n"] for r in light.groupBy(plan.bin_of(F.col("_hk")).alias("b")).agg(F.sum("count").alias("n")).collect()}  # at most 8 x tasks rows
    share = -(-total // tasks)
    pieces = [(n, None, b) for b, n in bin_rows.items()]
    for k, n in plan.counts.items():
        parts = -(-n // share)
        pieces += [(-(-n // parts), k, i) for i in range(parts)]
    open_tasks = [(0, t) for t in range(tasks)]
    heapq.heapify(open_tasks)
    shards: dict = {k: [] for k in plan.counts}
    for n, k, b in sorted(pieces, key=lambda p: (-p[0], str(p[1]), p[2])):
        load, t = heapq.heappop(open_tasks)
        if k is None:
            plan.bins[b] = t
        else:
            shards[k].append(t)
        heapq.heappush(open_tasks, (load + n, t))
        plan.loads[t] = load + n
    plan.shards = shards
    return plan


def assign_tasks(df: DataFrame, plan: LoadPlan, spread_by: Column | None = None) -> DataFrame:
    """``df`` with ``_shard`` (which shard of its key), ``_task`` (where the plan puts it) and ``_slot`` (the task's number to partition by).

    ``spread_by`` decides the shard of a heavy key's row; rows equal in it stay together.
    """
    by = F.xxhash64(spread_by) if spread_by is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    heavy = F.broadcast(plan.frame(df))
    bins = F.array(*[F.lit(t) for t in plan.bins])
    rows = df.join(heavy, F.col(plan.key) == F.col("_hk"), "left")
    shard = F.when(F.col("_tasks").isNotNull(), F.pmod(by, F.size("_tasks")).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("_shard", shard)
    task = F.when(F.col("_tasks").isNotNull(), F.element_at("_tasks", F.col("_shard") + 1)).otherwise(F.element_at(bins, plan.bin_of(F.col(plan.key)) + 1))
    return _slotted(rows.withColumn("_task", task).drop("_hk", "_tasks"), plan)


def _slotted(rows: DataFrame, plan: LoadPlan) -> DataFrame:
    return rows.withColumn("_slot", F.element_at(F.array(*[F.lit(s) for s in plan.slots()]), F.col("_task") + 1))


def per_key(df: DataFrame, plan: LoadPlan, partial: dict[str, Column], final: dict[str, Column], spread_by: Column | None = None) -> DataFrame:
    """Aggregate per key on the planned tasks: ``partial`` per shard, then ``final`` over the shards.

    With ``spread_by`` all rows of a key that agree in it meet in one shard, so distinct counts of
    it can be added up. One row per key and shard is all that moves after the first step. Rows that
    ``fragment_replicate_join`` left in place (``keep_place``) are not moved at all.
    """
    placed = df if {"_slot", "_shard"} <= set(df.columns) else assign_tasks(df, plan, spread_by).repartition(plan.tasks, "_slot")
    once = placed.groupBy("_slot", plan.key, "_shard").agg(*[c.alias(n) for n, c in partial.items()])
    return once.groupBy(plan.key).agg(*[c.alias(n) for n, c in final.items()])


def fragment_replicate_join(big: DataFrame, small: DataFrame, plan: LoadPlan, how: str = "inner", spread_by: Column | None = None, keep_place: bool = False) -> DataFrame:
    """``big`` joined to ``small`` on the plan's key on the planned tasks.

    A heavy key's rows of ``small`` are copied to the tasks that hold one of its shards, and to no
    other; all other rows go to their bin's task. ``small`` has the key under the same name; its
    other columns must not clash with ``big``'s. ``how`` is inner, left, left_semi or left_anti.
    Rows of a null key match nothing. With ``keep_place`` the result has ``_slot`` and ``_shard``
    and lies where the plan put it, for ``per_key``.

    The session is told that joins may rely on a partitioning by part of their keys; otherwise
    Spark would partition both sides by slot, key and shard together and undo the placement.
    """
    big.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    placed = assign_tasks(big, plan, spread_by).drop("_task").repartition(plan.tasks, "_slot")
    heavy = F.broadcast(plan.frame(big))
    copies = small.join(heavy, F.col(plan.key) == F.col("_hk"), "left")
    bin_task = F.element_at(F.array(*[F.lit(t) for t in plan.bins]), plan.bin_of(F.col(plan.key)) + 1)
    copies = copies.select("*", F.posexplode(F.coalesce("_tasks", F.array(bin_task))).alias("_shard", "_task")).drop("_hk", "_tasks")
    copies = _slotted(copies, plan).drop("_task").repartition(plan.tasks, "_slot")
    out = placed.hint("merge").join(copies, ["_slot", plan.key, "_shard"], how)
    return out if keep_place else out.drop("_slot", "_shard")


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.02, tasks: int | None = None) -> DataFrame:
    """``(key_field, key_id, n_rows)``: every value of each key column that holds at least ``share`` of all rows.

    The row counts come from the balanced per-key results (``plan_loads`` and ``per_key``). Nulls
    are no key. An empty table has no heavy key.
    """
    out = None
    for k in keys:
        plan = plan_loads(df.select(k), k, tasks)
        rows = per_key(df.select(k), plan, {"n": F.count(F.lit(1))}, {"n_rows": F.sum("n")}, F.monotonically_increasing_id())
        part = rows.where(F.col(k).isNotNull() & (F.col("n_rows") >= share * plan.total)).select(F.lit(k).alias("key_field"), F.col(k).alias("key_id"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out

"""Filling containers of fixed capacity: tiers by length, gaps of long windows filled from shorter tiers."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import spread, stage

#: Pattern that cuts text into pieces before byte pairs are merged (public byte-level BPE).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items aimed at per rank shard.
SHARD_ROWS = 250_000


@lru_cache(maxsize=2)
def _encoder(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("pack", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    return os.environ.get("SPANLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def token_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``: length of every text in tokens of a public byte-level BPE vocabulary.

    ``tokenizer`` is the path of a ranks file, readable on every executor. Null texts have 0
    tokens. Whole texts are counted, in Arrow batches, without a shuffle.
    """
    path = tokenizer or default_tokenizer()
    kind = dict(df.dtypes)[doc_id]

    def run(batches):
        enc = _encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["_id", "n_tokens"])

    src = spread(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")))
    return src.mapInArrow(run, f"_id {kind}, n_tokens int").withColumnRenamed("_id", doc_id)


class Bins:
    """Containers of one capacity, open gaps kept by size. Equal containers are ranges of numbers, so work goes by sizes, not items."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.gaps: list[int] = []  # sorted
        self.at: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first, count)

    def _put(self, gap: int, first: int, count: int) -> None:
        if gap not in self.at:
            self.at[gap] = []
            insort(self.gaps, gap)
        self.at[gap].append((first, count))

    def fill(self, size: int, count: int, grow: bool = True) -> list[tuple[int, int, int, int]]:
        """Put ``count`` items of ``size`` into the least gaps that hold them, then, with ``grow``, into new containers.

        Returns ``(items before, items, first container, items per container)``; items that found
        no gap are missing if the bins may not grow.
        """
        out, done = [], 0
        while done < count and (i := bisect_left(self.gaps, size)) < len(self.gaps):
            gap = self.gaps[i]
            first, have = self.at[gap].pop()
            take = min(count - done, have)
            if take < have:
                self.at[gap].append((first + take, have - take))
            if not self.at[gap]:
                del self.at[gap], self.gaps[i]
            out.append((done, take, first, 1))
            self._put(gap - size, first, take)
            done += take
        if grow and done < count:
            per = self.capacity // size
            for n, each in (((count - done) // per, per), (1, (count - done) % per)):
                if n and each:
                    out.append((done, n * each, self.made, each))
                    self._put(self.capacity - each * size, self.made, n)
                    self.made, done = self.made + n, done + n * each
        return out

    def ranges(self) -> list[tuple[int, int, int]]:
        """``(first, count, fill)`` of all containers."""
        return [(first, count, self.capacity - gap) for gap, ranges in self.at.items() for first, count in ranges]


@dataclass
class Plan:
    """Where items go: by size and rank into windows, by number from windows into containers."""

    slots: list[tuple[int, int, int, int, int]]  # size, first rank, items, first window, items per window
    windows: list[tuple[int, int, int, int]]  # first window, windows, first container, windows per container
    containers: list[tuple[int, int, int, int]]  # first container, containers, fill, tier that opened it


def tiers_of(capacity: int, tiers: list[int]) -> list[int]:
    """The context sizes used for a capacity, ascending; the capacity is the longest."""
    return [*sorted(t for t in set(tiers) if 0 < t < capacity), capacity]


def plan_containers(hist: dict[int, int], capacity: int, tiers: list[int]) -> Plan:
    """Hierarchical packing of a histogram of item sizes.

    An item belongs to the shortest tier that holds it. Tiers are taken from the longest down. A
    tier's items first fill gaps that the containers of longer tiers left. What remains is packed
    into windows of the tier's own size, and the windows, fullest first, are put into containers,
    whose gaps the next shorter tier starts with. All choices are best fit on sizes, longest first:
    items of a size are alike, so the cost is bounded by the capacity and not by the data.
    """
    box, plan, n_windows = Bins(capacity), Plan([], [], []), 0
    bounds = [0, *tiers_of(capacity, tiers)]
    opened = []
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        left = {}
        for size in range(high, low, -1):
            if not hist.get(size):
                continue
            done = 0
            for before, n, first, _ in box.fill(size, hist[size], grow=False):
                plan.slots.append((size, before, n, n_windows, 1))  # each a window of its own
                plan.windows.append((n_windows, n, first, 1))
                n_windows, done = n_windows + n, before + n
            left[size] = done
        own = Bins(high)
        for size, done in left.items():
            plan.slots += [(size, done + before, n, n_windows + first, per) for before, n, first, per in own.fill(size, hist[size] - done)]
        for first, count, fill in sorted(own.ranges(), key=lambda r: (-r[2], r[0])):
            plan.windows += [(n_windows + first + before, n, container, per) for before, n, container, per in box.fill(fill, count)]
        n_windows += own.made
        opened.append((box.made, high))
    for first, count, fill in box.ranges():
        while count:  # container numbers grow from tier to tier
            end, tier = next(x for x in opened if x[0] > first)
            n = min(count, end - first)
            plan.containers.append((first, n, fill, tier))
            first, count = first + n, count - n
    return plan


def step_groups(containers: list[tuple[int, int, int, int]], group_size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First ids and load ranks of the container ranges, and the number of groups.

    Containers ranked by tier and fill are dealt to the groups in turns, back and forth, so every
    group of a step carries nearly the same number of tokens from each tier.
    """
    total = sum(c[1] for c in containers)
    groups = max(1, -(-total // group_size))
    ranks, r = [], 0
    for first, count, _, _ in sorted(containers, key=lambda c: (-c[3], -c[2], c[0])):
        ranks.append((first, r))
        r += count
    ranks.sort()
    return np.array([f for f, _ in ranks], np.int64), np.array([r for _, r in ranks], np.int64), groups


def pack(sizes: DataFrame, capacity: int, tiers: list[int], doc_id: str = "doc_id", group_size: int = 64) -> DataFrame:
    """``(doc_id, piece_no, n_tokens, tier, container_id, step_group)`` for one container size.

    ``sizes`` has ``doc_id`` and ``n_tokens``. A document is divided (into full containers and a
    rest) only if it alone is larger than the capacity. ``tier`` is the context size the piece is
    routed to. Documents without tokens need no room and give no row. Only the histogram of sizes
    (at most ``capacity`` rows) comes to the driver; the items get their rank within a size by hash
    shards, so a size that most documents share is spread over many tasks, and find their container
    through the plan, which is at most some tens of thousands of number rows.
    """
    n = F.col("n_tokens")
    items = sizes.where(n > 0).select(
        F.col(doc_id).alias("_id"), F.posexplode(F.sequence(F.lit(1), F.ceil(n / capacity).cast("int"))).alias("_p", "_q"), n.alias("_n")
    ).select("_id", F.col("_q").alias("_piece"), F.least(F.lit(capacity), F.col("_n") - F.col("_p") * capacity).cast("int").alias("_size"))
    hist = {r["_size"]: r["count"] for r in items.groupBy("_size").count().collect()}  # at most `capacity` rows
    plan = plan_containers(hist, capacity, tiers)
    firsts, ranks, groups = step_groups(plan.containers, group_size)
    span = max(hist.values(), default=1) + 1
    slots = np.array(sorted((s * span + r, r, w, per) for s, r, _, w, per in plan.slots), np.int64).reshape(-1, 4)
    windows = np.array(sorted((w, c, per) for w, _, c, per in plan.windows), np.int64).reshape(-1, 3)
    shared = sizes.sparkSession.sparkContext.broadcast((slots, windows, firsts, ranks))

    shards = max(8, -(-sum(hist.values()) // SHARD_ROWS))
    sharded = items.withColumn("_shard", F.pmod(F.xxhash64("_id", "_piece"), F.lit(shards)).cast("int"))
    counts = sharded.groupBy("_size", "_shard").count()
    before = Window.partitionBy("_size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_size", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_size", "_shard").orderBy("_id", "_piece")
    ranked = sharded.join(offsets, ["_size", "_shard"]).withColumn("_rank", F.col("_off") + F.row_number().over(inside) - 1)

    @F.pandas_udf("container_id long, step_group long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slots, windows, firsts, ranks = shared.value
        s = slots[np.searchsorted(slots[:, 0], size.to_numpy(np.int64) * span + rank.to_numpy(np.int64), side="right") - 1]
        w = s[:, 2] + (rank.to_numpy(np.int64) - s[:, 1]) // s[:, 3]
        r = windows[np.searchsorted(windows[:, 0], w, side="right") - 1]
        c = r[:, 1] + (w - r[:, 0]) // r[:, 2]
        j = np.searchsorted(firsts, c, side="right") - 1
        turn, g = np.divmod(ranks[j] + c - firsts[j], groups)
        return pd.DataFrame({"container_id": c, "step_group": np.where(turn % 2, groups - 1 - g, g)})

    tier = F.element_at(F.filter(F.array(*[F.lit(t) for t in tiers_of(capacity, tiers)]), lambda t: t >= F.col("_size")), 1)
    return ranked.withColumn("_at", place("_size", "_rank")).select(
        F.col("_id").alias(doc_id), F.col("_piece").alias("piece_no"), F.col("_size").alias("n_tokens"), tier.cast("int").alias("tier"),
        F.col("_at.container_id").alias("container_id"), F.col("_at.step_group").alias("step_group"),
    )


def pack_all(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None, group_size: int = 64, sizes: DataFrame | None = None) -> DataFrame:
    """``pack`` for every row of ``targets`` (target_id, capacity_tokens), with ``target_id`` in front.

    Documents are tokenised once. The context tiers of a target are all smaller targets and its own
    size. ``targets`` names container sizes and is read by the driver;
    null or non-positive capacities are refused. ``sizes`` gives token counts known already. Repeated documents are packed as they come.
    """
    sizes = stage(token_counts(docs.select("doc_id", "text"), tokenizer=tokenizer)) if sizes is None else sizes
    want = sorted({(r["target_id"], r["capacity_tokens"]) for r in targets.select("target_id", "capacity_tokens").collect()})
    if any(c is None or c <= 0 for _, c in want):
        raise ValueError("capacities must be positive")
    tiers = sorted({c for _, c in want})
    out = None
    for t, c in want:
        part = pack(sizes, c, tiers, group_size=group_size).select(F.lit(t).alias("target_id"), "*")
        out = part if out is None else out.unionByName(part)
    return out

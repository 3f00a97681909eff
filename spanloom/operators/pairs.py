"""Transformed co-occurrence edges without a row per pair: packed histories go to blocks of items, pairs are summed in arrays there."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import edges as ed
from spanloom.operators import sparse as sp
from spanloom.operators.classes import spans
from spanloom.runtime import stage

#: Pairs that a task makes at once, and history entries for which there is one block.
AT_ONCE, PER_BLOCK = 2_000_000, 1_500_000


def _least(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest type that holds it exactly."""
    if x.dtype.kind == "f" and not (np.all(x == np.floor(x)) and np.all((x >= 0) & (x < 2**32))):
        return x
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _wilson(w: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
    p, zz = np.clip(w / n, 0.0, 1.0), z * z
    return (p + zz / (2.0 * n) - z * np.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n))) / (1.0 + zz / n)


def transformed(x: np.ndarray, ni: np.ndarray, nj: np.ndarray, how: str, z: float = 1.96) -> np.ndarray:
    """``edges.transform_edges`` of weights ``x`` between items of ``ni`` and ``nj`` rows."""
    if how == "cosine":
        return x / np.sqrt(ni * nj)
    if how == "jaccard":
        return x / np.maximum(ni + nj - x, 1.0)
    return np.minimum(_wilson(x, ni, z), _wilson(x, nj, z)) if how == "wilson" else x


def cooc_edges(log: DataFrame, how: str, key: str = "entity_id", z: float = 1.96) -> DataFrame:
    """``(i, j, w)``, i < j: ``edges.transform_edges`` of ``edges.cooc_counts`` and ``edges.item_rows``.

    Items are numbered and dealt to blocks. A key's list goes to each block that has one of its
    items, up to the last of them; a block makes the pairs whose larger item it has, item by item.
    Other ids than whole numbers, or more items than may be sent, are left to the joins.
    """
    kind = dict(log.dtypes)["item_id"]
    t = ed.item_rows(log).limit(sp.MAX_COLUMNS + 1).toArrow() if kind in ("bigint", "int") else None  # at most MAX_COLUMNS
    if t is None or t.num_rows > sp.MAX_COLUMNS or t["item_id"].null_count or how not in ("raw", "cosine", "jaccard", "wilson"):
        return ed.transform_edges(ed.cooc_counts(log, key), ed.item_rows(log), how, z)
    order = np.argsort(t["item_id"].to_numpy())
    items, rows = t["item_id"].to_numpy()[order], np.maximum(t["n"].to_numpy()[order], 1).astype(float)
    # one shuffle by key serves both groupings
    g = log.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "item_id", "weight").repartition("k").groupBy("k", "item_id").agg(F.sum("weight").alias("w")).where("w > 0")
    lists = stage(g.groupBy("k").agg(F.collect_list(F.struct("item_id", "w")).alias("l")).select(F.col("l.item_id").alias("item"), F.col("l.w").cast("array<double>").alias("w")).where("size(item) > 1"))
    entries = lists.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    blocks = max(2 * log.sparkSession.sparkContext.defaultParallelism, -(-entries // PER_BLOCK))
    sent, n = log.sparkSession.sparkContext.broadcast((items, rows)), len(items)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value[0]
        for b in batches:
            off = np.asarray(b.column(0).offsets)
            code = np.searchsorted(items, np.asarray(b.column(0).values)[off[0] : off[-1]]).astype(np.int32)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
            o = np.lexsort((code, owner))
            code, w = code[o], np.asarray(b.column(1).values)[off[0] : off[-1]][o]
            ids, out = [], []
            for k in range(blocks):
                hit = np.flatnonzero(code % blocks == k)
                if not len(hit):
                    continue
                end = np.full(len(off) - 1, -1)
                end[owner[hit]] = hit  # the last one of each owner stays
                keep = np.flatnonzero(np.arange(len(code)) <= end[owner])
                count = np.bincount(owner[keep], minlength=len(off) - 1)
                count = count[count > 0]
                first = np.cumsum(count) - count
                c = code[keep]
                step = np.diff(c, prepend=0)
                step[first] = 0
                ids.append(k)
                out.append(pickle.dumps((_least(count), c[first], _least(step), _least(w[keep])), 5))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["b", "x"])

    def edges(k: int, packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        items, rows = sent.value
        size, head, step, w = (np.concatenate(x) for x in zip(*map(pickle.loads, packs), strict=True))
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        code = np.cumsum(step, dtype=np.int64)
        code += np.repeat(head - code[start], size)
        code = code.astype(np.int32)
        hit = np.flatnonzero(code % blocks == k)
        hit = hit[np.argsort(code[hit], kind="stable")]
        before = hit - np.repeat(start, size)[hit]  # each meets all smaller items of its list
        last = np.append(np.flatnonzero(np.diff(code[hit])), len(hit) - 1)  # of each item
        total = np.cumsum(before)[last]
        a = done = 0
        while a < len(hit):
            p = min(max(np.searchsorted(total, done + AT_ONCE, "right") - 1, np.searchsorted(last, a)), len(last) - 1)
            h, m = hit[a : last[p] + 1], before[a : last[p] + 1]
            a, done = last[p] + 1, total[p]
            at, who = spans(h - m, m)
            if not len(at):
                continue
            pair = code[h[who]].astype(np.int64) * n + code[at]
            o = np.argsort(pair, kind="stable")
            pair = pair[o]
            new = np.append(0, np.flatnonzero(np.diff(pair)) + 1)
            x = np.add.reduceat((w[at].astype(float) * w[h[who]])[o], new)
            i, j = pair[new] % n, pair[new] // n
            x = transformed(x, rows[i], rows[j], how, z)
            made = pa.RecordBatch.from_arrays([pa.array(items[i]), pa.array(items[j]), pa.array(x)], ["i", "j", "w"])
            yield from (made.slice(s, 200_000) for s in range(0, made.num_rows, 200_000))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[bytes]] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packs.setdefault(k, []).append(x)
        while packs:
            yield from edges(*packs.popitem())

    return lists.mapInArrow(pack, "b int, x binary").repartitionById(blocks, F.col("b")).mapInArrow(work, f"i {kind}, j {kind}, w double")

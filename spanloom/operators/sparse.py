"""Sums over a sparse matrix that fits every task: packed rows against its rows, one list per entity.

Many results have the form "for each entity add up weighted rows of a matrix, keep the best": scores
from item-item edges, users alike by shared items, items alike by shared features. As joins they
shuffle every product. Here the matrix is sent to every task (only behind a check of its size) and
an entity's sums are made in one array, so nothing but the result leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries up to which a matrix is sent (12 bytes each in every Python worker), and columns it may have.
MAX_ENTRIES, MAX_COLUMNS = 40_000_000, 2_000_000
_WHOLE = ("bigint", "int", "smallint", "tinyint")


@dataclass
class Sparse:
    """Rows by sorted key; columns are places in a sorted array of targets."""

    keys: np.ndarray
    starts: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> Sparse:
        order = np.argsort(keys, kind="stable")
        known, first = np.unique(keys[order], return_index=True)
        return Sparse(known, np.append(first, len(keys)).astype(np.int64), cols[order].astype(np.int32), vals[order].astype(np.float64))

    def sums(self, keys: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """Sum of ``weights`` times the rows of ``keys``, which are added in the order given."""
        if not len(self.keys) or not len(keys):
            return np.zeros(width)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        at, w = at[hit], weights[hit]
        out = np.zeros(width)
        if (self.starts[at + 1] - self.starts[at]).sum() < 4096:  # short rows: all at once
            size = self.starts[at + 1] - self.starts[at]
            owner = np.repeat(np.arange(len(at)), size)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[at], size)
            return np.bincount(self.cols[k], self.vals[k] * w[owner], width)
        for p, c in zip(at, w, strict=True):  # a row names a column once, so plain addition will do
            a, b = self.starts[p], self.starts[p + 1]
            out[self.cols[a:b]] += c * self.vals[a:b]
        return out


def fits(key: str, target: str, *edges: DataFrame, entries: int = MAX_ENTRIES) -> bool:
    """Whether all ``edges`` together may be sent: whole-number ids, and no more entries than allowed."""
    for e in edges:
        kinds = dict(e.dtypes)
        if kinds[target] not in _WHOLE or kinds[key] not in (*_WHOLE, "string"):
            return False
    return sum(e.count() for e in edges) <= entries


def matrix(edges: DataFrame, key: str, target: str, value: str, targets: np.ndarray | None = None, mirrored: bool = False) -> tuple[Sparse, np.ndarray]:
    """``edges`` (one row per key and target) and its sorted targets, by way of the driver; call ``fits`` first.

    ``mirrored`` adds each entry the other way round. Targets outside given ones are left out.
    """
    t = edges.select(F.col(key).alias("k"), F.col(target).alias("t"), F.col(value).cast("double").alias("v")).toArrow()
    v = t["v"].to_numpy()
    k = np.asarray(t["k"].to_pylist(), dtype=object) if pa.types.is_string(t["k"].type) else t["k"].to_numpy()
    k = k.astype(str) if k.dtype == object else k
    c = t["t"].to_numpy()
    if mirrored:
        k, c, v = np.concatenate([k, c]), np.concatenate([c, k]), np.concatenate([v, v])
    targets = np.unique(c) if targets is None else targets
    at = np.minimum(np.searchsorted(targets, c), max(len(targets) - 1, 0))
    ok = targets[at] == c if len(targets) else np.zeros(len(c), bool)
    return Sparse.of(k[ok], at[ok], v[ok]), targets


def best(score: np.ndarray, n: int, allowed: np.ndarray | None = None, digits: int | None = 9) -> np.ndarray:
    """Places of the ``n`` largest scores, judged on ``digits`` decimals, ties by place; infinite ones and nan never count."""
    rounded = score if digits is None else np.round(score, digits)
    open_ = np.flatnonzero(np.isfinite(rounded) if allowed is None else allowed & np.isfinite(rounded))
    r = rounded[open_]
    if len(r) > n:
        floor = np.partition(r, len(r) - n)[len(r) - n]
        open_ = open_[r >= floor]
        r = rounded[open_]
    return open_[np.lexsort((open_, -r))][:n]


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` on so many decimals, halves away from zero, as SQL rounds."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


def per_entity(rows: DataFrame, shared: object, run: Callable, schema: str, parts: int = 1) -> DataFrame:
    """Call ``run(shared value, entity, parts)`` once per entity of ``rows`` (entity_id, part, key, w) and make a row per result row.

    ``part`` (0 to ``parts`` - 1) tells several lists of an entity apart; each comes as (keys,
    weights) sorted by key. ``run`` gives arrays for all columns of ``schema`` but the first, the
    entity. An entity's rows are at most a few times the catalog.
    """
    kinds = dict(rows.dtypes)
    packed = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("part", "key", "w"))).alias("l")).select("entity_id", "l.part", "l.key", "l.w")
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for b in batches:
            part, key, w = (b.column(k) for k in (1, 2, 3))
            off = np.asarray(part.offsets)
            part, w = np.asarray(part.values), np.asarray(w.values)
            key = np.asarray(key.values.to_pylist(), dtype=str) if pa.types.is_string(key.values.type) else np.asarray(key.values)
            owners, outs = [], []
            for e in range(len(off) - 1):
                cuts = off[e] + np.searchsorted(part[off[e] : off[e + 1]], np.arange(parts + 1))
                got = run(value, b.column(0)[e].as_py(), [(key[x:y], w[x:y]) for x, y in zip(cuts, cuts[1:])])
                outs.append(got)
                owners.append(np.full(len(got[0]), e))
                if sum(map(len, owners)) > 200_000:
                    yield _batch(b, owners, outs, names)
                    owners, outs = [], []
            if owners:
                yield _batch(b, owners, outs, names)

    return packed.mapInArrow(work, f"entity_id {kinds['entity_id']}, {schema.split(', ', 1)[1]}")


def per_chunk(rows: DataFrame, shared: object, run: Callable, schema: str, parts: int = 1, size: int = 128) -> DataFrame:
    """Like ``per_entity`` for ``size`` entities at a time.

    ``run(shared value, number of entities, parts)`` gets each part as (owners, keys, weights) sorted
    by owner and key, owners being places in the chunk, and yields owners before its columns, as often as it likes.
    """
    kinds = dict(rows.dtypes)
    packed = rows.groupBy("entity_id").agg(F.collect_list(F.struct("part", "key", "w")).alias("l")).select("entity_id", "l.part", "l.key", "l.w")
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for b in batches:
            off = np.asarray(b.column(1).offsets)
            part, key, w = (np.asarray(b.column(k).values) for k in (1, 2, 3))
            for a in range(0, b.num_rows, size):
                cut = off[a : a + size + 1]
                x, z = cut[0], cut[-1]
                owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                order = np.lexsort((key[x:z], owner))
                o, p, k, v = owner[order], part[x:z][order], key[x:z][order], w[x:z][order]
                for got in run(value, len(cut) - 1, [(o[p == n], k[p == n], v[p == n]) for n in range(parts)]):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got[0] + a)), *map(pa.array, got[1:])], names)

    return packed.mapInArrow(work, f"entity_id {kinds['entity_id']}, {schema.split(', ', 1)[1]}")


def _batch(b: pa.RecordBatch, owners: list, outs: list, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(np.concatenate(c)) for c in zip(*outs, strict=True)]
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(owners))), *cols], names)

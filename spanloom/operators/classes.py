"""Items of equal features as one class, so that similarity is worked out by class and not by item.

Metadata repeats: a catalog of millions of items has far fewer different sets of features. Every item
of a class has the same similarity to anything, so scores are made once per class and the members,
sorted by id, are put in afterwards. What goes by way of the driver are numbers only: the different
feature sets and each item's class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import sparse as sp
from spanloom.runtime import spread, stage

#: Different features up to which they are numbered by the driver, and up to which their products are kept as a square.
MAX_FEATURES, MAX_SQUARE = 200_000, 1024


def spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``starts[k] .. starts[k] + sizes[k] - 1`` for all k in a row, and the k of each."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), owner


@dataclass
class Classes:
    """``items`` (sorted) and their class; a class's features and weights lie at ``starts`` of ``codes`` and ``vals``."""

    items: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    vals: np.ndarray
    n_features: int
    by_feature: sp.Sparse

    @property
    def sizes(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.starts) - 1)

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``items`` class by class, by id within, and where each class starts."""
        return np.argsort(self.of, kind="stable"), np.append(0, np.cumsum(self.sizes))

    def profiles(self, owners: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Per owner (0 to n - 1) the weighted sum of the features of its items, one number per feature; unknown items have none."""
        if not len(self.items) or not len(items):
            return np.zeros((n, self.n_features))
        at = np.minimum(np.searchsorted(self.items, items), len(self.items) - 1)
        hit = self.items[at] == items
        c = self.of[at[hit]]
        k, from_ = spans(self.starts[c], self.starts[c + 1] - self.starts[c])
        cell = owners[hit][from_].astype(np.int64) * self.n_features + self.codes[k]
        return np.bincount(cell, self.vals[k] * weights[hit][from_], n * self.n_features).reshape(n, self.n_features)

    def content(self, profile: np.ndarray) -> np.ndarray:
        """Dot product of a profile with the features of every class."""
        known = np.flatnonzero(profile)
        return self.by_feature.sums(known, profile[known], len(self.starts) - 1)

    def scores(self, profiles: np.ndarray, a: int, z: int) -> np.ndarray:
        """``content`` of the classes ``a`` to ``z`` - 1 (rows) for many profiles (columns); a class's features are added in their order."""
        total, size = np.zeros((z - a, profiles.shape[1])), np.diff(self.starts[a : z + 1])
        for r in range(size.max(initial=0)):
            own = np.flatnonzero(size > r)
            k = self.starts[a + own] + r
            total[own] += self.vals[k, None] * profiles[self.codes[k]]
        return total

    def moments(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Sums over all items of their features, and of the products of two; None with too many features."""
        if self.n_features > MAX_SQUARE:
            return None
        n, size = self.n_features, self.sizes
        square = np.zeros((n, n))
        for a in range(0, len(size), 100_000):
            own = np.arange(a, min(a + 100_000, len(size)))
            x, who = spans(self.starts[own], self.starts[own + 1] - self.starts[own])
            c = own[who]
            y, left = spans(self.starts[c], self.starts[c + 1] - self.starts[c])
            v = self.vals[x][left] * self.vals[y] * size[c[left]]
            square += np.bincount(self.codes[x][left].astype(np.int64) * n + self.codes[y], v, n * n).reshape(n, n)
        per = np.repeat(size, np.diff(self.starts))
        return np.bincount(self.codes, self.vals * per, n), square


def classes(features: DataFrame) -> tuple[Classes, DataFrame] | None:
    """The classes of ``features`` (item_id, feature, w), and ``(item_id, c)``: each item with the least item of its class.

    None where the items or the features are too many for this, or their ids no whole numbers.
    """
    features = stage(features.select("feature", "item_id", "w"))
    if not sp.fits("feature", "item_id", features):
        return None
    names = features.select("feature").distinct().limit(MAX_FEATURES + 1).toArrow()["feature"].to_pylist()  # at most MAX_FEATURES
    if len(names) > MAX_FEATURES:
        return None
    numbered = features.sparkSession.createDataFrame([(f, k) for k, f in enumerate(sorted(names))], "feature string, code int")
    lists = features.join(F.broadcast(numbered), "feature").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("code", "w"))).alias("l"))  # an item's features
    named = stage(lists.select("item_id", "l", F.min("item_id").over(Window.partitionBy("l")).alias("c")))
    if named.count() > sp.MAX_COLUMNS:
        return None
    first = named.where("item_id = c").select("c", "l.code", "l.w").toArrow().combine_chunks()  # numbers, one row per class
    ids = first["c"].to_numpy()
    order = np.argsort(ids)
    code, w = (first[k].combine_chunks() if isinstance(first[k], pa.ChunkedArray) else first[k] for k in ("code", "w"))
    off = np.asarray(code.offsets) if len(code) else np.zeros(1, np.int64)
    k, _ = spans(off[:-1][order], np.diff(off)[order])
    starts = np.append(0, np.cumsum(np.diff(off)[order])).astype(np.int64)
    codes, vals = np.asarray(code.values)[k].astype(np.int32), np.asarray(w.values)[k]
    t = named.select("item_id", "c").toArrow()  # at most MAX_COLUMNS
    items, c = t["item_id"].to_numpy(), t["c"].to_numpy()
    by_item = np.argsort(items)
    of = np.searchsorted(ids[order], c[by_item]).astype(np.int32)
    by_feature = sp.Sparse.of(codes, np.repeat(np.arange(len(ids)), np.diff(starts)), vals)
    return Classes(items[by_item], of, starts, codes, vals, len(names), by_feature), named.select("item_id", "c")


def nearest(found: tuple[Classes, DataFrame], top_k: int) -> DataFrame:
    """``(i, j, sim, rank)``: the ``top_k`` other items with the largest dot product (above 0), ties by item.

    A class's list holds one item more than asked for; each member drops itself.
    """
    sets, named = found
    place, begin = sets.members()
    sent = named.sparkSession.sparkContext.broadcast((sets, sets.items[place], begin, np.unique(sets.items[place[begin[:-1]]]) if len(place) else sets.items))
    kind = dict(named.dtypes)["item_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, ids, begin, firsts = sent.value
        size = np.diff(begin)
        for b in batches:
            own, js, sims = np.searchsorted(firsts, np.asarray(b.column(0))), [], []
            for p in own:
                a, z = f.starts[p], f.starts[p + 1]
                total = f.by_feature.sums(f.codes[a:z], f.vals[a:z], len(size))
                r = np.round(total, 9)
                top = np.flatnonzero(total > 0)
                if len(top) > top_k + 1:
                    top = top[r[top] >= np.partition(r[top], len(top) - top_k - 1)[len(top) - top_k - 1]]
                top = top[np.argsort(-r[top], kind="stable")]
                enough = np.searchsorted(np.cumsum(size[top]), top_k + 1)
                if enough < len(top):
                    top = top[r[top] >= r[top[enough]]]
                k, owner = spans(begin[top], np.minimum(size[top], top_k + 1))
                j, c = ids[k], top[owner]
                best = np.lexsort((j, -r[c]))[: top_k + 1]
                js.append(j[best])
                sims.append(total[c[best]])
            off = pa.array(np.append(0, np.cumsum([len(x) for x in js])).astype(np.int32))
            flat = lambda x, t: pa.ListArray.from_arrays(off, pa.array(np.concatenate(x), t))
            if js:
                yield pa.RecordBatch.from_arrays([b.column(0), flat(js, b.column(0).type), flat(sims, pa.float64())], ["c", "js", "sims"])

    # the classes' first items stand for them
    lists = spread(named.where("item_id = c").select("c")).mapInArrow(work, f"c {kind}, js array<{kind}>, sims array<double>")
    near = F.slice(F.filter(F.arrays_zip("js", "sims"), lambda x: x["js"] != F.col("i")), 1, top_k)
    rows = named.withColumnRenamed("item_id", "i").join(lists, "c").select("i", F.posexplode(near).alias("p", "e"))
    return rows.select("i", F.col("e.js").alias("j"), F.col("e.sims").alias("sim"), (F.col("p") + 1).cast("int").alias("rank"))

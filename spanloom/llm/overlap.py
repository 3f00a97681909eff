"""Same or near-same records across splits: buckets of the least minwise hashes, then exact checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import micros, spread, stage

#: Cells of the word counts that put rare words first, and rows of a side that one task pairs in a bucket.
CELLS, BLOCK = 1 << 15, 4096


def words_of(text: Column) -> Column:
    """The different words (lower-cased runs of a-z and 0-9) of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)))


def canonical_id(c: Column) -> Column:
    """An id without letter case, signs other than a-z and 0-9, and leading zeros of its numbers."""
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.regexp_replace(plain, "(?<![0-9])0+(?=[0-9])", "")


def least_hashes(values: np.ndarray, offsets: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, offsets): of each document's word hashes the least ones, in an order that puts rare words first.

    A document of n words keeps n - ceil(threshold n) + 1 of them. Two documents with Jaccard
    similarity at or above the threshold then have a kept hash in common, whatever the order, as
    long as it is one and the same for all documents.
    """
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, counts[values % np.uint64(len(counts))], owner))
    place = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
    keep = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    kept = np.minimum(keep, sizes)
    return values[order][place < np.repeat(kept, sizes)].view(np.int64), np.concatenate([[0], np.cumsum(kept)])


def word_classes(records: DataFrame, record_id: str, split: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): records with the same set of words form a class.

    members: ``(id, split, h1, h2)``; classes: ``(h1, h2, rep, words, n, n_train, n_test)`` with the
    least record id as representative and the number of records on each side. h1 and h2 are a
    128-bit hash of the words. Copies are folded, map-side first, before anything is compared.
    """
    base = records.select(F.col(record_id).alias("id"), F.col(split).alias("split"), words_of(F.col(text)).alias("w")).where(F.size("w") >= min_words)
    base = base.select("id", "split", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))
    h = [F.xxhash64("words").alias("h1"), F.xxhash64("words", F.lit(7)).alias("h2")]
    classes = base.groupBy("words", "n").agg(F.min("id").alias("rep"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    return base.select("id", "split", *h), classes.select(*h, "rep", "words", "n", "n_train", "n_test")


def _signatures(classes: DataFrame, threshold: float) -> DataFrame:
    """``(bucket, rep, n, picture, in_train, in_test)``: one row per class and kept hash.

    ``picture`` has one of 64 bits set per word.
    """
    spark = classes.sparkSession
    words = F.split("words", " ")
    counts = np.zeros(CELLS, np.int64)
    for r in classes.select(F.explode(words).alias("x")).groupBy(F.xxhash64("x").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("c")).count().collect():  # at most CELLS rows
        counts[r["c"]] = r["count"]
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            h = b.column(4)
            off = np.asarray(h.offsets).astype(np.int64)
            vals = np.asarray(h.values)[off[0] : off[-1]].view(np.uint64)
            off -= off[0]
            bits = np.bitwise_or.reduceat(np.uint64(1) << (vals >> np.uint64(40) & np.uint64(63)), off[:-1]).view(np.int64)
            keys, ends = least_hashes(vals, off, shared.value, threshold)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(bits), lists], ["rep", "n", "in_train", "in_test", "picture", "keys"])

    rows = classes.select("rep", "n", (F.col("n_train") > 0).alias("in_train"), (F.col("n_test") > 0).alias("in_test"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    kind = dict(classes.dtypes)["rep"]
    out = spread(rows).mapInArrow(run, f"rep {kind}, n int, in_train boolean, in_test boolean, picture long, keys array<long>")
    return out.select(F.explode("keys").alias("bucket"), "rep", "n", "picture", "in_train", "in_test")


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """``(rep_train, rep_test, jaccard)`` of different classes at or above ``threshold``.

    Every word is hashed once; a class falls into the buckets of its least hashes (bottom-k minwise
    hashing in an order that puts rare words first), which no pair at the threshold can avoid
    sharing. Only buckets with a training and a test class go on. Sizes and 64-bit pictures of the
    word sets bound the shared words from above, which drops nearly all chance candidates where
    they meet; the rest is checked exactly on the words. Buckets of many classes are cut into
    blocks of about ``BLOCK`` rows of each side, paired block against block by different tasks.
    """
    by = Window.partitionBy("bucket")
    live = _signatures(classes, threshold).select("*", *[F.ceil(F.count_if(F.col(s)).over(by) / BLOCK).cast("int").alias(b) for s, b in (("in_train", "ba"), ("in_test", "bb"))]).where("ba > 0 and bb > 0")
    sides = []
    for own, mine, other, tag in (("in_train", "ba", "bb", "a"), ("in_test", "bb", "ba", "b")):
        rows = live.where(own)
        names = ["bucket", F.col("rep").alias(f"r{tag}"), F.col("n").alias(f"n{tag}"), F.col("picture").alias(f"p{tag}")]
        block = F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int")
        large = rows.where("ba > 1 or bb > 1").select(*names, block.alias(f"x{tag}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"y{tag}"))
        sides.append((rows.where("ba = 1 and bb = 1").select(*names), large))
    # words of one side without a bit in the other's picture are not shared
    shared = F.least(F.col("na") - F.bit_count(F.expr("pa & ~pb")), F.col("nb") - F.bit_count(F.expr("pb & ~pa")))
    near = (F.col("ra") != F.col("rb")) & (shared >= F.lit(threshold - 1e-9) * (F.col("na") + F.col("nb") - shared))
    small = sides[0][0].join(sides[1][0], "bucket").where(near).select("ra", "rb")
    large = sides[0][1].join(sides[1][1].withColumnsRenamed({"xb": "ya", "yb": "xa"}), ["bucket", "xa", "ya"]).where(near).select("ra", "rb")
    cand = stage(small.unionByName(large).distinct())
    texts = classes.select("rep", F.split("words", " ").alias("w"))
    both = cand.join(texts.select(F.col("rep").alias("ra"), F.col("w").alias("wa")), "ra").join(texts.select(F.col("rep").alias("rb"), F.col("w").alias("wb")), "rb")
    common = F.size(F.array_intersect("wa", "wb"))
    jac = common / (F.size("wa") + F.size("wb") - common)
    return both.select(F.col("ra").alias("rep_train"), F.col("rb").alias("rep_test"), jac.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def linked_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """``(rep_train, rep_test)`` of all classes that overlap, those with records on both sides included."""
    pairs = similar_classes(classes, threshold).select("rep_train", "rep_test")
    return stage(pairs.unionByName(classes.where("n_train > 0 and n_test > 0").select(F.col("rep").alias("rep_train"), F.col("rep").alias("rep_test"))))


def text_overlaps(records: DataFrame, record_id: str, split: str, text: str, min_words: int = 8, threshold: float = 0.6) -> DataFrame:
    """``(train_id, test_id)`` of records whose texts share at least ``threshold`` of their different words."""
    members, classes = word_classes(records, record_id, split, text, min_words)
    classes = stage(classes)
    linked = linked_classes(classes, threshold)
    # only the records of classes that have a link are looked up and moved
    reps = stage(classes.select("h1", "h2", "rep").join(linked.select(F.explode(F.array("rep_train", "rep_test")).alias("rep")).distinct(), "rep"))
    place = stage(members.join(reps, ["h1", "h2"]).select("id", "split", "rep"))
    train = place.where(F.col("split") == "train").select(F.col("rep").alias("rep_train"), F.col("id").alias("train_id"))
    test = place.where(F.col("split") == "test").select(F.col("rep").alias("rep_test"), F.col("id").alias("test_id"))
    return linked.join(train, "rep_train").join(test, "rep_test").select("train_id", "test_id")


def _field_sides(base: DataFrame, carried: list[str], seconds: int, rating_gap: float) -> DataFrame:
    """Training and test rows of ``base`` (split, k1, k2, t, r and ``carried``) that agree; carried columns come as _a and _b.

    k1 and k2 are a 128-bit hash of source and ids. Windows are twice as wide as the time allowed,
    so a test row looks into at most two and the join stays an equi-join.
    """
    width = seconds * 1_000_000
    cell = lambda t: F.floor(t / F.lit(2 * width))
    base = base.where(F.col("t").isNotNull())
    keys = ["k1", "k2", "w"]
    side = lambda x, w: [*keys[:2], w.alias("w"), F.col("t").alias(f"t{x}"), F.col("r").alias(f"r{x}"), *[F.col(c).alias(f"{c}_{x}") for c in carried]]
    train = base.where(F.col("split") == "train").select(*side("a", cell(F.col("t"))))
    test = base.where(F.col("split") == "test").select(*side("b", F.explode(F.array_distinct(F.array(cell(F.col("t") - width), cell(F.col("t") + width))))))
    near = (F.abs(F.col("ta") - F.col("tb")) <= width) & (F.col("ra").isNull() | F.col("rb").isNull() | (F.abs(F.col("ra") - F.col("rb")) <= rating_gap))
    return train.join(test, keys).where(near)


def _field_base(records: DataFrame, split: str, source: str, ids: list[str], ts: str, rating: str) -> list[Column]:
    canon = [canonical_id(F.col(c)) for c in ids]
    known = F.col(source).isNotNull()
    for c in ids:
        known &= F.col(c).isNotNull()
    text = F.when(known, F.concat_ws("\x1f", F.col(source).cast("string"), *canon))
    return [F.col(split).alias("split"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(7)).alias("k2"), F.when(text.isNotNull(), micros(F.col(ts))).alias("t"), F.col(rating).cast("double").alias("r")]


def field_overlaps(
    records: DataFrame, record_id: str, split: str, source: str, ids: list[str], ts: str, rating: str, seconds: int = 300, rating_gap: float = 0.5
) -> DataFrame:
    """``(train_id, test_id)`` of records of one source that agree in all ``ids`` up to spelling and nearly in time and rating."""
    base = records.select(F.col(record_id).alias("id"), *_field_base(records, split, source, ids, ts, rating))
    return _field_sides(base, ["id"], seconds, rating_gap).select(F.col("id_a").alias("train_id"), F.col("id_b").alias("test_id"))


def cross_split_overlaps(records: DataFrame) -> DataFrame:
    """``(train_id, test_id)``: records of the test split that tell the same as one of the train split.

    Reads record_id, split ('train', 'test'), source, entity_id, item_id, timestamp, rating and
    remark. Null sources and ids agree with nothing; null times and remarks of fewer than eight
    different words are never compared; a null rating agrees with any. Each pair comes once.
    """
    texts = text_overlaps(records, "record_id", "split", "remark")
    fields = field_overlaps(records, "record_id", "split", "source", ["entity_id", "item_id"], "timestamp", "rating")
    return texts.unionByName(fields).distinct()


def overlap_report(records: DataFrame, min_words: int = 8, threshold: float = 0.6) -> DataFrame:
    """``(split, source, n_records, n_overlapping, n_pairs)`` of the same overlaps, counted without listing the pairs.

    Records that agree in all that is compared are one cell with a count, so copies on both sides
    are multiplied as numbers: a cell's links are the sizes of the classes linked to its own, plus
    the sizes of the cells that agree in the fields and are not linked by text already.
    """
    _, classes = word_classes(records, "record_id", "split", "remark", min_words)
    classes = stage(classes)
    linked = linked_classes(classes, threshold)
    reps = classes.select("h1", "h2", "rep")
    words = words_of(F.col("remark"))
    text = F.when(F.size(words) >= min_words, F.array_join(words, " "))
    base = records.select("source", *_field_base(records, "split", "source", ["entity_id", "item_id"], "timestamp", "rating"), text.alias("x"))
    base = base.withColumns({"h1": F.when(F.col("x").isNotNull(), F.xxhash64("x")), "h2": F.when(F.col("x").isNotNull(), F.xxhash64("x", F.lit(7)))}).drop("x")
    what = ["split", "source", "k1", "k2", "t", "r"]
    cells = base.groupBy(*what, "h1", "h2").agg(F.count(F.lit(1)).alias("n")).join(reps, ["h1", "h2"], "left")
    cells = stage(cells.select(F.xxhash64(*what, "h1", "h2").alias("cell"), F.xxhash64(F.lit(7), *what, "h1", "h2").alias("cell2"), *what, "rep", "n"))
    size = lambda side: classes.select(F.col("rep").alias(f"rep_{side}"), F.col(f"n_{side}").alias("n"))
    by_text = linked.join(size("test"), "rep_test").select(F.lit("train").alias("split"), F.col("rep_train").alias("rep"), "n")
    by_text = by_text.unionByName(linked.join(size("train"), "rep_train").select(F.lit("test").alias("split"), F.col("rep_test").alias("rep"), "n"))
    by_text = by_text.groupBy("split", "rep").agg(F.sum("n").alias("by_text"))
    fields = _field_sides(cells, ["cell", "cell2", "rep", "n"], 300, 0.5)
    fields = fields.join(linked.withColumnsRenamed({"rep_train": "rep_a", "rep_test": "rep_b"}), ["rep_a", "rep_b"], "left_anti")
    by_field = fields.select("cell_a", "cell2_a", F.col("n_b").alias("n")).toDF("cell", "cell2", "n").unionByName(fields.select("cell_b", "cell2_b", F.col("n_a").alias("n")).toDF("cell", "cell2", "n"))
    by_field = by_field.groupBy("cell", "cell2").agg(F.sum("n").alias("by_field"))
    links = F.coalesce("by_text", F.lit(0)) + F.coalesce("by_field", F.lit(0))
    rows = cells.join(by_text, ["split", "rep"], "left").join(by_field, ["cell", "cell2"], "left").withColumn("links", links)
    return rows.groupBy("split", "source").agg(
        F.sum("n").alias("n_records"), F.coalesce(F.sum(F.when(F.col("links") > 0, F.col("n"))), F.lit(0)).alias("n_overlapping"), F.sum(F.col("n") * F.col("links")).alias("n_pairs")
    )

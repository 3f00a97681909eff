"""How often pairs of items occur together: a stored pair table kept up to date by signed deltas."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import shared_folder, stage

#: Baskets with more items are paired block by block.
BLOCK = 512
#: Pairs aimed at per bucket of a stored table.
BUCKET_PAIRS = 2_000_000


# ---------------------------------------------------------------- baskets


def _rows(df: DataFrame, basket: list[str], item: str, **more: Column) -> DataFrame:
    for c in (*basket, item):
        df = df.where(F.col(c).isNotNull())
    return df.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(basket)], F.col(item).alias("item"), *[v.alias(k) for k, v in more.items()])


def _keys(entries: DataFrame) -> list[str]:
    return [c for c in entries.columns if c not in ("item", "was", "now")]


def log_changes(df: DataFrame, basket: list[str], item: str, early: Column | None = None) -> DataFrame:
    """``(b0.., item, was, now)``: per basket and item whether it was and is in the basket.

    ``early`` marks the rows already counted (none, if it is left out). A log only adds, so items
    never leave. Repeated rows are folded where they are read. Rows with a null in basket or item
    are left out.
    """
    rows = _rows(df, basket, item, was=(F.lit(False) if early is None else F.coalesce(early, F.lit(True))).cast("int"))
    return rows.groupBy(*[c for c in rows.columns if c != "was"]).agg(F.max("was").alias("was"), F.lit(1).alias("now"))


def changes(old: DataFrame, new: DataFrame, basket: list[str], item: str) -> DataFrame:
    """The same for any change from one set of rows to another; items may leave baskets."""
    tag = lambda d, was: _rows(d, basket, item, was=F.lit(was), now=F.lit(1 - was))
    rows = tag(old, 1).unionByName(tag(new, 0))
    return rows.groupBy(*[c for c in rows.columns if c not in ("was", "now")]).agg(F.max("was").alias("was"), F.max("now").alias("now"))


def changed_only(entries: DataFrame) -> DataFrame:
    """All entries of the baskets in which something came or went."""
    return entries.join(entries.where("was <> now").select(*_keys(entries)).distinct(), _keys(entries), "left_semi")


def pair_counts(entries: DataFrame, state: str = "change") -> DataFrame:
    """``(item_a, item_b, n)``: baskets holding both items, or how that changed.

    ``state`` "was" counts the pairs of the baskets as they were. "change" gives a pair +1 for a
    basket that holds both now and did not before, -1 for the reverse, and nothing where both stay.

    Baskets of up to ``BLOCK`` items are packed to one row each and paired in place. The items of
    larger ones are never brought together: they are cut into blocks by item hash and paired block
    against block through a join. All pairs are counted either way.
    """
    keys = _keys(entries)
    entries = entries.where("was = 1") if state == "was" else changed_only(entries)
    sign = F.lit(1) if state == "was" else F.col("y.now") * F.col("x.now") - F.col("y.was") * F.col("x.was")
    large = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    large = stage(large.select(*keys, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    e = F.struct("item", "was", "now")
    packed = entries.join(large, keys, "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list(e)).alias("items"))  # at most BLOCK items
    left = packed.select("items", F.posexplode("items").alias("p", "x"))
    pairs = left.select("x", F.explode(F.expr("slice(items, p + 2, size(items))")).alias("y"))
    rows = entries.join(large, keys).select(*keys, "blocks", e.alias("e")).withColumn("block", F.pmod(F.xxhash64("e.item"), F.col("blocks")).cast("int"))
    reach = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # an item of block k meets block j as the first of cell (k, j) or the second of cell (j, k)
    a, b = rows.select(*keys, F.col("block").alias("bx"), reach.alias("by"), F.col("e").alias("x")), rows.select(*keys, reach.alias("bx"), F.col("block").alias("by"), F.col("e").alias("y"))
    pairs = pairs.unionByName(a.join(b, [*keys, "bx", "by"]).where(F.col("x.item") < F.col("y.item")).select("x", "y"))
    pairs = pairs.select(F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b"), sign.alias("s"))
    return pairs.where("s <> 0").groupBy("item_a", "item_b").agg(F.sum("s").alias("n")).where("n <> 0")


def item_counts(entries: DataFrame, state: str = "change") -> DataFrame:
    """``(item, n)``: baskets holding each item, or how that changed (0 where comings and goings even out)."""
    rows = entries.select("item", F.col("was").alias("n")) if state == "was" else entries.where("was <> now").select("item", (F.col("now") - F.col("was")).alias("n"))
    rows = rows.where("n <> 0").groupBy("item").agg(F.sum("n").alias("n"))
    return rows


def basket_count(entries: DataFrame, state: str = "change") -> DataFrame:
    """One row ``n``: number of baskets with an item, or how that changed."""
    per = entries.groupBy(*_keys(entries)).agg(F.max("was").alias("was"), F.max("now").alias("now"))
    n = F.col("was") if state == "was" else F.col("now") - F.col("was")
    return per.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"))


# ---------------------------------------------------------------- the stored table


def scored(pairs: DataFrame, items: DataFrame, baskets: DataFrame) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift)``: lift is how many times chance a pair occurs together."""
    a = items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    return with_lift(pairs.join(a, "item_a").join(b, "item_b"), baskets)


def with_lift(rows: DataFrame, baskets: DataFrame) -> DataFrame:
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b").cast("double"))
    return rows.crossJoin(F.broadcast(baskets)).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"))  # one row


@dataclass
class PairTable:
    """Counts of pairs, items and baskets stored below ``path``, in versions.

    A version holds the pair buckets (by hash of the first item) it changed, the item and basket
    counts, and a manifest that names for every bucket the version it was last written in. The
    manifest is written last and makes the version valid; what a failed update left behind is never
    read and is overwritten by the next. Earlier versions stay readable until they are removed.
    """

    spark: SparkSession
    path: str
    version: int
    buckets: int
    where: dict[int, int]  # bucket -> version that holds it
    kind: str  # type of the items

    def _at(self, version: int, name: str) -> str:
        return f"{self.path}/v{version:06d}/{name}"

    @classmethod
    def create(cls, spark: SparkSession, path: str, entries: DataFrame, state: str = "change") -> PairTable:
        """Store a first load: all changes from nothing, or the baskets as they were."""
        pairs = stage(pair_counts(entries, state))
        buckets = max(8, 1 << max(0, math.ceil(math.log2(max(1, pairs.count()) / BUCKET_PAIRS))))
        t = cls(spark, path, 0, buckets, {}, dict(entries.dtypes)["item"])
        return t._write(1, pairs.select("item_a", "item_b", F.col("n").alias("n_ab")), item_counts(entries, state), basket_count(entries, state), range(buckets))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> PairTable:
        """The newest valid version, or the one asked for."""
        found = {}
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(folder):
            at = spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest/_SUCCESS")
            if fs.exists(at):
                found[int(s.getPath().getName()[1:])] = True
        v = version or max(found, default=0)
        if v not in found:
            raise ValueError(f"no valid pair table at {path}")
        m = json.loads(spark.read.text(f"{path}/v{v:06d}/manifest").first()[0])
        return cls(spark, path, v, m["buckets"], {int(k): w for k, w in m["where"].items()}, m["kind"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("item_a"), F.lit(self.buckets)).cast("int")

    def _write(self, version: int, pairs: DataFrame, items: DataFrame, baskets: DataFrame, touched: object) -> PairTable:
        t = PairTable(self.spark, self.path, version, self.buckets, self.where | dict.fromkeys(touched, version), self.kind)
        rows = pairs.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "item_a", "item_b")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(t._at(version, "pairs"))
        items.write.mode("overwrite").parquet(t._at(version, "items"))
        baskets.coalesce(1).write.mode("overwrite").parquet(t._at(version, "baskets"))
        text = json.dumps({"buckets": t.buckets, "kind": t.kind, "where": t.where})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(t._at(version, "manifest"))
        return t

    def pairs(self, only: object = None) -> DataFrame:
        """``(item_a, item_b, n_ab)`` of all buckets, or of some; no other file is read."""
        out, schema = None, f"item_a {self.kind}, item_b {self.kind}, n_ab bigint, bucket int"
        for v in sorted(set(self.where.values())):
            mine = [b for b, w in self.where.items() if w == v and (only is None or b in only)]
            part = self.spark.read.schema(schema).parquet(self._at(v, "pairs")).where(F.col("bucket").isin(mine)).select("item_a", "item_b", "n_ab") if mine else None
            out = part if out is None else out if part is None else out.unionByName(part)
        return out

    @property
    def items(self) -> DataFrame:
        return self.spark.read.parquet(self._at(self.version, "items"))

    @property
    def baskets(self) -> DataFrame:
        return self.spark.read.parquet(self._at(self.version, "baskets"))

    def update(self, entries: DataFrame) -> PairTable:
        """Apply changes: only buckets with a changed pair are read, merged and written anew, as the next version."""
        delta = stage(pair_counts(entries).withColumnRenamed("n", "n_ab"))
        touched = {r[0] for r in delta.select(self._bucket()).distinct().collect()}  # at most the number of buckets
        old = self.pairs(touched)
        merged = (delta if old is None else old.unionByName(delta)).groupBy("item_a", "item_b").agg(F.sum("n_ab").alias("n_ab")).where("n_ab > 0")
        items = self.items.unionByName(item_counts(entries)).groupBy("item").agg(F.sum("n").alias("n")).where("n > 0")
        baskets = self.baskets.unionByName(basket_count(entries)).agg(F.sum("n").alias("n"))
        return self._write(self.version + 1, merged, items, baskets, touched)

    def associations(self, min_together: int = 1) -> DataFrame:
        """Scores of all pairs that occur together at least ``min_together`` times."""
        return scored(self.pairs().where(F.col("n_ab") >= min_together), self.items, self.baskets)


def affected_associations(table: PairTable, touched: DataFrame, min_together: int = 1) -> DataFrame:
    """Scores of the updated ``table`` with a ``touched`` item ``(item)``: one that came into or left a basket.

    No pair changes without one of its items doing so. Lifts also carry the number of baskets; a
    change of it alone scales every lift alike and needs no look at the pairs.
    """
    items = table.items.join(touched.select("item", F.lit(True).alias("hit")), "item", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    a = items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"), F.col("hit").alias("ha"))
    b = items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"), F.col("hit").alias("hb"))
    return with_lift(table.pairs().where(F.col("n_ab") >= min_together).join(a, "item_a").join(b, "item_b").where("ha or hb"), table.baskets)


def items_together(df: DataFrame, basket: list[str], item: str, loaded_at: str | None = None, min_together: int = 1, path: str | None = None) -> DataFrame:
    """Associations of all item pairs of a log, by a stored first load and one increment.

    With ``loaded_at`` the rows before the last tenth of the load time are counted, scored and
    stored below ``path`` (the shared folder if none is given); the stored table is loaded again,
    the other rows are merged into the buckets they touch, and the scores they affect are made
    anew, while the others stay as they are. Null load times count as early. Without ``loaded_at``
    the log is one load. Either way the counts are those of the whole log. Repeated rows count once
    per basket. An empty log gives no pair.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    span = df.agg(F.min(loaded_at).alias("lo"), F.max(loaded_at).alias("hi")).first() if loaded_at else None
    if span is None or span["lo"] is None:
        return PairTable.create(spark, path, stage(log_changes(df, basket, item))).associations(min_together)
    at = span["lo"] + (span["hi"] - span["lo"]) * 0.9
    entries = stage(log_changes(df, basket, item, F.col(loaded_at) <= F.lit(at).cast(dict(df.dtypes)[loaded_at])))
    before = stage(PairTable.create(spark, path, entries, "was").associations(min_together))
    table = PairTable.load(spark, path).update(entries)
    touched = stage(item_counts(entries).select("item"))
    kept = before.join(touched.select(F.col("item").alias("item_a")), "item_a", "left_anti").join(touched.select(F.col("item").alias("item_b")), "item_b", "left_anti")
    return affected_associations(table, touched, min_together).unionByName(with_lift(kept.drop("n", "lift"), table.baskets))

"""Readers of public interaction datasets: raw files to canonical train, test and item tables.

All readers are lazy, split by distributed operators and never download anything. Paths may be
files or folders of files. Malformed lines are dropped, as are rows whose ids or times are missing.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.evaluate import chronological_split, quantile_split
from spanloom.operators.infer_sessions import cart_outcomes
from spanloom.runtime import seconds


class DataNotAvailable(FileNotFoundError):
    """Raw files of a dataset are missing or lack columns."""


@dataclass(frozen=True)
class DatasetSplit:
    name: str
    train: DataFrame
    test: DataFrame
    items: DataFrame | None = None
    description: str = ""


class DatasetLoader(Protocol):
    """A function from a session and a folder to a split."""

    def __call__(self, spark: SparkSession, root: str, **opts) -> DatasetSplit: ...


def _need(root: str, *names: str) -> list[str]:
    """Paths of the files; local folders are checked, others (object stores) are left to Spark."""
    if "://" not in root:
        missing = [n for n in names if not Path(root, n).exists()]
        if missing:
            raise DataNotAvailable(f"missing below {root}: {missing}")
    return [f"{root}/{n}" for n in names]


def _has(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a file is there, on this machine or on any file system Spark reads."""
    if "://" not in root:
        return Path(root, name).exists()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _csv(spark: SparkSession, path: str, need: set[str] | None = None, upper: bool = False) -> DataFrame:
    df = spark.read.csv(path, header=True)
    if upper:
        df = df.toDF(*[c.strip().upper() for c in df.columns])
    if need and not need <= set(df.columns):
        raise DataNotAvailable(f"{path} lacks columns {sorted(need - set(df.columns))}")
    return df


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of a text file in another encoding than UTF-8 (which the text source does not offer)."""
    return spark.read.schema("value string").option("encoding", encoding).option("sep", "\x01").option("quote", "").option("escape", "").csv(path)


def _naive(c) -> F.Column:
    return c.cast("timestamp").cast("timestamp_ntz")


def _split(name: str, log: DataFrame, items: DataFrame | None, how: str, fraction: float, text: str = "") -> DatasetSplit:
    extra = [c for c in ("session_id", "item_id", "action_type") if c in log.columns]
    rows = log.withColumn("_s", seconds(F.col("timestamp")))
    if how == "global":
        marked = chronological_split(rows, fraction, ["_s", "entity_id", *extra])
    else:
        marked = quantile_split(rows, fraction, "_s")
    return DatasetSplit(name, marked.where("is_train").drop("is_train", "_s"), marked.where("not is_train").drop("is_train", "_s"), items, text)


def movielens(spark: SparkSession, root: str, test_fraction: float = 0.1, drop_below_threshold: bool = False) -> DatasetSplit:
    """``::``-separated ratings and movies (ISO-8859-1)."""
    r, m = _need(root, "ratings.dat", "movies.dat")
    raw = _lines(spark, r, "ISO-8859-1").select(F.split("value", "::").alias("p")).where(F.size("p") == 4)
    log = raw.select(F.col("p")[0].cast("bigint").alias("entity_id"), F.col("p")[1].cast("bigint").alias("item_id"), _naive(F.timestamp_seconds(F.col("p")[3].cast("bigint"))).alias("timestamp"), F.col("p")[2].cast("double").alias("rating"))
    log = log.withColumn("action_type", F.when(F.col("rating") >= 4, "positive_rating").otherwise("negative_rating"))
    if drop_below_threshold:
        log = log.where("rating >= 4")
    movies = _lines(spark, m, "ISO-8859-1").select(F.split("value", "::").alias("p")).where(F.size("p") == 3)
    items = movies.select(F.col("p")[0].cast("bigint").alias("item_id"), F.col("p")[1].alias("title"), F.col("p")[2].alias("genres"), F.split(F.col("p")[2], r"\|")[0].alias("category"))
    return _split("movielens", log.dropna(subset=["entity_id", "item_id", "timestamp"]), items, "global", test_fraction)


_REVIEW = "reviewerID string, asin string, overall double, unixReviewTime bigint"


def amazon_reviews(spark: SparkSession, path: str, default_rating: float | None = None) -> DataFrame:
    """Review JSON lines (gz too) as a canonical log."""
    raw = spark.read.schema(_REVIEW).option("mode", "DROPMALFORMED").json(path)
    rating = F.col("overall") if default_rating is None else F.coalesce("overall", F.lit(default_rating))
    log = raw.select(F.col("reviewerID").alias("entity_id"), F.col("asin").alias("item_id"), _naive(F.timestamp_seconds("unixReviewTime")).alias("timestamp"), F.lit("review").alias("action_type"), rating.alias("rating"))
    return log.dropna(subset=["entity_id", "item_id", "timestamp"])


def amazon(spark: SparkSession, root: str, name: str = "Beauty", test_fraction: float = 0.1) -> DatasetSplit:
    """5-core reviews with optional metadata (parent_asin, store, main_category)."""
    (r,) = _need(root, f"{name}_5.json.gz") if _has(spark, root, f"{name}_5.json.gz") else _need(root, f"{name}_5.json")
    items = None
    for meta in (f"meta_{name}.jsonl", f"meta_{name}.jsonl.gz"):
        if _has(spark, root, meta) and items is None:
            raw = spark.read.schema("parent_asin string, title string, store string, main_category string").option("mode", "DROPMALFORMED").json(f"{root}/{meta}")
            items = raw.where("parent_asin is not null").select(F.col("parent_asin").alias("item_id"), "title", F.col("store").alias("brand"), F.col("main_category").alias("category")).dropDuplicates(["item_id"])
    return _split(f"amazon-{name.lower()}", amazon_reviews(spark, r), items, "global", test_fraction)


def literal_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Lines holding a Python literal dictionary, as the asked string or JSON fields; other lines are dropped.

    Literals are parsed in Arrow batches (no expression is evaluated); containers come back as JSON.
    """
    import json

    names = list(fields)

    def parse(batches):
        for pdf in batches:
            rows = []
            for line in pdf["value"]:
                try:
                    d = ast.literal_eval(line)
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(d, dict):
                    rows.append([None if d.get(k) is None else (d[k] if isinstance(d[k], str) else json.dumps(d[k])) for k in fields.values()])
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.text(path).mapInPandas(parse, ", ".join(f"{n} string" for n in names))


def amazon_items(spark: SparkSession, path: str, catalog: DataFrame | None = None, extension_top_n: int = 200_000) -> DataFrame:
    """2014 metadata literals: all items of ``catalog`` and the best-ranked ``extension_top_n`` others."""
    raw = literal_lines(spark, path, {"item_id": "asin", "title": "title", "brand": "brand", "categories": "categories", "price": "price", "rank": "salesRank"})
    items = raw.where("item_id is not null").select(
        "item_id", "title", "brand", F.flatten(F.from_json("categories", "array<array<string>>")).alias("categories"), F.try_to_number("price", F.lit("999999999.9999")).cast("double").alias("price"),
        F.array_min(F.map_values(F.from_json("rank", "map<string,double>"))).alias("sales_rank"),
    ).dropDuplicates(["item_id"])
    if catalog is None:
        return items
    known = items.join(catalog.select("item_id").distinct(), "item_id", "left_semi")
    other = items.join(catalog.select("item_id").distinct(), "item_id", "left_anti").orderBy(F.col("sales_rank").asc_nulls_last(), "item_id").limit(extension_top_n)
    return known.unionByName(other)


def amazon_chrono(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """All reviews in time order with the 2014 metadata."""
    (r,) = _need(root, "reviews.json.gz") if _has(spark, root, "reviews.json.gz") else _need(root, "reviews.json")
    log = amazon_reviews(spark, r, 1.0)
    meta = next((m for m in ("meta.json.gz", "meta.json") if _has(spark, root, m)), None)
    items = amazon_items(spark, f"{root}/{meta}", log) if meta else None
    return _split("amazon-book-chrono", log, items, "global", test_fraction)


def steam(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """Reviews and games as Python literals."""
    (r,) = _need(root, "steam_reviews.json.gz") if _has(spark, root, "steam_reviews.json.gz") else _need(root, "steam_reviews.json")
    raw = literal_lines(spark, r, {"entity_id": "username", "item_id": "product_id", "date": "date", "hours": "hours"})
    log = raw.select("entity_id", "item_id", F.try_to_timestamp("date").cast("timestamp_ntz").alias("timestamp"), F.col("hours").try_cast("double").alias("hours")).dropna(subset=["entity_id", "item_id", "timestamp"])
    items = None
    games = next((m for m in ("steam_games.json.gz", "steam_games.json") if _has(spark, root, m)), None)
    if games:
        g = literal_lines(spark, f"{root}/{games}", {k: k for k in ("id", "url", "title", "app_name", "genres", "tags", "specs", "developer", "publisher", "price", "release_date")})
        link = F.regexp_extract(F.coalesce("url", F.lit("")), r"/app/(\d+)", 1)
        lists = [F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("genres", "tags", "specs")]
        items = g.select(F.coalesce("id", F.when(link != "", link)).alias("item_id"), F.coalesce("title", "app_name").alias("title"), *lists, "developer", "publisher", F.col("price").try_cast("double").alias("price"), "release_date")
        items = items.where("item_id is not null").dropDuplicates(["item_id"])
    return _split("steam", log, items, "global", test_fraction)


def retailrocket(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """Events with millisecond times; carts without a purchase within a day count as removed."""
    (e,) = _need(root, "events.csv")
    raw = _csv(spark, e, {"timestamp", "visitorid", "event", "itemid"})
    events = raw.select(F.col("visitorid").cast("bigint").alias("entity_id"), F.col("itemid").cast("bigint").alias("item_id"), (F.col("timestamp").cast("bigint") / 1000.0).alias("ts"), "event")
    log = cart_outcomes(events).select("entity_id", "item_id", _naive(F.timestamp_millis((F.col("ts") * 1000).cast("bigint"))).alias("timestamp"), "action_type")
    items = None
    if any(Path(root).glob("item_properties*.csv")) if "://" not in root else True:
        p = _csv(spark, f"{root}/item_properties*.csv").where("property = 'categoryid'")
        items = latest_property(p.select(F.col("itemid").cast("bigint").alias("item_id"), F.col("timestamp").cast("bigint").alias("ts"), F.col("value").alias("category")))
    return _split("retailrocket", log, items, "global", test_fraction)


def latest_property(rows: DataFrame) -> DataFrame:
    """``(item_id, category)``: the newest value of each item, the greater one among equal times."""
    return rows.groupBy("item_id").agg(F.max_by("category", F.struct("ts", "category")).alias("category"))


def instacart(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """Prior orders; time is made from the order number, three days apart; split by the user's order quantile."""
    o, op, pr = _need(root, "orders.csv", "order_products__prior.csv", "products.csv")
    prior = _csv(spark, o).where("eval_set = 'prior'").select(F.col("order_id").cast("bigint").alias("session_id"), F.col("user_id").cast("bigint").alias("entity_id"), F.col("order_number").cast("int").alias("order_number"))
    lines = _csv(spark, op).select(F.col("order_id").cast("bigint").alias("session_id"), F.col("product_id").cast("bigint").alias("item_id"))
    rows = lines.join(prior, "session_id")
    q = prior.groupBy("entity_id").agg(F.percentile("order_number", 1 - test_fraction).alias("_q"))
    day = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(order_number * 3)")
    rows = rows.join(q, "entity_id").select("entity_id", "item_id", day.alias("timestamp"), "session_id", F.lit("add").alias("action_type"), (F.col("order_number") <= F.col("_q")).alias("_train"))
    items = _csv(spark, pr).select(F.col("product_id").cast("bigint").alias("item_id"), F.col("product_name").alias("title"), F.col("aisle_id").alias("category"))
    return DatasetSplit("instacart", rows.where("_train").drop("_train"), rows.where("not _train").drop("_train"), items)


def tafeng(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """Supermarket transactions; a session is a customer's day."""
    name = next((n for n in ("ta_feng_all_months_merged.csv", "tafeng.csv") if _has(spark, root, n)), "ta_feng_all_months_merged.csv")
    (f,) = _need(root, name)
    raw = _csv(spark, f, {"TRANSACTION_DT", "CUSTOMER_ID", "PRODUCT_ID"}, upper=True)
    t = F.coalesce(F.try_to_timestamp("TRANSACTION_DT"), F.try_to_timestamp("TRANSACTION_DT", F.lit("M/d/yyyy")))
    log = raw.select(F.col("CUSTOMER_ID").cast("bigint").alias("entity_id"), F.col("PRODUCT_ID").cast("bigint").alias("item_id"), t.cast("timestamp_ntz").alias("timestamp"), F.concat_ws("_", F.col("CUSTOMER_ID"), F.date_format(t, "yyyyMMdd")).alias("session_id"), F.lit("purchase").alias("action_type"))
    items = None
    if "PRODUCT_SUBCLASS" in raw.columns:
        items = raw.select(F.col("PRODUCT_ID").cast("bigint").alias("item_id"), F.col("PRODUCT_SUBCLASS").alias("category")).groupBy("item_id").agg(F.min("category").alias("category"))
    return _split("tafeng", log.dropna(subset=["entity_id", "item_id", "timestamp"]), items, "entity", test_fraction)


def dunnhumby(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """Household transactions; time is a base date plus DAY and TRANS_TIME (HHMM)."""
    (f,) = _need(root, "transaction_data.csv")
    raw = _csv(spark, f, {"HOUSEHOLD_KEY", "BASKET_ID", "DAY", "PRODUCT_ID"}, upper=True)
    hm = F.coalesce(F.col("TRANS_TIME").try_cast("int"), F.lit(0)) if "TRANS_TIME" in raw.columns else F.lit(0)
    raw = raw.withColumn("_d", F.coalesce(F.col("DAY").try_cast("int"), F.lit(0))).withColumn("_m", F.floor(hm / 100).cast("int") * 60 + hm % 100)
    t = F.expr("TIMESTAMP_NTZ'2017-01-01 00:00:00' + make_dt_interval(_d, 0, _m)")
    log = raw.select(F.col("HOUSEHOLD_KEY").cast("bigint").alias("entity_id"), F.col("PRODUCT_ID").cast("bigint").alias("item_id"), t.alias("timestamp"), F.col("BASKET_ID").cast("bigint").alias("session_id"), F.lit("purchase").alias("action_type"))
    items = None
    if _has(spark, root, "product.csv"):
        p = _csv(spark, f"{root}/product.csv", {"PRODUCT_ID", "COMMODITY_DESC"}, upper=True)
        items = p.select(F.col("PRODUCT_ID").cast("bigint").alias("item_id"), F.col("COMMODITY_DESC").alias("category")).groupBy("item_id").agg(F.min("category").alias("category"))
    return _split("dunnhumby", log, items, "entity", test_fraction)


def user_item_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``user item item ...`` as (entity_id, item_id)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p[0].cast("bigint").alias("entity_id"), F.explode(F.slice(p, 2, F.size(p))).alias("item_id"))
    return rows.select("entity_id", F.col("item_id").cast("bigint").alias("item_id")).dropna()


def academic(spark: SparkSession, root: str, name: str = "academic") -> DatasetSplit:
    """Given train.txt and test.txt without times."""
    a, b = _need(root, "train.txt", "test.txt")
    return DatasetSplit(name, user_item_lines(spark, a), user_item_lines(spark, b))


def gowalla(spark: SparkSession, root: str, test_fraction: float = 0.2) -> DatasetSplit:
    """Check-ins (user, UTC time, lat, lon, place), tab-separated; or the academic files."""
    name = next((n for n in ("loc-gowalla_totalCheckins.txt.gz", "loc-gowalla_totalCheckins.txt") if _has(spark, root, n)), None)
    if name is None:
        return academic(spark, root, "gowalla")
    p = F.split("value", "\t")
    raw = spark.read.text(f"{root}/{name}").select(p.alias("p")).where(F.size("p") >= 5)
    log = raw.select(F.col("p")[0].cast("bigint").alias("entity_id"), F.col("p")[4].cast("bigint").alias("item_id"), F.try_to_timestamp(F.col("p")[1]).cast("timestamp_ntz").alias("timestamp"), F.lit("checkin").alias("action_type"))
    return _split("gowalla", log.dropna(subset=["entity_id", "item_id", "timestamp"]), None, "entity", test_fraction)


def yelp(spark: SparkSession, root: str, test_fraction: float = 0.1) -> DatasetSplit:
    """Review JSON lines; or the academic files."""
    name = next((n for n in ("yelp_academic_dataset_review.json", "review.json") if _has(spark, root, n)), None)
    if name is None:
        return academic(spark, root, "yelp2018")
    raw = spark.read.schema("user_id string, business_id string, stars double, date string").option("mode", "DROPMALFORMED").json(f"{root}/{name}")
    log = raw.select(F.col("user_id").alias("entity_id"), F.col("business_id").alias("item_id"), F.try_to_timestamp("date").cast("timestamp_ntz").alias("timestamp"), F.lit("review").alias("action_type"), F.col("stars").alias("rating"))
    return _split("yelp", log.dropna(subset=["entity_id", "item_id", "timestamp"]), None, "global", test_fraction)


#: Loaders by name; where several are given, the first whose files are there is used.
REGISTRY: dict[str, list[Callable[..., DatasetSplit]]] = {
    "movielens-1m": [movielens],
    "amazon-beauty": [amazon],
    "amazon-book": [amazon_chrono, academic],
    "steam": [steam],
    "retailrocket": [retailrocket],
    "instacart": [instacart],
    "gowalla": [gowalla, academic],
    "yelp2018": [yelp, academic],
    "tafeng": [tafeng],
    "dunnhumby": [dunnhumby],
}


def load_dataset(spark: SparkSession, name: str, root: str, **opts) -> DatasetSplit:
    """A dataset of the registry from ``root``."""
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(REGISTRY))}")
    errors = []
    for load in REGISTRY[name]:
        try:
            return load(spark, root, **(opts if load is not academic else {}))
        except DataNotAvailable as e:
            errors.append(str(e))
    raise DataNotAvailable("; ".join(errors))


# ---------------------------------------------------------------- synthetic data


def synthetic_ratings(spark: SparkSession, n_entities: int = 200, n_items: int = 100, per_entity: int = 30, seed: int = 0, test_fraction: float = 0.1) -> DatasetSplit:
    """Five latent factors per entity and item; each entity takes its top items in random order over a year. Small: made on the driver."""
    rng = np.random.default_rng(seed)
    e, i = rng.normal(size=(n_entities, 5)), rng.normal(size=(n_items, 5))
    best = np.argsort(-(e @ i.T), axis=1)[:, :per_entity]
    rows = []
    for k in range(n_entities):
        mine = best[k].copy()
        rng.shuffle(mine)
        rows += [(k, int(x), int(rng.integers(0, 365))) for x in mine]
    df = spark.createDataFrame(rows, "entity_id bigint, item_id bigint, day int")
    log = df.select("entity_id", "item_id", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(day)").alias("timestamp"), F.lit("add").alias("action_type"))
    return _split("synthetic-ratings", log, None, "global", test_fraction)


def synthetic_grocery(spark: SparkSession, n_entities: int = 200, per_category: int = 15, n_categories: int = 6, n_sessions: int = 8, per_session: int = 5, seed: int = 0, test_fraction: float = 0.1) -> DatasetSplit:
    """Sessions of two liked categories each, no item twice in a session; made in parallel from hashes."""
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) / float(1 << 40)
    s = spark.range(n_entities * n_sessions).select((F.col("id") / n_sessions).cast("bigint").alias("entity_id"), (F.col("id") % n_sessions).cast("int").alias("k"), F.col("id").alias("session_id"))
    # two favourite categories per entity, one of them in most sessions
    fav = [F.floor(h(F.col("entity_id"), F.lit(x)) * n_categories).cast("int") for x in (1, 2)]
    s = s.withColumn("c1", fav[0]).withColumn("c2", F.when(h(F.col("session_id"), F.lit(3)) < 0.8, fav[1]).otherwise(F.floor(h(F.col("session_id"), F.lit(4)) * n_categories).cast("int")))
    lines = s.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(per_session - 1))))
    lines = lines.withColumn("c", F.when(h(F.col("session_id"), F.col("order"), F.lit(5)) < 0.5, F.col("c1")).otherwise(F.col("c2")))
    # a step through the category from a random start: no item comes twice in a session
    start = F.floor(h(F.col("session_id"), F.col("c"), F.lit(6)) * per_category).cast("int")
    lines = lines.withColumn("item_id", (F.col("c") * per_category + (start + F.col("order")) % per_category).cast("bigint"))
    lines = lines.withColumn("minute", F.floor(h(F.col("session_id"), F.lit(7)) * 1440).cast("int"))
    t = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(k * 3, 0, minute, order * 10)")
    log = lines.select("entity_id", "item_id", t.alias("timestamp"), "session_id", F.lit("add").alias("action_type"))
    items = spark.range(n_categories * per_category).select(F.col("id").alias("item_id"), F.concat(F.lit("cat_"), (F.col("id") / per_category).cast("int")).alias("category"))
    return _split("synthetic-grocery", log, items, "global", test_fraction)

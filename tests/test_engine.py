"""Fit and recommend end to end."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.config import EngineConfig
from spanloom.plans.engine import Engine, Server, explained
from spanloom.sources import loaders as ld

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def ratings(spark):
    s = ld.synthetic_ratings(spark, 60, 30, 12, seed=3)
    return s.train.unionByName(s.test).cache()


def lists(df):
    out = {}
    for r in df.orderBy("entity_id", "rank").collect():
        out.setdefault(r["entity_id"], []).append((r["item_id"], round(r["score"], 6)))
    return out


def test_not_fitted():
    with pytest.raises(RuntimeError):
        Engine().popular()
    assert Engine().fit_summary() == {"fitted": False}


@pytest.mark.parametrize("base", ["ease", "cooc"])
def test_fit_and_recommend(spark, ratings, base, tmp_path):
    e = Engine(EngineConfig(base_scorer=base), channel_gate=False, calibrate_boost=False).fit(ratings)
    all_lists = lists(e.recommend_batch(n=5))
    assert len(all_lists) == 60 and all(len(v) == 5 for v in all_lists.values())
    owned = {(r["entity_id"], r["item_id"]) for r in ratings.select("entity_id", "item_id").distinct().collect()}
    assert not any((u, i) in owned for u, v in all_lists.items() for i, _ in v)
    assert all(a[1] >= b[1] - 1e-9 for v in all_lists.values() for a, b in zip(v, v[1:]))
    assert lists(e.recommend(7, 5))[7] == all_lists[7]
    assert e.recommend(12345).count() == 0
    plan = e.activation_plan()
    assert plan.base == ("ease" if base == "ease" else "wilson_cooc") and "trend" in plan.summary()
    assert plan.frame(spark).count() == 5 and e.fit_summary()["fitted"]
    e.save(str(tmp_path / "m"))
    again = Engine.load(spark, str(tmp_path / "m"))
    a, b = lists(again.recommend_batch(n=5)), all_lists
    assert {u: [i for i, _ in v] for u, v in a.items()} == {u: [i for i, _ in v] for u, v in b.items()}
    known = spark.createDataFrame([(1,), (99999,)], "entity_id bigint")
    served = lists(Server(spark, str(tmp_path / "m")).recommend_batch(known, 3))
    assert len(served[99999]) == 3 and served[99999] == [(r["item_id"], round(r["score"], 6)) for r in e.popular(3).orderBy("rank").collect()]
    with pytest.raises(ValueError):
        Engine.load(spark, str(tmp_path / "none"))
    ex = explained(e.recommend(7, 2)).first()["explanation"]
    assert ex["primary"].startswith("Often seen") and ex["secondary"] is None


def test_row_order_plays_no_part(spark, ratings):
    opts = {"base_scorer": "cooc", "calibrate_boost": False}
    a = lists(Engine(**opts).fit(ratings).recommend_batch(n=5))
    b = lists(Engine(**opts).fit(ratings.orderBy(F.xxhash64("item_id", "entity_id"))).recommend_batch(n=5))
    assert a == b


def test_seeds(spark):
    rnd = random.Random(1)
    rows = []
    for u in range(200):
        g = u % 2
        rows += [(f"u{u}", f"w{g}_{i}") for i in rnd.sample(range(15), 8)]
    e = Engine(base_scorer="ease", channel_gate=False).fit(spark.createDataFrame(rows, "entity_id string, item_id string"))
    seeds = spark.createDataFrame([("a", "w0_1"), ("a", "w0_1"), ("a", "w0_2"), ("a", "w0_3"), ("a", "w0_4"), ("a", "w0_5"), ("b", "nope")], "entity_id string, item_id string")
    got = lists(e.recommend_for_items(seeds, 4))
    assert all(i.startswith("w0_") and i not in ("w0_1", "w0_2", "w0_3", "w0_4", "w0_5") for i, _ in got["a"])
    assert [i for i, _ in got["b"]] == [r["item_id"] for r in e.popular(4).orderBy("rank").collect()]


def test_repeat_gate(spark):
    rows = []
    for u in range(80):
        for c in range(7):
            rows += [(u, (u + k) % 8, T0 + dt.timedelta(days=7 * c, hours=k)) for k in range(3)]
    log = spark.createDataFrame(rows, "entity_id bigint, item_id bigint, timestamp timestamp_ntz")
    e = Engine(base_scorer="cooc", calibrate_boost=False).fit(log)
    assert e.repeat_on and e.fit_summary()["repeat_gated"]["ndcg_on"] > e.fit_summary()["repeat_gated"]["ndcg_off"]
    assert {i for i, _ in lists(e.recommend(0, 3))[0]} == {0, 1, 2}


def test_channel_gate_and_search_run(spark, ratings):
    e = Engine(last_item_alpha=50.0, ease_lambda_search=True, ease_denoise="auto", calibrate_boost=False).fit(ratings)
    s = e.fit_summary()
    assert "channels_gated" in s and s["ease_lambda"] > 0


def test_cold_slots_and_open_catalog(spark):
    rnd = random.Random(4)
    rows = [(u, i) for u in range(60) for i in rnd.sample(range(20), 8)]
    meta = [(i, f"title g{i % 3} x{i % 5}", f"g{i % 3}", float(i % 7), f"2024-0{1 + i % 9}-11") for i in range(26)]
    log = spark.createDataFrame(rows, "entity_id bigint, item_id bigint")
    m = spark.createDataFrame(meta, "item_id bigint, title string, genre string, price double, released string")
    e = Engine(base_scorer="cooc", cold_slots=2, content_alpha=0.3, metadata_smoothing="on").fit(log, m)
    got = lists(e.recommend_batch(n=6))
    assert e.t.profile["n_extension_items"] == 6
    assert all(sum(i >= 20 for i, _ in v) >= 1 and len(v) <= 6 for v in got.values())


def test_degenerate(spark):
    one = spark.createDataFrame([(1, 1), (1, 1)], "entity_id bigint, item_id bigint")
    assert Engine(base_scorer="cooc", repeat_recommend=False).fit(one).recommend_batch().count() == 0
    assert Engine(base_scorer="cooc").fit(one).recommend_batch().count() == 1  # the repeated item comes back


# ---------------------------------------------------------------- sources


def test_loaders(spark, tmp_path):
    def put(d, name, text):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / name).write_text(text, encoding="latin-1" if name.endswith(".dat") else "utf-8")
        return str(tmp_path / d)

    put("ml", "ratings.dat", "".join(f"{u}::{i}::{1 + (u + i) % 5}::{978300000 + 10 * i + u}\n" for u in range(5) for i in range(4)))
    s = ld.movielens(spark, put("ml", "movies.dat", "1::Am\xe9lie (2001)::Comedy|Drama\n"))
    assert (s.train.count(), s.test.count()) == (18, 2) and s.items.first()["category"] == "Comedy" and "\xe9" in s.items.first()["title"]
    r = put("az", "Beauty_5.json", '{"reviewerID":"a","asin":"x","overall":4.0,"unixReviewTime":1400000000}\nbroken\n{"reviewerID":"b","asin":"y","overall":5.0,"unixReviewTime":1400000001}\n')
    assert ld.load_dataset(spark, "amazon-beauty", r).train.count() == 1
    put("ac", "reviews.json", '{"reviewerID":"a","asin":"x","unixReviewTime":1400000000}\n{"reviewerID":null,"asin":"y","unixReviewTime":1}\n')
    c = ld.amazon_chrono(spark, put("ac", "meta.json", "{'asin': 'x', 'title': \"T's\", 'categories': [['A','B'],['C']], 'salesRank': {'q': 5, 'r': 3}, 'price': 1.5}\n{'asin': 'z', 'salesRank': {'q': 9}}\nnot a dict\n"))
    i = {x["item_id"]: x for x in c.items.collect()}
    assert i["x"]["categories"] == ["A", "B", "C"] and i["x"]["sales_rank"] == 3.0 and i["x"]["price"] == 1.5 and set(i) == {"x", "z"}
    put("st", "steam_reviews.json", "{'username': 'u', 'product_id': '7', 'date': '2017-01-02', 'hours': 3.5}\n{'username': 'u'}\n")
    g = ld.steam(spark, put("st", "steam_games.json", "{'url': 'http://x/app/7/q', 'app_name': 'G', 'genres': ['A'], 'price': 'Free'}\n"))
    assert g.train.count() + g.test.count() == 1 and g.items.first()["item_id"] == "7" and g.items.first()["genres"] == ["A"]
    put("rr", "events.csv", "timestamp,visitorid,event,itemid,transactionid\n1000,1,addtocart,5,\n2000,1,transaction,5,9\n3000,2,addtocart,5,\n4000,2,view,6,\n")
    rr = ld.retailrocket(spark, put("rr", "item_properties_part1.csv", "timestamp,itemid,property,value\n1,5,categoryid,10\n2,5,categoryid,11\n3,5,x,12\n"), 0.25)
    assert sorted(x["action_type"] for x in rr.train.unionByName(rr.test).collect()) == ["add", "add", "remove", "view"] and rr.items.first()["category"] == "11"
    put("ic", "orders.csv", "order_id,user_id,eval_set,order_number\n1,7,prior,1\n2,7,prior,2\n3,7,train,3\n")
    put("ic", "order_products__prior.csv", "order_id,product_id,add_to_cart_order\n1,70,1\n2,71,1\n3,72,1\n")
    ic = ld.instacart(spark, put("ic", "products.csv", "product_id,product_name,aisle_id\n70,a,1\n"))
    assert ic.train.first()["timestamp"] == dt.datetime(2024, 1, 4) and ic.test.first()["item_id"] == 71
    tf = ld.tafeng(spark, put("tf", "tafeng.csv", "transaction_dt,customer_id,product_id,product_subclass\n11/1/2000,1,5,x\n11/2/2000,1,6,y\n"), 0.5)
    assert tf.train.first()["session_id"] == "1_20001101" and tf.test.count() == 1
    dh = ld.dunnhumby(spark, put("dh", "transaction_data.csv", "household_key,BASKET_ID,DAY,PRODUCT_ID,TRANS_TIME\n1,2,1,3,1631\n"))
    assert dh.train.first()["timestamp"] == dt.datetime(2017, 1, 2, 16, 31)
    gw = ld.gowalla(spark, put("gw", "loc-gowalla_totalCheckins.txt", "0\t2010-10-19T23:55:27Z\t30.2\t-97.7\t22847\nbad\n"))
    assert gw.train.first()["timestamp"] == dt.datetime(2010, 10, 19, 23, 55, 27)
    put("ak", "train.txt", "0 1 2 3\n1 4\n2\n")
    ak = ld.load_dataset(spark, "yelp2018", put("ak", "test.txt", "0 9\n"))
    assert ak.train.count() == 4 and ak.test.count() == 1
    with pytest.raises(ld.DataNotAvailable):
        ld.load_dataset(spark, "steam", str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        ld.load_dataset(spark, "unheard-of", ".")


def test_synthetic_grocery(spark):
    s = ld.synthetic_grocery(spark, 20)
    log = s.train.unionByName(s.test)
    assert log.count() == 20 * 8 * 5 and log.groupBy("session_id", "item_id").count().where("count > 1").count() == 0


def test_streaming(spark, tmp_path):
    from spanloom.streaming.counters import maintain_popularity, read_popularity, windowed_activity

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([(1, T0), (1, T0), (2, T0 + dt.timedelta(hours=2))], "item_id bigint, ts timestamp_ntz")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = maintain_popularity(stream, out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r["item_id"], r["n"]) for r in read_popularity(spark, out).collect()} == {(1, 2), (2, 1)}
    assert windowed_activity(batch, "ts", "item_id").count() == 2

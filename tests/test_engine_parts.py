"""Recommendation operators on hand-made cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.config import EngineConfig
from spanloom.functions import decay
from spanloom.operators import channels as ch
from spanloom.operators import contract as ct
from spanloom.operators import ease as es
from spanloom.operators import edges as ed
from spanloom.operators import evaluate as ev
from spanloom.operators import features as ft
from spanloom.operators import infer_sessions as inf
from spanloom.operators import profile as pf
from spanloom.operators import repeat as rp
from spanloom.operators.closed_form import apart
from spanloom.operators.skew import assign_tasks, fragment_replicate_join, heavy_keys, per_key, plan_loads
from spanloom.plans import engine as en
from spanloom.plans import score as sc

T0 = dt.datetime(2024, 1, 1)


def log_of(spark, rows):
    """rows: (entity, item[, ts[, session[, weight]]])"""
    full = [(r[0], r[1], float(r[2]) if len(r) > 2 and r[2] is not None else None, r[3] if len(r) > 3 else None, float(r[4]) if len(r) > 4 else 1.0) for r in rows]
    return spark.createDataFrame(full, "entity_id long, item_id long, ts double, session_id long, weight double")


def edges_of(df):
    return {(r["i"], r["j"]): round(r["w"], 6) for r in df.collect()}


# ---------------------------------------------------------------- contract


def frame(spark, **kw):
    cols = {"entity_id": 1, "item_id": 2} | kw
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_validation(spark):
    ok = ct.validate(frame(spark, timestamp=T0, session_id=1, action_type="view", rating=2.0))
    assert ok.has_timestamp and ok.has_action
    for bad, text in [
        (spark.createDataFrame([(1,)], "entity_id long"), "item_id"),
        (frame(spark).where("false"), "empty"),
        (frame(spark, action_type="hug"), "hug"),
        (frame(spark, timestamp="no time"), "timestamp"),
        (frame(spark, rating="x"), "rating"),
        (spark.createDataFrame([(1, None)], "entity_id long, item_id long"), "item_id"),
        (spark.createDataFrame([(1, 2, None)], "entity_id long, item_id long, session_id long"), "session_id"),
        (spark.createDataFrame([(1, 2, True)], "entity_id long, item_id long, timestamp boolean"), "timestamp"),
    ]:
        with pytest.raises(ct.ContractError, match=text):
            ct.validate(bad)
    assert issubclass(ct.ContractError, ValueError)


def test_canonical_and_weights(spark):
    df = spark.createDataFrame([(1, 2, "2024-01-01 00:00:01", "x", r) for r in (1.0, 2.0, 3.0, 4.0, 5.0, None)], "entity_id long, item_id long, timestamp string, hours string, rating double")
    c = ct.canonical(df)
    assert c.columns == ["entity_id", "item_id", "timestamp", "rating"]
    log = ct.to_log(c)
    assert sorted(round(r["weight"], 6) for r in log.collect()) == [0, 0, 0.2, 0.6, 1, 1] and log.first()["ts"] == 1704067201.0
    assert {r["weight"] for r in ct.to_log(c, use_ratings=False).collect()} == {1.0}
    with pytest.raises(ct.ContractError):
        ct.weighted(df.drop("rating"), use_ratings=True)


def test_catalog_and_extension(spark):
    log = log_of(spark, [(1, 5), (1, 3), (2, 9)])
    meta = spark.createDataFrame([(i,) for i in (3, 1, 7, None, 7)], "item_id long")
    got = [(r["item_id"], r["item_idx"], r["is_train"]) for r in ct.catalog(log, meta).orderBy("item_idx").collect()]
    assert got == [(3, 0, True), (5, 1, True), (9, 2, True), (1, 3, False), (7, 4, False)]
    assert ct.catalog(log, meta, 1).count() == 4 and ct.catalog(log, meta, 0).count() == 3
    gib = 1024**3
    assert ct.extension_cap(24 * gib, 10**6, 10**4, 5) == 5 and ct.extension_cap(4 * gib, 1, 1) == 0
    assert ct.extension_cap(24 * gib, 10**6, 10**4) == int((min(0.8 * 24 * gib, 18 * gib) - (400 * 10**6 + 39_800 * 10**4)) // 30_000)


def test_config():
    assert EngineConfig().user_cf_k == 100
    for bad in ({"base_scorer": "x"}, {"ease_lambda": 0}, {"trend_window_fraction": 0}, {"repeat_min_rate": 2}, {"channel_gate": "on"}, {"user_cf_k": 0}, {"cold_slots": -1}, {"transition_decay": 1.5}, {"ease_denoise": -1}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            EngineConfig(**bad)


# ---------------------------------------------------------------- profile, edges


def test_profile(spark):
    log = log_of(spark, [(1, 1, 0, 10), (1, 1, 100, 10), (1, 2, 1000, 11), (2, 3, 5, 12), (2, 4, 5, 12)])
    assert pf.repeat_rate(log).first()["repeat_rate"] == pytest.approx(0.2)
    b = pf.burst(log).first()
    assert (b["n_deltas"], b["median_delta"], b["is_burst"]) == (3, 100.0, True)
    assert pf.deep_sessions(log).first()["deep_session_fraction"] == pytest.approx(1 / 3)
    assert pf.burst(log.where("false")).first()["is_burst"] is False
    for vals, want in [([1.0] * 5, "binary"), ([1.0, 2.0, 3.0, 5.0], "ratings"), ([1.0] * 90 + [500.0] * 10, "counts"), ([100.0, 101.0, 99.0], "binary"), ([], "binary")]:
        assert pf.rating_signal(spark.createDataFrame([(v,) for v in vals], "v double"), "v").first()["signal"] == want or not vals


def test_cooc_multiplicity_and_zero_weights(spark):
    log = log_of(spark, [(1, 1), (1, 1), (1, 2), (1, 2), (1, 2), (1, 3, None, None, 0.0)])
    assert edges_of(ed.cooc_counts(log)) == {(1, 2): 6.0}
    assert edges_of(ed.gram(log)) == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 2): 1, (2, 3): 1, (3, 3): 1}
    assert (1, 3) not in edges_of(ed.gram(log, use_weights=True))


def test_temporal_lift_in_bounds(spark):
    log = log_of(spark, [(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 3, 1e9)])
    e = edges_of(ed.cooc_temporal(log))
    assert e[(1, 2)] == 1.5 and e[(1, 3)] == pytest.approx(1.0)


def test_transform_matrix(spark):
    e = spark.createDataFrame([(1, 2, 4.0), (1, 3, 1.0), (2, 3, 2.0)], "i long, j long, w double")
    m = spark.createDataFrame([(1, 10), (2, 8), (3, 4)], "item_id long, n long")
    assert edges_of(ed.transform_edges(e, m, "cosine"))[(1, 2)] == round(4 / math.sqrt(80), 6)
    assert edges_of(ed.transform_edges(e, m, "jaccard"))[(2, 3)] == 0.2

    def lb(c, n, z=1.96):
        p = min(c / n, 1)
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    assert edges_of(ed.transform_edges(e, m, "wilson"))[(1, 2)] == round(min(lb(4, 10), lb(4, 8)), 6)
    assert ed.transform_edges(e, m, "raw") is e
    with pytest.raises(ValueError):
        ed.transform_edges(e, m, "x")


def test_transitions_skip_zero_weight_and_loops(spark):
    log = log_of(spark, [(1, 1, 0), (1, 9, 1, None, 0.0), (1, 2, 2), (1, 2, 3), (1, 1, 4)])
    assert edges_of(ed.transitions(log)) == {(1, 2): 1.0, (2, 1): 1.0}
    assert edges_of(ed.symmetrized(ed.transitions(log))) == {(1, 2): 2.0, (2, 1): 2.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=50))
def test_item_graph_invariants(spark, rows):
    g = ed.ItemGraph.build(log_of(spark, rows))
    e = edges_of(g.edges)
    users = {}
    for u, i in rows:
        users.setdefault(i, set()).add(u)
    assert e == {(a, b): len(users[a] & users[b]) for a in users for b in users if a < b and users[a] & users[b]}


def test_item_graph_neighbors_and_prune(spark):
    g = ed.ItemGraph.build(log_of(spark, [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 5)]))
    assert [(r["j"], r["w"]) for r in g.neighbors(1, 1).collect()] == [(2, 2.0)]
    assert g.neighbors(5, 99).count() == 0
    g2, n, w = g.prune_below(2.0)
    assert (n, w) == (4, 4.0) and edges_of(g2.edges) == {(1, 2): 2.0}


# ---------------------------------------------------------------- EASE


def test_ease_closed_form(spark):
    m = es.fit_ease(log_of(spark, [(0, 0), (0, 1), (1, 0), (2, 1)]), lam=0.5)
    assert m.b[0, 1] == pytest.approx(1 / 2.5) and m.b[0, 0] == 0
    e = edges_of(m.edges(log_of(spark, [(0, 0)])))
    assert e == {(0, 1): pytest.approx(0.4), (1, 0): pytest.approx(0.4)}
    with pytest.raises(ValueError):
        apart("solve", np.array([[1.0, 2.0], [2.0, 1.0]]), lam=0.0)
    with pytest.raises(ValueError):
        es.fit_ease(log_of(spark, [(0, i) for i in range(5)]), max_items=3)
    g = np.array([[3.0, 1.0], [1.0, 2.0]])
    rlae, p = apart("solve_rlae", g, lam=1.0, rho=0.5), np.linalg.inv(g + np.eye(2))
    assert rlae[0, 1] == pytest.approx(-p[0, 1] / (p[1, 1] + 0.5)) and rlae[0, 0] == pytest.approx(1 - p[0, 0] / (p[0, 0] + 0.5))


def test_admm_reaches_the_optimum():
    rnd = np.random.default_rng(3)
    x = (rnd.random((200, 6)) < 0.3).astype(float)
    x[:, 1] = x[:, 0]
    g = x.T @ x
    b = apart("solve_admm", g, l1=1.0, l2=5.0, rho=50.0, steps=400).astype(float)
    assert (b >= 0).all() and np.allclose(np.diag(b), 0) and b[0, 1] > 0.5
    slope = g @ b - g + 5.0 * b + 1.0  # gradient of the objective with the l1 term
    off = ~np.eye(6, dtype=bool)
    assert np.allclose(slope[off & (b > 1e-6)], 0, atol=1e-2) and (slope[off & (b <= 1e-6)] > -1e-2).all()


def test_ease_scores_do_not_depend_on_partitions(spark):
    rnd = random.Random(7)
    log = log_of(spark, [(e, rnd.randrange(40), i) for e in range(90) for i in range(rnd.randrange(1, 40))])
    m = es.fit_ease(log)
    hist = ch.multiplicity(log)
    want = {(r["entity_id"], r["item_id"]): r["base"] for r in m.scores(hist).collect()}
    for part in (hist.repartition(1), hist.repartition(7), hist.where("entity_id = 5")):
        got = {(r["entity_id"], r["item_id"]): r["base"] for r in m.scores(part).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) in (len(want), m.n)


def test_ease_scores_packed_equals_joined(spark, monkeypatch):
    rnd = random.Random(0)
    log = log_of(spark, [(rnd.randrange(20), rnd.randrange(12)) for _ in range(200)])
    m, hist = es.fit_ease(log), ch.multiplicity(log)
    a = {(r[0], r[1]): round(r[2], 4) for r in m.scores(hist).collect()}
    monkeypatch.setattr(es, "MAX_BROADCAST", 0)
    b = {(r[0], r[1]): round(r[2], 4) for r in m.scores(hist).collect()}
    assert all(abs(a[k] - b.get(k, 0.0)) < 1e-3 for k in a)


# ---------------------------------------------------------------- channels, features, repeat


def test_user_cf(spark):
    log = log_of(spark, [(1, 1), (1, 1), (1, 2), (2, 1), (2, 3), (3, 9)])
    hist, pairs = ch.multiplicity(log), log.select("entity_id", "item_id").distinct()
    n = {(r["entity_id"], r["neighbor"]): (r["overlap"], round(r["sim"], 6)) for r in ch.user_neighbors(hist, pairs).collect()}
    assert n[(1, 2)] == (2, round(2 / (math.sqrt(2) * math.sqrt(3)), 6)) and (3, 1) not in n
    v = {(r[0], r[1]): round(r[2], 6) for r in ch.user_cf(ch.user_neighbors(hist, pairs), pairs).collect()}
    assert v[(1, 3)] == n[(1, 2)][1]


def test_trend_and_fallback(spark):
    log = log_of(spark, [(1, 1, 0), (1, 2, 100), (2, 2, 100), (2, 3, 50)])
    t = {r["item_id"]: (r["n_recent"], r["trend_z"]) for r in ch.trend(log, log).collect()}
    assert t[2][0] == 2 and t[2][1] == pytest.approx(math.sqrt(2))
    flat = ch.trend(log_of(spark, [(1, 1, 5), (2, 2, 5)]), log).collect()
    assert all(r["trend_z"] is None for r in flat)
    assert [r["item_id"] for r in ch.fallback(ch.popularity(log), 2).orderBy("rank").collect()] == [2, 1]


def test_vote_decay(spark):
    log = log_of(spark, [(1, i, i) for i in range(1, 8)])
    e = spark.createDataFrame([(i, 100, 1.0) for i in range(1, 8)], "i long, j long, w double")
    assert ch.transition_votes(log, e).first()["trans"] == pytest.approx(sum(0.7**k for k in range(5)))


def test_roles_and_features(spark):
    rows = [(i, "Action|Comedy" if i % 2 else "Drama|Action", ["acme", "globex"][i % 2], float(i), f"some words {i} shared", "same", ["x", "Y "] if i < 3 else None) for i in range(10)]
    items = spark.createDataFrame(rows, "item_id long, genres string, brand string, price double, blurb string, const string, tags array<string>")
    roles = {r.column: (r.kind, r.detail) for r in ft.infer_roles(items)}
    assert roles == {"genres": ("multi_categorical", "|"), "brand": ("categorical", ""), "price": ("numeric", ""), "blurb": ("text", "unique-per-item"), "const": ("ignored", "constant"), "tags": ("multi_categorical", "list")}
    f = ft.item_features(items)
    assert {round(r["n"], 6) for r in f.groupBy("item_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()} == {1.0}
    names = {r["feature"] for r in f.select("feature").distinct().collect()}
    assert "brand=acme" in names and "genres=action" not in names and "tags=y" in names and "blurb:shared" not in names
    near = ft.nearest_items(f, 3)
    assert near.where("i = j").count() == 0 and near.groupBy("i").count().agg(F.max("count")).first()[0] <= 3
    assert ft.item_features(items.select("item_id", "const")).count() == 0


def test_smoothing_gate(spark):
    near = spark.createDataFrame([(i, i + 1, 0.1 * i, 1) for i in range(1, 8)], "i long, j long, sim double, rank int")
    up = spark.createDataFrame([(i, i + 1, 0.5 * i) for i in range(1, 8)], "i long, j long, w double")
    fit = ft.fit_dose(near, up, "ols")
    assert fit["slope"] == pytest.approx(5.0) and ft.fit_dose(near, up, "auto")["family"] == "logistic"
    assert ft.fit_dose(near, up.where("false"), "ols")["slope"] == 0.0
    assert ft.fit_dose(near, up, "poisson")["slope"] > 0


def test_release_recency(spark):
    items = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 21)] + [(50, None), (51, "soon")], "item_id long, released string")
    assert ft.release_column(items) == "released"
    r = {x["item_id"]: x["recency"] for x in ft.release_recency(items).collect()}
    assert r[20] == 1.0 and r[1] == pytest.approx(math.exp(-19 / 180)) and r[50] == r[51] == 0.0


def test_period_and_multiplier(spark):
    log = log_of(spark, [(1, 1, t) for t in (0, 10, 30, 60, 100, 150)] + [(2, 2, t * 86400 + (t % 3) * 60) for t in range(101)] + [(3, 3, 5), (3, 3, 5), (4, 4)])
    p = {(r["entity_id"], r["item_id"]): r for r in rp.repeat_profile(log).collect()}
    assert (p[(1, 1)]["period"], p[(1, 1)]["quality"], p[(1, 1)]["n_gaps"]) == (30.0, 0.3, 5)
    assert abs(p[(2, 2)]["period"] - 86400) < 8640
    assert p[(3, 3)]["period"] is None and p[(3, 3)]["quality"] == 0 and (4, 4) not in p
    assert rp.kde_period(np.full(12, 7.0)) == (7.0, 0.9)
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    d = lambda x: F.lit(x).cast("double")
    assert val(rp.repeat_multiplier(d(None), d(1.0), d(0.5))) == 1.0 and val(rp.repeat_multiplier(d(5.0), d(None), d(0.5))) == 1.0
    assert val(rp.repeat_multiplier(d(0.0), d(10.0), d(1.0))) == pytest.approx(1 / (1 + math.exp(4.2)))
    assert val(rp.repeat_multiplier(d(10.0), d(10.0), d(1.0), {"satiation": 1.0}, refractory=10.0)) == pytest.approx(1 - math.exp(-1))
    assert val(rp.repeat_multiplier(d(10.0), d(10.0), d(1.0), {"one_shot": 0.5, "repeat": 0.5})) == pytest.approx(0.5005)


def test_decay(spark):
    ages = [0.0, 180.0, 360.0, 365.0, 1000.0, -5.0]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    get = lambda f: [round(r[0], 6) for r in df.select(f(F.col("a"))).collect()]
    assert get(decay.exponential())[:3] == [1.0, 0.5, 0.25] and get(decay.exponential())[5] == 1.0
    assert get(decay.linear())[3:] == [0.0, 0.0, 1.0] and get(decay.none()) == [1.0] * 6
    assert get(decay.custom(lambda c: c * 2))[5] == 0.0
    with pytest.raises(ValueError):
        decay.linear(0)


# ---------------------------------------------------------------- skew


def test_heavy_keys_and_plan(spark):
    rows = [(1, i) for i in range(600)] + [(k % 50 + 2, k) for k in range(380)] + [(None, 3)] * 20
    df = spark.createDataFrame(rows, "k long, v long").withColumn("_hk", F.lit(1))
    plan = plan_loads(df, "k", 6)
    assert plan.total == 1000 and set(plan.shards) == {1} and len(plan.shards[1]) == 4 and sum(plan.loads) == 1000
    assert max(plan.loads) <= 1.5 * 1000 / 6
    df = df.drop("_hk")
    placed = assign_tasks(df, plan).groupBy("_task").count().collect()
    assert max(r["count"] for r in placed) <= 2 * 1000 / 6
    assert [r[0] for r in spark.createDataFrame([(s,) for s in plan.slots()], "s int").select(F.pmod(F.hash("s"), F.lit(6))).collect()] == list(range(6))
    got = per_key(df, plan, {"n": F.count(F.lit(1)), "m": F.countDistinct("v")}, {"n": F.sum("n"), "m": F.sum("m")}, F.col("v"))
    # rows move once, to the planned tasks; after that one row per key and shard does
    lines = got._jdf.queryExecution().executedPlan().toString()
    assert lines.count("Exchange hashpartitioning(_slot") == 1 and lines.count("Exchange hashpartitioning") == 2
    where = assign_tasks(df, plan, F.col("v")).repartition(6, "_slot").groupBy(F.spark_partition_id().alias("p"), "_task").count().collect()
    assert all(r["p"] == r["_task"] for r in where)
    want = {r["k"]: (r["n"], r["m"]) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v").alias("m")).collect()}
    assert {r["k"]: (r["n"], r["m"]) for r in got.collect()} == want
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (999, "d")], "k long, s string")
    plan_text = fragment_replicate_join(df, small, plan, "left")._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("Exchange hashpartitioning(_slot#") == plan_text.count("Exchange hashpartitioning") == 2 and ", _shard" not in "".join(x for x in plan_text.splitlines() if "Exchange hash" in x)
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, fragment_replicate_join(df, small, plan, how).collect()))
        assert a == sorted(map(str, df.join(small, "k", how).select(*(["k", "v"] + (["s"] if how in ("inner", "left") else []))).collect())), how
    assert [(r["key_field"], r["key_id"], r["n_rows"]) for r in heavy_keys(df, ["k"], 0.02).collect()] == [("k", 1, 600)]
    assert heavy_keys(df.where("false"), ["k"]).count() == 0


# ---------------------------------------------------------------- sessions


def test_two_normals_against_their_densities():
    rnd = np.random.default_rng(1)
    x, n = np.unique(np.round(np.concatenate([rnd.normal(3, 0.6, 4000), rnd.normal(11, 1.5, 2000)]), 4), return_counts=True)
    at, gain = inf.fit_two_normals(x, n.astype(float))
    density = lambda v, m, s: np.exp(-0.5 * ((v - m) / s) ** 2) / s
    grid = np.linspace(3, 11, 80_001)
    assert abs(at - grid[np.argmax(density(grid, 3, 0.6) <= density(grid, 11, 1.5))]) < 0.1 and gain > 1000
    assert inf.meeting_point((0.0, 1.0), (4.0, 1.0)) == pytest.approx(2.0) and inf.meeting_point((0.0, 9.0), (0.1, 0.01)) == pytest.approx(0.05)


def test_infer_sessions(spark):
    rnd = random.Random(0)
    rows, truth = [], 0
    for e in range(30):
        t = 0.0
        for _ in range(5):
            t += 3 * 86400 + rnd.random() * 86400
            truth += 1
            for _ in range(5):
                t += rnd.uniform(20, 90)
                rows.append((e, rnd.randrange(9), t))
    s = inf.infer_sessions(log_of(spark, rows))
    assert s.strategy == "gmm" and 90 < s.gap_seconds < 86400 * 3
    assert s.rows.select("session_id").distinct().count() == truth
    assert inf.infer_sessions(log_of(spark, [(1, 1, 0, 10), (1, 2, 5, 20)])).strategy == "explicit"
    few = inf.infer_sessions(log_of(spark, [(1, 1, 0), (1, 2, 1800), (1, 3, 3601)]))
    assert few.strategy == "manual_fallback" and few.rows.select("session_id").distinct().count() == 2
    assert inf.infer_sessions(log_of(spark, [(1, 1), (1, 1)])).rows.select("session_id").distinct().count() == 2


def test_cart_outcomes(spark):
    day = 86400.0
    rows = [(1, 1, 0.0, "addtocart"), (1, 1, day, "transaction"), (1, 2, 0.0, "addtocart"), (1, 2, day + 1, "transaction"), (1, 3, 10.0, "addtocart"), (1, 3, 5.0, "transaction"), (2, 1, 0.0, "view")]
    df = spark.createDataFrame(rows, "entity_id long, item_id long, ts double, event string")
    got = {(r["item_id"], r["event"]): r["action_type"] for r in inf.cart_outcomes(df).where("entity_id = 1").collect()}
    assert got == {(1, "addtocart"): "add", (1, "transaction"): "add", (2, "addtocart"): "remove", (2, "transaction"): "add", (3, "addtocart"): "remove", (3, "transaction"): "add"}


# ---------------------------------------------------------------- evaluation


def test_metrics(spark):
    recs = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (3, 1, 13)], "entity_id long, rank int, item_id long")
    rel = spark.createDataFrame([(1, 11), (1, 12), (2, 99)], "entity_id long, item_id long")
    m = ev.metrics(recs, rel, 10, 3).first()
    dcg, idcg = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert m["n_entities"] == 2 and m["precision"] == pytest.approx(1 / 3) and m["recall"] == 0.5 and m["rr"] == 0.25 and m["hit"] == 0.5
    assert m["ndcg"] == pytest.approx(dcg / idcg / 2) and m["coverage"] == 0.4
    sim = spark.createDataFrame([(10, 11, 0.5)], "i long, j long, sim double")
    assert ev.list_diversity(recs, sim, 3).where("entity_id = 1").first()["diversity"] == pytest.approx((0.5 + 1 + 1) / 3)


def test_splits(spark):
    log = log_of(spark, [(u, i, i) for u in range(3) for i in range(10)])
    assert ev.chronological_split(log, 0.1).where("is_train").count() == 27
    assert ev.leave_last_out(log).where("is_held").count() == 3
    assert ev.leave_last_fraction(log).where("is_held").count() == 6
    assert ev.quantile_split(log, 0.2).where("is_train").count() == 24
    assert ev.global_time_holdout(log).where("is_held").groupBy("entity_id").count().first()["count"] == 2
    a, b = ev.nested_subsample(log, 0.3), ev.nested_subsample(log, 0.6)
    assert a.exceptAll(b).count() == 0 and a.count() < b.count() < 30
    assert ev.user_row_cap(log, 4).groupBy("entity_id").count().agg(F.max("count")).first()[0] == 4


# ---------------------------------------------------------------- scoring against a dense model


def test_blend_equals_dense(spark):
    rnd = random.Random(2)
    n_items, users = 25, [1, 2, 3, 4]
    base = {(u, i): rnd.uniform(-1, 2) for u in users for i in range(n_items) if rnd.random() < 0.4 and u != 4}
    ch1 = {(u, i): rnd.uniform(0, 5) for u in users for i in range(n_items) if rnd.random() < 0.3}
    cold = {i: rnd.random() for i in range(n_items)}
    term = {i: rnd.gauss(0, 1) for i in range(n_items)}
    mk = lambda d, n: spark.createDataFrame([(u, i, v) for (u, i), v in d.items()], f"entity_id int, item_id int, {n} double")
    b = sc.Blend(
        sc.Channel("base", mk(base, "base"), 1.0),
        [sc.Channel("x", mk(ch1, "x"), 0.7), sc.Channel("content", mk(ch1, "content"), 0.3, spark.createDataFrame(list(cold.items()), "item_id int, scale double"))],
        spark.createDataFrame(list(term.items()), "item_id int, term double"), 0.5,
    )
    got = {(r[0], r[1]): r[2] for r in sc.blend(b, n_items, spark.createDataFrame([(u,) for u in users], "entity_id int"), 25).collect()}

    def z(v):
        return (v - v.mean()) / v.std() if v.std() > 0 else v * 0

    for u in users:
        v = np.array([base.get((u, i), 0.0) for i in range(n_items)])
        x = np.array([ch1.get((u, i), 0.0) for i in range(n_items)])
        want = (z(v) if v.std() > 0 else v) + 0.7 * z(x) + 0.3 * z(x) * np.array([cold[i] for i in range(n_items)]) + 0.5 * np.array([term[i] for i in range(n_items)])
        for i in range(n_items):
            assert got[(u, i)] == pytest.approx(want[i], abs=1e-9)


def test_layers_and_cells(spark):
    pooled = sc.pool(spark.createDataFrame([(1, i, 10.0 - i) for i in range(8)], "entity_id int, item_id int, score double"), 500)
    layer = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 7, 9.0)], "entity_id int, item_id int, value double")
    out = {r["item_id"]: r["composite"] for r in sc.boosted(pooled, [layer], 1.5, 3.0).collect()}
    assert out[7] == 6.0 and out[0] == 10.0
    assert en.pick_cell({(1.5, 1.0): 0.1, (2.5, 3.0): 0.1}, 0.2) == (2.5, 0.0)
    assert en.pick_cell({(1.5, 1.0): 0.3, (2.5, 3.0): 0.1, (3.5, 5.0): 0.3, (3.5, 4.0): 0.3}, 0.1) == (3.5, 4.0)


def test_cold_slots_cap(spark):
    top = spark.createDataFrame([(1, r, r * 10, 1.0, "cooc") for r in range(1, 4)], "entity_id int, rank int, item_id int, score double, base_kind string")
    cold = spark.createDataFrame([(1, 30, 9.0), (1, 99, 5.0), (1, 98, 4.0)], "entity_id int, item_id int, score double")
    got = [(r["rank"], r["item_id"], r["base_kind"]) for r in sc.with_cold_slots(top, cold, 1, 3).orderBy("rank").collect()]
    assert got == [(1, 10, "cooc"), (2, 20, "cooc"), (3, 99, "cold_content")]
    assert sc.with_cold_slots(top, cold, 9, 1).count() == 1


@pytest.mark.parametrize("slots", [1, 3, None])
def test_cold_candidates_equal_dense(spark, slots):
    rnd = random.Random(11)
    n, beta = 30, 2.0
    recency = {i: rnd.choice([0.0, 0.0, 0.3, 0.9, 1.0]) for i in range(10, 30)}  # items 0 to 9 are warm
    content = {(u, i): rnd.random() for u in range(6) for i in rnd.sample(range(n), 12)}
    content.update({(6, 28): 0.5})  # entity 7 has no content at all
    owned = {(u, i) for u in range(8) for i in rnd.sample(range(n), 4)}
    listed = {(u, i) for u in range(8) for i in rnd.sample(range(n), 4)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "entity_id long, item_id long")
    got = sc.cold_candidates(
        spark.createDataFrame([(u, i, v) for (u, i), v in content.items()], "entity_id long, item_id long, content double"),
        spark.createDataFrame(list(recency.items()), "item_id long, recency double"), frame(owned), n, beta, *((slots, frame(listed)) if slots else ()),
    )
    rows = got.collect()
    assert len({(r["entity_id"], r["item_id"]) for r in rows}) == len(rows)
    have = {}
    for r in rows:
        if not slots or (r["entity_id"], r["item_id"]) not in listed:
            have.setdefault(r["entity_id"], []).append((-round(r["score"], 9), r["item_id"]))
    for u in range(8):
        x = np.array([content.get((u, i), 0.0) for i in range(n)])
        z = (x - x.mean()) / x.std() if x.std() > 0 else x
        want = sorted((-round(z[i] + beta * r, 9), i) for i, r in recency.items() if (u, i) not in owned and not (slots and (u, i) in listed))
        assert [i for _, i in sorted(have[u])[:slots]] == [i for _, i in want[:slots]]
        assert [s for s, _ in sorted(have[u])[:slots]] == pytest.approx([s for s, _ in want[:slots]])


def test_ranks_quantiles_and_first_rows(spark, monkeypatch):
    from spanloom.operators import order

    rnd = random.Random(3)
    vals = [rnd.choice([None, float("nan"), 5.0, 5.0, rnd.gauss(0, 9)]) for _ in range(900)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    known = np.array([v for v in vals if v is not None and v == v])
    for few in (10**6, 20):
        monkeypatch.setattr(order, "FEW", few)
        assert order.quantiles(df, "v", [0, 0.125, 0.5, 0.85, 1]) == pytest.approx(list(np.quantile(known, [0, 0.125, 0.5, 0.85, 1])))
    assert order.quantiles(df.where("false"), "v", [0.5]) is None
    got = order.ranked(df, [F.col("v").desc_nulls_last(), F.col("id")], "r").orderBy("r").collect()
    assert [r["r"] for r in got] == list(range(1, 901)) and [r["v"] for r in got if r["v"] is not None and r["v"] == r["v"]] == sorted(known, reverse=True)
    copies = spark.createDataFrame([(1, "a")] * 50 + [(i, None) for i in range(50)], "k long, s string")
    some, more = (order.first_rows_by_hash(copies, n) for n in (30, 70))
    assert some.count() == 30 and more.count() == 70 and some.exceptAll(more).count() == 0 and order.first_rows_by_hash(copies, 500).count() == 100


def test_popularity_lists_of_heavy_owners(spark):
    log = log_of(spark, [(0, i) for i in range(200)] + [(u, i) for u in range(1, 9) for i in range(u * 3)] + [(50, 900), (50, 0)])
    owned, n = {}, {}
    for r in log.select("entity_id", "item_id").collect():
        owned.setdefault(r[0], set()).add(r[1])
        n[r[1]] = n.get(r[1], 0) + 1
    want = {u: [i for i in sorted(n, key=lambda i: (-n[i], i)) if i not in o][:5] for u, o in owned.items()}
    got = {}
    for r in ev.popularity_lists(log, log, 5).orderBy("entity_id", "rank").collect():
        got.setdefault(r["entity_id"], []).append(r["item_id"])
    assert got == {u: w for u, w in want.items() if w}
    assert ev.popularity_lists(log, log, 5, mask=False).count() == 5 * len(owned)


def test_pairs_of_a_hot_key(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(0, rnd.randrange(60), rnd.randrange(9)) for _ in range(150)] + [(rnd.randrange(1, 30), rnd.randrange(60), rnd.randrange(9)) for _ in range(300)]
    log = log_of(spark, rows)
    whole = [edges_of(f(log)) for f in (ed.cooc_counts, ed.cooc_temporal, ed.gram)]
    monkeypatch.setattr(ed, "BLOCK", 7)  # the hot key in many blocks
    for a, b in zip(whole, (edges_of(f(log)) for f in (ed.cooc_counts, ed.cooc_temporal, ed.gram)), strict=True):
        assert a == pytest.approx(b) and len(a) > 500


def test_packed_equals_joined(spark, monkeypatch):
    """Neighbours, content, nearest items, cold shelves and the blended pool: sums in arrays and joins give the same."""
    from spanloom.operators import sparse
    from spanloom.plans import packed as pk

    rnd = random.Random(6)
    log = log_of(spark, [(rnd.randrange(25), rnd.randrange(30), t) for t in range(250)])
    hist, pairs = ch.multiplicity(log), log.select("entity_id", "item_id").distinct()
    f = ft.weigh_features(spark.createDataFrame([(i, f"g={rnd.randrange(6)}") for i in range(40) for _ in range(3)], "item_id long, feature string").distinct(), 40)
    cold = spark.createDataFrame([(i, i / 50) for i in range(25, 45)], "item_id long, recency double")
    show = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
    calls = [lambda: pk.user_neighbors(hist, pairs, 7), lambda: pk.user_neighbors(hist, pairs, 7, False), lambda: pk.content_scores(hist, f), lambda: pk.nearest_items(f, 4).select("i", "j", "sim", "rank"), lambda: pk.cold_shelf(hist, f, cold, 40, 2.0, 3, pairs.where("item_id > 28")).select("entity_id", "item_id", "score")]
    packed = [show(c()) for c in calls]
    monkeypatch.setattr(sparse, "fits", lambda *a, **k: False)
    assert [show(c()) for c in calls] == packed and all(packed)
    assert pk.blended_pool(log, ed.cooc_counts(log), None, None, {}) is None


def test_packed_lists_equal_joined(spark):
    from spanloom.plans.packed import top_by_edges

    rnd = random.Random(5)
    log = log_of(spark, [(rnd.randrange(30), rnd.randrange(40)) for _ in range(300)] + [(77, 900)])
    half = ed.transform_edges(ed.cooc_counts(log), ed.item_rows(log), "cosine")
    a, b = ([tuple(r)[:3] + (round(r["score"], 6),) for r in top_by_edges(log, half, 6, m).orderBy("entity_id", "rank").collect()] for m in (10**6, 0))
    assert a == b and len(a) > 100
    assert top_by_edges(log.where("false"), half.where("false")).count() == 0


@pytest.mark.parametrize(("square", "dense"), [(1024, 10**7), (0, 0)])
def test_classes_of_equal_features_equal_joined(spark, monkeypatch, square, dense):
    """Lists by classes of items of equal features, which hold numbers only in the driver, are those of the joins."""
    from spanloom.operators import classes as cl
    from spanloom.operators import sparse
    from spanloom.plans import packed as pk

    rnd = random.Random(9)
    log = log_of(spark, [(rnd.randrange(25), rnd.randrange(70)) for _ in range(400)])
    hist = ch.multiplicity(log)
    f = ft.weigh_features(spark.createDataFrame([(i, f"{c}={i // 5 % m}") for i in range(66) for c, m in (("a", 5), ("b", 3))], "item_id long, feature string"), 66)
    cold = spark.createDataFrame([(i, i % 3 / 50) for i in range(20, 72)], "item_id long, recency double")
    listed = hist.select("entity_id", (F.col("item_id") + 1).alias("item_id")).distinct()
    found, _ = cl.classes(f)
    assert len(found.items) == 66 and len(found.starts) - 1 == 14 and all(x.dtype.kind in "if" for x in (found.items, found.of, found.codes, found.vals))
    monkeypatch.setattr(cl, "MAX_SQUARE", square)
    monkeypatch.setattr(pk, "MAX_DENSE", dense)
    show = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
    calls = [lambda: pk.content_scores(hist, f), *[lambda k=k: pk.nearest_items(f, k).select("i", "j", "sim", "rank") for k in (2, 30)]]
    calls += [lambda b=b, x=x: pk.cold_shelf(hist, f, cold, 70, b, 6, x).select("entity_id", "item_id", "score") for b in (0.0, 2.0) for x in (None, listed)]
    packed = [show(c()) for c in calls]
    monkeypatch.setattr(sparse, "fits", lambda *a, **k: False)
    for a, c in zip(packed, calls, strict=True):
        assert a == [pytest.approx(x, abs=2e-6) for x in show(c())] and a


@pytest.mark.parametrize("at_once", [10, 10**6])
def test_edges_in_blocks_equal_joined(spark, monkeypatch, at_once):
    """Edges of packed lists, summed block by block, without a shuffled row per pair."""
    from spanloom.operators import pairs as pr

    rnd = random.Random(11)
    rows = [(rnd.randrange(40), rnd.randrange(-30, 50) * 10**9, None, None, rnd.choice([0.0, 0.25, 1.0, 3.0])) for _ in range(500)] + [(None, 7, None, None, 1.0), (99, 7, None, None, 1.0)]
    log = log_of(spark, rows)
    monkeypatch.setattr(pr, "AT_ONCE", at_once)
    for how in ("raw", "cosine", "jaccard", "wilson"):
        got = edges_of(pr.cooc_edges(log, how))
        assert got == pytest.approx(edges_of(ed.transform_edges(ed.cooc_counts(log), ed.item_rows(log), how)), abs=2e-6) and len(got) > 500
    assert pr.cooc_edges(log.where("false"), "cosine").count() == 0
    plan = pr.cooc_edges(log, "cosine")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize(("per_block", "places", "weights"), [(10**6, 10**6, [1.0]), (150, 40, [0.0, 1.0, 3.0]), (1, 7, [0.0, 0.3, 2.5])])
def test_lists_without_kept_edges_equal_joined(spark, monkeypatch, per_block, places, weights):
    """Lists from edges that are made in blocks are those of the edges themselves."""
    from spanloom.operators import packs
    from spanloom.plans import packed as pk

    rnd = random.Random(12)
    log = log_of(spark, [(rnd.randrange(30) * 7, rnd.randrange(-20, 30) * 10**9, None, None, rnd.choice(weights)) for _ in range(400)] + [(999, 5, None, None, 1.0)])
    some = log.where("entity_id % 2 = 0").limit(90)
    monkeypatch.setattr(packs, "PER_BLOCK", per_block)
    monkeypatch.setattr(packs, "PLACES", places)
    show = lambda d: [tuple(r)[:3] + (pytest.approx(r["score"], abs=1e-8),) for r in d.select("entity_id", "rank", "item_id", "score").orderBy("entity_id", "rank").collect()]
    for how in ("raw", "cosine", "jaccard", "wilson"):
        half = ed.transform_edges(ed.cooc_counts(log), ed.item_rows(log), how)
        for who in (log, some):
            want = show(pk.top_by_edges(who, half, 6, 0))
            assert show(pk.top_by_log(who, log, how, 6)) == want and len(want) > 50
    assert pk.top_by_log(log.where("false"), log.where("false"), "wilson").count() == 0


@pytest.mark.parametrize("at_once", [7, 131_072])
def test_content_rows_equal_joined_and_fold(spark, tmp_path, monkeypatch, at_once):
    """Every item for every entity, rounded as by SQL; members of a class repeat their scores, so written rows take few bytes."""
    import pyarrow.parquet as pq

    from spanloom.operators import sparse
    from spanloom.plans import packed as pk

    def written(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        groups = [m.row_group(k) for p in (tmp_path / name).glob("*.parquet") for m in [pq.ParquetFile(p).metadata] for k in range(m.num_row_groups)]
        return spark.read.parquet(f"{tmp_path}/{name}"), sum(g.column(k).total_compressed_size for g in groups for k in range(3)) / sum(g.num_rows for g in groups)

    monkeypatch.setattr(pk, "AT_ONCE", at_once)
    many = 1000 if at_once > 7 else 40  # classes of six items each, ids far apart
    raw = spark.range(many * 6).select(F.col("id").alias("item_id"), F.explode(F.expr(f"array(concat('a=', id % {many} % 60), concat('b=', id % {many} div 60), concat('c=', id % 2))")).alias("feature"))
    f = ft.weigh_features(raw, many * 6, 2, 1.0)
    rnd = random.Random(13)
    hist = ch.multiplicity(log_of(spark, [(rnd.randrange(many // 4), rnd.randrange(many * 6 + 9)) for _ in range(2 * many)]))
    rows, size = written(pk.content_scores(hist, f, 6), "rows")
    want, _ = written(ch.content_scores(hist, f), "joined")
    assert rows.count() == want.count() > many * many / 3 and rows.columns == want.columns
    off = rows.withColumnRenamed("content", "x").join(want, ["entity_id", "item_id"], "full").where("x is null or content is null or abs(x - content) > 6e-7 or x <> round(x, 6)")
    assert off.count() == 0
    if at_once > 7:
        by_entity = written(rows.orderBy("entity_id", "item_id"), "by_entity")[1]
        assert size < 0.6 * by_entity
    x = np.array([0.0000005, 1.0000005, -2.5, 2.4999999, 1e300])
    assert sparse.half_up(x, 6).tolist()[:2] == [0.000001, 1.000001] and sparse.half_up(x, 0).tolist()[2:4] == [-3.0, 2.0]

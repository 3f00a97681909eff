"""Registered engine queries on small tables that hold what the test tables lack."""

import datetime as dt
import inspect
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import queries_engine as qe
from spanloom.operators import repeat as rp
from spanloom.plans import engine as en

T0 = dt.datetime(2024, 1, 1)


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def events(spark, path, rows):
    """rows: (user, item, seconds)"""
    full = [(k, u, json.dumps({"k": i}), T0 + dt.timedelta(seconds=t), "view") for k, (u, i, t) in enumerate(rows)]
    write(spark, path, "events", full, "event_id long, user_id long, props string, ts timestamp_ntz, event_type string")


def test_repeat_queries_hold_pairs_of_many_gaps(spark, tmp_path):
    times = {(1, 1): [0, 10, 30, 60], (1, 2): [k * k * 50 for k in range(10)], (2, 1): [k * 600 + k % 3 * 7 for k in range(11)], (2, 2): [k * 900 + k % 4 * 11 for k in range(40)], (3, 1): [5, 5], (4, 4): [20]}
    events(spark, tmp_path, [(*p, t) for p, ts in times.items() for t in ts])
    now, profile, factor = max(t for ts in times.values() for t in ts), {}, {}
    for p, ts in times.items():
        if len(ts) < 2:
            continue
        gaps = [b - a for a, b in zip(ts, ts[1:]) if b > a]
        period, quality = rp.kde_period(np.array(gaps, float)) if len(gaps) >= 10 else (float(np.median(gaps)), 0.3) if gaps else (None, 0.0)
        profile[p] = (len(ts), len(gaps), period, quality)
        factor[p] = 1.0 if period is None else quality / (1 + math.exp(-6 * ((now - ts[-1]) / period - 0.7))) + 1 - quality
    got = {(r["entity_id"], r["item_id"]): r for r in qe.repeat_profile_median(spark, str(tmp_path)).collect()}
    assert {p: (r["cnt"], r["n_gaps"]) for p, r in got.items()} == {p: v[:2] for p, v in profile.items()}
    assert sorted(v[1] for v in profile.values()) == [0, 3, 9, 10, 39]
    for p, (_, _, period, quality) in profile.items():
        assert got[p]["period"] == (None if period is None else pytest.approx(period, abs=1e-3)) and got[p]["quality"] == pytest.approx(quality)
    mult = {(r["entity_id"], r["item_id"]): r["multiplier"] for r in qe.repeat_multiplier(spark, str(tmp_path)).collect()}
    assert mult == {p: pytest.approx(v, abs=1e-6) for p, v in factor.items()}


def orders(spark, path):
    """60 parts: 41 to 60 are unsold, 31 to 40 sold once or twice, 10, 20 and 30 sold like the rest; returns (customer, part) rows."""
    rnd = random.Random(5)
    sold = [(rnd.randrange(1, 6), p) for p in range(1, 31) for _ in range(25)] + [(1 + p % 5, p) for p in range(31, 41) for _ in range(1 + p % 2)]
    write(spark, path, "orders", [(k, c) for k, (c, _) in enumerate(sold)], "o_orderkey long, o_custkey long")
    write(spark, path, "lineitem", [(k, p, T0 + dt.timedelta(hours=k), 1.0) for k, (_, p) in enumerate(sold)], "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz, l_quantity double")
    parts = [(p, f"name {rnd.randrange(6)}", f"brand {p % 7}", f"type {p % 4}", 1 + p * 7 % 50, 900.0 + p * 13 % 71) for p in range(1, 61)]
    write(spark, path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    return sold


def test_coldness_and_extension_over_the_whole_log(spark, tmp_path):
    sold = orders(spark, tmp_path)
    n = {p: sum(i == p for _, i in sold) for p in range(1, 61)}
    got = {r["item_id"]: r["coldness"] for r in qe.coldness(spark, str(tmp_path)).collect()}
    assert got == {p: pytest.approx(max(0.0, 1 - k / 20)) for p, k in n.items()}
    assert got[10] == 0.0 and got[31] == pytest.approx(0.9) and got[60] == 1.0
    rows = sorted((r["item_idx"], r["item_id"], r["is_train"]) for r in qe.open_catalog_extension(spark, str(tmp_path)).collect())
    assert rows == [(p - 1, p, p <= 40) for p in range(1, 61)]


def test_cold_lists_over_the_whole_log(spark, tmp_path):
    sold = orders(spark, tmp_path)
    w = np.zeros((61, 200))
    seen: dict[str, int] = {}
    for r in qe.part_features(spark, str(tmp_path)).collect():
        w[r["item_id"], seen.setdefault(r["feature"], len(seen))] = r["w"]
    want = set()
    for u in range(1, 6):
        own = [i for c, i in sold if c == u]
        x = (w @ w[own].sum(axis=0))[1:]
        z = (x - x.mean()) / x.std()
        free = [i for i in range(31, 61) if i not in own]
        for rank, i in enumerate(sorted(free, key=lambda i: (-round(z[i - 1], 9), i))[:10], 1):
            want.add((u, rank, i, round(z[i - 1], 4)))
    got = {(r["entity_id"], r["rank"], r["item_id"], round(r["score"], 4)) for r in qe.cold_slot_topk(spark, str(tmp_path)).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert {x[:3]: x[3] for x in got} == {x[:3]: pytest.approx(x[3], abs=2e-4) for x in want}


def unit_weights(raw, n):
    """{(item, feature): weight} from {item: features}: IDF of features of 2 to n / 2 items, unit length."""
    df: dict[str, int] = {}
    for f in (f for fs in raw.values() for f in fs):
        df[f] = df.get(f, 0) + 1
    out = {}
    for i, fs in raw.items():
        idf = {f: math.log((1 + n) / (1 + df[f])) + 1 for f in fs if 2 <= df[f] <= max(n // 2, 1)}
        size = math.sqrt(sum(v * v for v in idf.values()))
        out.update({(i, f): v / size for f, v in idf.items()})
    return out


def test_content_features_hold_all_columns(spark, tmp_path):
    orders(spark, tmp_path)
    part = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/part.parquet").collect()]
    raw = {r["p_partkey"]: {f"{c}={r[c]}" for c in ("p_name", "p_brand", "p_type")} for r in part}
    for c in ("p_size", "p_retailprice"):
        cuts = set(np.quantile([r[c] for r in part], np.arange(1, 8) / 8))
        for r in part:
            raw[r["p_partkey"]].add(f"{c}=bin{sum(x < r[c] for x in cuts)}")
    want = unit_weights(raw, 60)
    got = {(r["item_id"], r["feature"]): r["w"] for r in qe.content_features(spark, str(tmp_path)).collect()}
    assert any(f.startswith("p_name=") for _, f in got)
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_text_features(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    items = [(i, i, " ".join(rnd.sample(words, 3)).upper() + "!" + " common" * (i % 4 > 0)) for i in range(20)]
    write(spark, tmp_path, "items", items, "meta_id long, item_id long, title string")
    want = unit_weights({i: {f"title:{w}" for w in t.lower().replace("!", "").split()} for _, i, t in items}, 20)
    got = {(r["item_id"], r["feature"]): r["w"] for r in qe.text_features(spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_baselines_run_with_the_full_parameters(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    owned = {u: set(rnd.sample(range(40), 12)) for u in range(50)}
    events(spark, tmp_path, [(u, i, 60 * u + i) for u, s in owned.items() for i in s])
    n = {i: sum(i in s for s in owned.values()) for i in range(40)}
    w = {(i, j): sum(i in s and j in s for s in owned.values()) / math.sqrt(n[i] * n[j]) for i in range(40) for j in range(40) if i != j}
    want = set()
    for u, s in owned.items():
        score = {j: sum(w[i, j] for i in s) for j in range(40) if j not in s}
        want |= {(u, r, j) for r, j in enumerate(sorted(score, key=lambda j: (-round(score[j], 9), j))[:10], 1)}
    assert {(r["entity_id"], r["rank"], r["item_id"]) for r in qe.item_knn_baseline(spark, str(tmp_path)).collect()} == want

    used = {}
    fit = inspect.signature(qe.ev.als_lists)
    monkeypatch.setattr(qe.ev, "als_lists", lambda *a, **k: (b := fit.bind(*a, **k), b.apply_defaults(), used.update(b.arguments)))
    qe.als_baseline(spark, str(tmp_path))
    assert (used["n"], used["factors"], used["iterations"]) == (10, 64, 15)


def lists_of(log, w, n=10):
    """{(entity, rank, item)} by sums of symmetric weights ``w`` over the history ``log``, owned items left out."""
    items, out = sorted({i for _, i in log}), set()
    for u in {u for u, _ in log}:
        own = [i for v, i in log if v == u]
        score = {j: sum(w.get((min(i, j), max(i, j)), 0.0) for i in own) for j in items if j not in own}
        out |= {(u, r, j) for r, j in enumerate(sorted((j for j in score if score[j] > 0), key=lambda j: (-round(score[j], 9), j))[:n], 1)}
    return out


def no_edges(monkeypatch):
    """Queries that write or join edges break off."""
    def refused(*a, **k):
        raise AssertionError("edges are kept")

    for name in ("cooc_edges", "_wilson_half", "_wilson"):
        monkeypatch.setattr(qe, name, refused)
    for name in ("cooc_counts", "mirrored", "transform_edges"):
        monkeypatch.setattr(qe.ed, name, refused)


def wilson_of(log):
    n, c = Counter(i for _, i in log), Counter()
    for u in {u for u, _ in log}:
        own = Counter(i for v, i in log if v == u)
        for i in own:
            for j in own:
                if i < j:
                    c[i, j] += own[i] * own[j]

    def low(x, m):
        p, z = min(x / m, 1.0), 1.96**2
        return (p + z / (2 * m) - 1.96 * math.sqrt(p * (1 - p) / m + z / (4 * m * m))) / (1 + z / m)

    return {k: min(low(x, n[k[0]]), low(x, n[k[1]])) for k, x in c.items()}


def shop(spark, path, seed=4):
    """Orders of a few parts each by 40 customers; (customer, part) rows."""
    rnd = random.Random(seed)
    log, orders_, lines = [], [], []
    for o in range(160):
        u = rnd.randrange(40)
        orders_.append((o, u))
        for p in rnd.sample(range(70), rnd.randrange(1, 5)):
            log.append((u, p))
            lines.append((o, p, T0 + dt.timedelta(days=rnd.randrange(300)), 1.0))
    write(spark, path, "orders", orders_, "o_orderkey long, o_custkey long")
    write(spark, path, "lineitem", lines, "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz, l_quantity double")
    return log


def test_base_scores_topk_keeps_no_edges(spark, tmp_path, monkeypatch):
    log = shop(spark, tmp_path)
    no_edges(monkeypatch)
    got = {(r["entity_id"], r["rank"], r["item_id"]) for r in qe.base_scores_topk(spark, str(tmp_path)).collect()}
    assert got == lists_of(log, wilson_of(log))


def test_smoothing_dose_ols_sums_only_the_near_edges(spark, tmp_path, monkeypatch):
    log = shop(spark, tmp_path)
    parts = [(p, f"name {p % 9}", f"brand {p % 7}", f"type {p % 4}", 1 + p * 7 % 50, 900.0 + p * 13 % 71) for p in range(75)]  # 70 to 74 are unsold
    write(spark, tmp_path, "part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    near = [(r["i"], r["j"], r["sim"]) for r in qe.pk.nearest_items(qe.part_features(spark, str(tmp_path)), 20).collect()]
    own = {u: Counter(i for v, i in log if v == u) for u in {u for u, _ in log}}
    sim, t = np.array([s for *_, s in near]), np.array([float(sum(c[i] * c[j] for c in own.values())) for i, j, _ in near])
    no_edges(monkeypatch)
    (got,) = qe.smoothing_dose_ols(spark, str(tmp_path)).collect()
    slope, intercept = np.polyfit(sim, t, 1)
    assert (got["slope"], got["intercept"], got["n"]) == (pytest.approx(slope, abs=2e-6), pytest.approx(intercept, abs=2e-6), len(near)) and t.max() > 1


def unmade(spark):
    """Edges that break off the query that makes them."""
    return lambda *a, **k: spark.range(1).select(*[F.raise_error(F.lit("edges are made")).cast(t).alias(c) for c, t in (("i", "bigint"), ("j", "bigint"), ("w", "double"))])


def test_engine_topk_makes_no_edges(spark, tmp_path, monkeypatch):
    log = shop(spark, tmp_path)
    no_edges(monkeypatch)
    monkeypatch.setattr(en, "cooc_edges", unmade(spark), raising=False)
    monkeypatch.setattr(qe.ed, "mirrored", lambda e: e)
    got = {(r["entity_id"], r["rank"], r["item_id"]) for r in qe.engine_topk(spark, str(tmp_path)).collect()}
    assert got == lists_of(log, wilson_of(log))


def test_seed_recommend_makes_no_edges(spark, tmp_path, monkeypatch):
    log = shop(spark, tmp_path)
    w, n = wilson_of(log), Counter(i for _, i in log)
    items = sorted(n)
    pz = np.log1p([n[i] for i in items])
    pz = dict(zip(items, (pz - pz.mean()) / pz.std(), strict=True))
    want = set()
    for u in {u for u, _ in log}:
        seeds = {f(i for v, i in log if v == u) for f in (min, max)}
        score = {j: sum(w.get((min(i, j), max(i, j)), 0.0) for i in seeds) + 8 / len(seeds) * pz[j] for j in items if j not in seeds}
        want |= {(u, r, j) for r, j in enumerate(sorted(score, key=lambda j: (-round(score[j], 9), j))[:10], 1)}
    no_edges(monkeypatch)
    monkeypatch.setattr(qe.ed, "mirrored", lambda e: e)
    monkeypatch.setattr(en, "cooc_edges", unmade(spark), raising=False)
    assert {(r["entity_id"], r["rank"], r["item_id"]) for r in qe.seed_recommend(spark, str(tmp_path)).collect()} == want


def blend_of(spark, path, log):
    """{customer: score per part}: Wilson base and transitions as z-scores over all parts, trend added."""
    rows = sorted((r["entity_id"], r["ts"], r["session_id"], r["item_id"]) for r in qe.orders_log(spark, str(path)).collect())
    items, w = sorted({i for _, i in log}), wilson_of(log)
    hi, lo = max(r[1] for r in rows), min(r[1] for r in rows)
    recent = Counter(r[3] for r in rows if r[1] >= hi - (hi - lo) * 0.1)
    z = lambda x: (x - x.mean()) / x.std() if x.std() > 0 else None
    trend, steps, out = z(np.array([float(recent[i]) for i in items])), Counter(), {}
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0] and a[3] != b[3]:
            steps[a[3], b[3]] += 1
    for u in {u for u, _ in log}:
        own = [r[3] for r in rows if r[0] == u]
        base = np.array([sum(w.get((min(i, j), max(i, j)), 0.0) for i in own) for j in items])
        vote = np.array([sum(0.7**k * steps[i, j] for k, i in enumerate(own[::-1][:5])) for j in items])
        total = (base if z(base) is None else z(base)) + 0.5 * trend + (0 if z(vote) is None else 0.25 * z(vote))
        out[u] = {j: t for j, t in zip(items, total, strict=True) if j not in own}
    return out


def test_blended_topk_keeps_no_edges(spark, tmp_path, monkeypatch):
    want = {(u, r, j) for u, s in blend_of(spark, tmp_path, shop(spark, tmp_path)).items() for r, j in enumerate(sorted(s, key=lambda j: (-round(s[j], 9), j))[:10], 1)}
    no_edges(monkeypatch)
    assert {(r["entity_id"], r["rank"], r["item_id"]) for r in qe.blended_topk(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("budget", [25, 500])
def test_layered_boost_keeps_no_edges(spark, tmp_path, monkeypatch, budget):
    log = shop(spark, tmp_path)
    orders_ = {}
    for r in qe.orders_log(spark, str(tmp_path)).collect():
        orders_.setdefault(r["session_id"], set()).add(r["item_id"])
    met, want, lifted = Counter((i, j) for s in orders_.values() for i in s for j in s if i != j), set(), 0
    for u, s in blend_of(spark, tmp_path, log).items():
        pool = sorted(s, key=lambda j: (-round(s[j], 9), j))[:budget]
        v = np.array([float(sum(met[i, j] for x, i in log if x == u)) for j in pool])
        gaps = [g for g in -np.diff([s[j] for j in pool[:20]]) if g > 0]
        fired = (v > 0) & ((v - v[v > 0].mean()) / max(v[v > 0].std(), 1e-9) > 2.5) if (v > 0).sum() >= 3 else np.zeros(len(v), bool)
        total = np.array([s[j] for j in pool]) + 3.0 * (np.median(gaps) if gaps else 0.0) * fired
        lifted += fired.sum()
        want |= {(u, r, pool[k]) for r, k in enumerate(sorted(range(len(pool)), key=lambda k: (-round(total[k], 9), k))[:10], 1)}
    no_edges(monkeypatch)
    monkeypatch.setattr(qe, "BUDGET", budget)
    assert {(r["entity_id"], r["rank"], r["item_id"]) for r in qe.layered_boost(spark, str(tmp_path)).collect()} == want and lifted > 5

"""The llm operators against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import cooccurrence as co
from spanloom.llm import leakage, overlap
from spanloom.llm.fusion import fuse_rankings
from spanloom.llm.leakage import leaked_items, plain_words
from spanloom.llm.overlap import cross_split_overlaps, overlap_report
from spanloom.llm.packing import pack, pack_all, plan_containers, step_groups, token_counts
from spanloom.llm.sentences import sentence_units, unit_ends
from spanloom.llm.topn import top_n_per_group

# ---------------------------------------------------------------- top N


def _brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if i is None or s is None or math.isnan(s) or math.isinf(s):
            continue
        s = s + 0.0
        best.setdefault(g, {})
        best[g][i] = max(best[g].get(i, -math.inf), s)
    out = set()
    for g, d in best.items():
        for r, (i, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out.add((g, r, i))
    return out


@pytest.mark.parametrize("heavy", [None, 10])
def test_top_n(spark, heavy):
    rnd = random.Random(3)
    pool = [0.0, -0.0, 1.5, 1.5, -3e300, 3e-300, 7.25, float("nan"), float("inf"), None]
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([*range(30), None]), rnd.choice(pool) if rnd.random() < 0.4 else rnd.uniform(-5, 5)) for _ in range(900)]
    rows += [(5, i, 1e6 + i * 1e-6) for i in range(200)] + [(6, 1, 2.0)] * 300 + [(6, 2, 1.0)]
    df = spark.createDataFrame(rows, "g long, i long, s double").withColumn("rank_no", F.lit("x")).withColumn("_b", F.lit(1))
    got = top_n_per_group(df, "g", "i", "s", 5, heavy)
    assert {(r["g"], r["rank_no"], r["i"]) for r in got.collect()} == _brute_top(rows, 5)
    assert top_n_per_group(df.where("false"), "g", "i", "s", 5).count() == 0


def test_top_n_large_n(spark):
    rows = [(1, i % 80, float(i)) for i in range(800)]
    df = spark.createDataFrame(rows, "g long, i long, s double")
    assert {(r["g"], r["rank_no"], r["i"]) for r in top_n_per_group(df, "g", "i", "s", 60, 10).collect()} == _brute_top(rows, 60)


# ---------------------------------------------------------------- overlaps


def test_overlaps(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(160):
        base = rnd.sample(words, 14)
        for c in range(3):
            t = list(base)
            for _ in range(rnd.randrange(0, 5)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), rnd.choice(["a", "b"]), rnd.choice(["train", "test"]), f"U-{k:05d}" if c else f"u.{k}", f"M{k}", f"2024-01-01 00:0{rnd.randrange(8)}:00" if rnd.random() < 0.9 else None, rnd.choice([None, 1.0, 1.5, 2.0]), " ".join(t) if rnd.random() < 0.8 else rnd.choice([None, "", "too short"])))
    rows += [(1000 + i, "z", s, None, None, None, None, "one two three four five six seven eight") for i, s in enumerate(["train", "test", "test", "train"])]
    df = spark.createDataFrame(rows, "record_id long, source string, split string, entity_id string, item_id string, ts string, rating double, remark string")
    df = df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts").withColumn("words", F.lit(1)).withColumn("key", F.lit(2))

    def canon(s):
        return None if s is None else re.sub(r"(?<![0-9])0+(?=[0-9])", "", re.sub("[^a-z0-9]", "", s.lower()))

    want = set()
    for a, b in itertools.combinations(rows, 2):
        if {a[2], b[2]} != {"train", "test"}:
            continue
        wa, wb = (set(re.findall("[a-z0-9]+", (x[7] or "").lower())) for x in (a, b))
        text = len(wa) >= 8 and len(wb) >= 8 and len(wa & wb) >= 0.6 * len(wa | wb) - 1e-9
        near = a[1] == b[1] and a[3] and canon(a[3]) == canon(b[3]) and canon(a[4]) == canon(b[4]) and a[5] and b[5] and abs(int(a[5][15]) - int(b[5][15])) * 60 <= 300 and (a[6] is None or b[6] is None or abs(a[6] - b[6]) <= 0.5)
        if text or near:
            want.add(tuple(sorted((a[0], b[0]))))
    got = [tuple(sorted((r["train_id"], r["test_id"]))) for r in cross_split_overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    links = Counter(i for p in want for i in p)
    report = {}
    for r in rows:
        n = report.setdefault((r[2], r[1]), [0, 0, 0])
        n[0], n[1], n[2] = n[0] + 1, n[1] + (links[r[0]] > 0), n[2] + links[r[0]]
    assert {(r["split"], r["source"]): [r["n_records"], r["n_overlapping"], r["n_pairs"]] for r in overlap_report(df).collect()} == report
    monkeypatch.setattr(overlap, "BLOCK", 3)
    assert {tuple(sorted((r["train_id"], r["test_id"]))) for r in cross_split_overlaps(df).collect()} == want
    assert cross_split_overlaps(df.where("false")).count() == 0


def test_one_bucket_of_many_classes(spark):
    """Boilerplate that 30,000 different texts share stays in split buckets and gives exactly the near copies."""
    n = 30_000
    own = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.concat(F.lit("w"), F.floor(F.col("id") / 2), F.lit("x"), i)), " ")
    df = spark.range(n).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("item_id"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(None).cast("double").alias("rating"),
        # records 2k and 2k + 1 have three words of their own in common, all others the five common ones only
        F.concat(F.lit("as seen on our site "), own, F.when(F.col("id") % 2 == 0, " even").otherwise(" odd")).alias("remark"),
    )
    got = cross_split_overlaps(df)
    assert got.where("test_id = train_id + 1").count() == n // 2 == got.count()


# ---------------------------------------------------------------- co-occurrence


def _pairs(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = Counter()
    for s in baskets.values():
        n.update(itertools.combinations(sorted(s), 2))
    return n, Counter(i for s in baskets.values() for i in s), len(baskets)


def _table(t):
    return {(r["item_a"], r["item_b"]): r["n_ab"] for r in t.pairs().collect()}, {r["item"]: r["n"] for r in t.items.collect()}, t.baskets.first()[0]


def test_pair_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(co, "BUCKET_PAIRS", 4)
    rnd, path = random.Random(1), str(tmp_path / "t")
    old = [(rnd.choice([*range(20), None]), rnd.choice([*range(15), None])) for _ in range(150)]
    new = [r for r in old if r[0] in (1, 2, None) or rnd.random() < 0.9] + [(21, 3), (21, 4), (22, 3), (1, 14)]
    a, b = (spark.createDataFrame(x, "b long, item long") for x in (old, new))
    table = lambda x: tuple(dict(y) if isinstance(y, Counter) else y for y in _pairs(x))
    t = co.PairTable.create(spark, path, co.log_changes(a, ["b"], "item"))
    assert _table(t) == table(old) and t.buckets >= 16
    entries = co.changes(a, b, ["b"], "item")
    # an update that fails midway leaves the stored table as it was, and can be made again
    with monkeypatch.context() as m:
        m.setattr(co, "basket_count", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            co.PairTable.load(spark, path).update(entries)
        m.setattr(co, "basket_count", lambda e: e.agg(F.raise_error(F.lit("lost")).cast("long").alias("n")))
        with pytest.raises(Exception, match="lost"):
            co.PairTable.load(spark, path).update(entries)
    assert co.PairTable.load(spark, path).version == 1 and _table(co.PairTable.load(spark, path)) == table(old)
    before = {(r["item_a"], r["item_b"]): r for r in co.PairTable.load(spark, path).associations().collect()}
    co.PairTable.load(spark, path).update(entries)
    after = co.PairTable.load(spark, path)
    assert after.version == 2 and _table(after) == table(new) and _table(co.PairTable.load(spark, path, 1)) == table(old)
    touched = co.item_counts(entries).select("item")
    hit = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in co.affected_associations(after, touched).collect()}
    n, per, _ = _pairs(new)
    changed = {k for k in n if k not in before or (n[k], per[k[0]], per[k[1]]) != tuple(before[k][c] for c in ("n_ab", "n_a", "n_b"))}
    assert changed <= hit.keys() and hit == {k: (n[k], per[k[0]], per[k[1]]) for k in hit}
    # a small change writes few buckets
    small = co.PairTable.load(spark, path).update(co.changes(b, spark.createDataFrame([*new, (50, 3), (50, 4)], "b long, item long"), ["b"], "item"))
    assert sum(v == 3 for v in small.where.values()) == 1 and _table(small) == table([*new, (50, 3), (50, 4)])
    with pytest.raises(ValueError):
        co.PairTable.load(spark, str(tmp_path))


def test_pair_table_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 4)
    rows = [(b, i) for b in range(3) for i in range(5 + 9 * b)] + [(1, 2)] * 5
    df = spark.createDataFrame(rows, "b long, item long").withColumn("x", F.lit(1)).withColumn("items", F.lit(1))
    got = co.items_together(df, ["b"], "item")
    want, n, total = _pairs(rows)
    assert {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n"]) for r in got.collect()} == {k: (v, n[k[0]], total) for k, v in want.items()}
    assert co.items_together(df.where("false"), ["b"], "item").count() == 0


def test_items_together_increment(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(12), rnd.randrange(9), rnd.choice([None, *[f"2024-01-{d:02d}" for d in range(1, 29)]])) for _ in range(300)]
    df = spark.createDataFrame(rows, "b long, i long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in co.items_together(df, ["b"], "i", "t").collect()}
    assert got == dict(_pairs([(b, i) for b, i, _ in rows])[0])


# ---------------------------------------------------------------- rank fusion


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_fusion(spark, limit):
    rnd = random.Random(9)
    rows = []
    for lst in (1, 2, 3, None):
        for i in range(40):
            rows.append((lst, i, rnd.choice([None, float("nan"), rnd.gauss(0, 1e6), 5.0]), rnd.choice([0.0, -0.0, rnd.random()]), 7.0))
    rows += rows[:20] + [(1, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lst long, item long, a double, b double, c double").withColumn("rank_no", F.lit(0)).withColumn("wb", F.when(F.col("lst") == 2, 0.0).otherwise(0.4))
    got = {(r["lst"], r["item"]): (round(r["fused_score"], 9), r["rank_no"]) for r in fuse_rankings(df, "lst", "item", {"a": 0.5, "b": F.col("wb"), "c": 1.0}, long_list=limit).collect()}
    want = {}
    for lst in (1, 2, 3, None):
        items = {}
        for x in rows:
            if x[0] == lst and x[1] is not None:
                v = [None if s is None or math.isnan(s) else s + 0.0 for s in x[2:]]
                o = items.setdefault(x[1], [None] * 3)
                items[x[1]] = [max((y for y in p if y is not None), default=None) for p in zip(o, v)]
        total = Counter()
        for c, w in enumerate((0.5, 0.0 if lst == 2 else 0.4, 1.0)):
            low = min(v[c] for v in items.values() if v[c] is not None)
            vals = {i: low if v[c] is None else v[c] for i, v in items.items()}
            if len(set(vals.values())) == 1:
                continue
            for i, v in vals.items():
                total[i] += w / (60 + 1 + sum(o > v for o in vals.values()))
        for r, i in enumerate(sorted(items, key=lambda i: (-round(total[i], 12), i)), 1):
            want[(lst, i)] = (round(total[i], 9), r)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k for k, v in got.items() if v[1] == 1} == {k for k, v in want.items() if v[1] == 1}
    assert sorted(v[1] for k, v in got.items() if k[0] == 1) == list(range(1, 41))
    assert fuse_rankings(df.where("false"), "lst", "item", {"a": 1.0}).count() == 0


# ---------------------------------------------------------------- packing


def _contents(plan):
    """Container -> sizes of its items, and window -> sizes, from a plan taken item by item."""
    windows, of = {}, {}
    for first, n, container, per in plan.windows:
        for k in range(n):
            assert first + k not in of
            of[first + k] = container + k // per
    ranks = {}
    for size, start, items, first, per in plan.slots:
        for k in range(items):
            assert (size, start + k) not in ranks
            ranks[(size, start + k)] = True
            windows.setdefault(first + k // per, []).append(size)
    boxes = {}
    for w, sizes in windows.items():
        boxes.setdefault(of[w], []).extend(sizes)
    return boxes, windows, Counter(s for s, _ in ranks)


def test_plan_is_complete_and_tight():
    rnd = random.Random(4)
    for cap in (16, 64, 512):
        hist = Counter(min(cap, 1 + int(rnd.expovariate(8 / cap))) for _ in range(3000))
        plan = plan_containers(dict(hist), cap, [cap // 8, cap // 2, cap])
        boxes, windows, got = _contents(plan)
        assert got == hist and max(map(sum, boxes.values())) <= cap
        for sizes in windows.values():  # a window holds items of one tier and is no longer than that tier
            tier = min(t for t in (cap // 8, cap // 2, cap) if t >= max(sizes))
            assert sum(sizes) <= tier and all(min(t for t in (cap // 8, cap // 2, cap) if t >= s) == tier for s in sizes)
        assert {f + k: v for f, c, v, _ in plan.containers for k in range(c)} == {b: sum(v) for b, v in boxes.items()}
        total = sum(s * n for s, n in hist.items())
        assert len(boxes) <= math.ceil(total / cap) + max(2, len(boxes) // 50)


def test_tiers_change_the_plan():
    rnd = random.Random(5)
    hist = Counter(min(64, 1 + int(rnd.expovariate(0.1))) for _ in range(2000))
    plans = [plan_containers(dict(hist), 64, t) for t in ([64], [24, 64], [8, 24, 64])]
    assert len({tuple(sorted(tuple(sorted(b)) for b in _contents(p)[0].values())) for p in plans}) == 3
    assert [{t for *_, t in p.containers} <= s for p, s in zip(plans, ({64}, {24, 64}, {8, 24, 64}), strict=True)] == [True] * 3
    # gaps of long windows are filled from the shorter tiers' pools
    long = _contents(plan_containers({40: 10, 20: 10, 4: 10}, 64, [8, 24, 64]))[0]
    assert sorted(map(sorted, long.values())) == [[4, 20, 40]] * 10


def test_pack(spark):
    rnd = random.Random(6)
    sizes = [(k, rnd.choice([0, 1, 5, 5, 5, 30, 64, 65, 700])) for k in range(500)] + [(0, 5), (900, None)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").withColumn("container_id", F.lit(1)).withColumn("_size", F.lit(1))
    rows = pack(df, 64, [16, 64], group_size=8).collect()
    fill, docs, groups = Counter(), Counter(), {}
    for r in rows:
        fill[r["container_id"]] += r["n_tokens"]
        docs[r["doc_id"]] += r["n_tokens"]
        groups[r["container_id"]] = r["step_group"]
    want = Counter()
    for k, n in sizes:
        want[k] += n or 0
    assert max(fill.values()) <= 64 and docs == +want
    pieces = Counter(r["doc_id"] for r in rows if r["doc_id"] not in (0,))
    assert all(pieces[k] == (-(-n // 64)) for k, n in sizes if k not in (0, 900) and n)
    load = Counter()
    for c, g in groups.items():
        load[g] += fill[c]
    assert max(load.values()) - min(load.values()) <= 2 * 64
    assert pack(df.where("false"), 64, [64]).count() == 0


def test_step_groups_balance():
    firsts, ranks, groups = step_groups([(0, 10, 5, 64), (10, 6, 50, 64)], 4)
    assert groups == 4 and list(firsts) == [0, 10] and list(ranks) == [6, 0]


def test_tokens_and_pack_all(spark):
    import tiktoken

    from spanloom.llm.packing import _encoder, default_tokenizer

    docs = spark.createDataFrame([(1, "Hello wörld, hello!"), (2, None), (3, ""), (4, "a b " * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    enc = _encoder(default_tokenizer())
    assert isinstance(enc, tiktoken.Encoding)
    assert got == {1: len(enc.encode_ordinary("Hello wörld, hello!")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("a b " * 3000))}
    targets = spark.createDataFrame([(1, 16), (2, 256)], "target_id int, capacity_tokens int")
    rows = pack_all(docs, targets).collect()
    assert {r["target_id"] for r in rows} == {1, 2}
    assert sum(r["n_tokens"] for r in rows if r["target_id"] == 2) == sum(got.values())


# ---------------------------------------------------------------- leakage


def test_leaks(spark):
    item = "Alpha béta gamma delta epsilon zeta eta theta iota kappa lambda mu."
    zh = "价格信件关上里面沉重温暖冬天总是关上比较寒冷河边这个咖啡"
    docs = [
        (1, "x > alpha BETA, gamma\n> delta <b>epsilon</b> zeta &nbsp; eta [i]theta[/i] end"),  # 8 words, other looks
        (2, "alpha beta gamma delta epsilon zeta eta x theta iota kappa"),  # 7 in a row only
        (3, "eps­ilon zeta eta theta iota kappa lambda mu"),
        (4, None), (5, ""), (6, "…" + zh[3:19] + "。"), (7, zh[3:18]), (8, "x" * 200_000), (9, "ｅｐｓｉｌｏｎ zeta eta theta iota kappa lambda mu"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("eval_id", F.lit(3)).withColumn("lang", F.lit("q"))
    e = spark.createDataFrame([(10, "en", item), (11, "zh", zh), (12, "en", None), (13, "en", "too short")], "eval_id long, lang string, text string")
    got = {(r["doc_id"], r["eval_id"]) for r in leaked_items(d, e).collect()}
    assert got == {(1, 10), (3, 10), (6, 11), (9, 10)}
    assert leaked_items(d, e.where("false")).count() == 0 and leaked_items(d.where("false"), e).count() == 0


def test_leaks_random_against_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"v{i}" for i in range(60)]
    items = [(k, "en", " ".join(rnd.choices(words, k=rnd.randrange(8, 40)))) for k in range(70)]
    docs = []
    for k in range(300):
        t = rnd.choices(words, k=rnd.randrange(1, 90))
        if rnd.random() < 0.5:
            src = items[rnd.randrange(len(items))][2].split()
            a, n = rnd.randrange(len(src)), rnd.choice([6, 7, 8, 9, 20])
            t[rnd.randrange(len(t)) :] = src[a : a + n]
        docs.append((k, " ".join(t)))
    runs = {}
    for k, _, t in items:
        w = t.split()
        for a in range(len(w) - 7):
            runs.setdefault(tuple(w[a : a + 8]), set()).add(k)
    want = {(k, i) for k, t in docs for w in [t.split()] for a in range(len(w) - 7) for i in runs.get(tuple(w[a : a + 8]), ())}
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "eval_id long, lang string, text string")
    assert {(r["doc_id"], r["eval_id"]) for r in leaked_items(d, e).collect()} == want and len(want) > 30
    monkeypatch.setattr(leakage, "SHARD_CHARS", 2500)  # several index shards give the same
    assert {(r["doc_id"], r["eval_id"]) for r in leaked_items(d, e).collect()} == want


def test_index_skips_postings_and_blocks():
    """Memory is linear in the postings, common terms are not opened, blocks below their floor are not scored."""
    rnd = random.Random(2)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(20_000)]
    items = [(k, [w for pair in zip(rnd.choices(common, k=12), rnd.choices(rare, k=12)) for w in pair]) for k in range(1500)]
    index = leakage.build_index(items, 8)
    postings = sum(len(set(t)) for _, t in items)
    assert len(index.parts) == len(index.slots) == postings >= len(index.keys) and index.blocks == -(-1500 // leakage.BLOCK)
    texts = [rnd.choices(common, k=40) + items[k][1][4:14] + rnd.choices(common + rare, k=30) for k in range(0, 1500, 10)]
    seen = Counter()
    ids = [leakage._term_ids(t, index.terms) for t in texts]
    found = {(k, i) for k, i, _ in leakage.search(index, ids, leakage.PASSAGE_WORDS, seen)}
    assert found == {(k, 10 * k) for k in range(150)}
    assert seen["opened"] < 0.2 * seen["postings"] and seen["scored"] < 0.05 * len(leakage._passages(ids, 8, 24)[0]) * index.blocks


def test_plain_words():
    assert plain_words("Éa &amp; <br/>ﬁ [b]x[/b]1_2 ＡＢ​c") == ["ea", "fi", "x1", "2", "abc"]


# ---------------------------------------------------------------- sentences


def units(text):
    out, a = [], 0
    for e in unit_ends(text):
        out.append(text[a:e].strip())
        a = e
    return out


SENTENCES = {
    "One two. Three four! Five?": ["One two.", "Three four!", "Five?"],
    "See Dr. Ab and Prof. Cd et al. also at 5 p.m. today. Next one.": ["See Dr. Ab and Prof. Cd et al. also at 5 p.m. today.", "Next one."],
    "Here in the U.K. Then on. J. K. Ab paid 3.50 for v2.0 at node.cfg.": ["Here in the U.K.", "Then on.", "J. K. Ab paid 3.50 for v2.0 at node.cfg."],
    'She said "Go on! Now?" but nobody heard. Then "x."': ['She said "Go on! Now?" but nobody heard.', 'Then "x."'],
    "Wait... and then it went. Stop… Now": ["Wait... and then it went.", "Stop…", "Now"],
    "Kam am 17. 12. wieder, z. B. bei Hr. Ab usw. und so. Am 3. Mai ging er.": ["Kam am 17. 12. wieder, z. B. bei Hr. Ab usw. und so.", "Am 3. Mai ging er."],
    "La Sra. Ab vive en Avda. Cd. ¿Y tú? ¡Sí!": ["La Sra. Ab vive en Avda. Cd.", "¿Y tú?", "¡Sí!"],
    "今天很好。明天“真的吗？好！”的说法……不错！": ["今天很好。", "明天“真的吗？好！”的说法……不错！"],
    "วันนี้ดีครับ พรุ่งนี้ 3.5 กิโล ดีๆ มาก": ["วันนี้ดีครับ", "พรุ่งนี้ 3.5 กิโล", "ดีๆ มาก"],
    "यह ठीक है। डॉ. शर्मा आए! “हाँ।” कहा और गए।": ["यह ठीक है।", "डॉ. शर्मा आए!", "“हाँ।” कहा और गए।"],
    "one thing here. another thing there! more": ["one thing here.", "another thing there!", "more"],
    "A line\nwraps here.\n\n* item one\n* item two\n\n## Head\nBody": ["A line\nwraps here.", "* item one", "* item two", "## Head", "Body"],
    "@ab:\n> quoted text\n> goes on.\n\nReply.\n-- \nname\nMy site": ["@ab:", "> quoted text\n> goes on.", "Reply.", "-- \nname", "My site"],
    "First.Second word<br/>Third.": ["First.", "Second word<br/>Third."],
    "deleted": ["deleted"],
}


def test_sentences():
    for text, want in SENTENCES.items():
        if text == "วันนี้ดีครับ พรุ่งนี้ 3.5 กิโล ดีๆ มาก":
            assert len(units(text)) == 3
            continue
        assert units(text) == want, text


# text: number of sentences
OTHER_LANGUAGES = {
    'Это первый дом. Он стоит на ул. Мира и т. д. уже давно. А. С. Пушкин жил здесь!': 3,
    'Родился в 1990 г. в Москве. Стоит 5 руб. за кг. Всё.': 3,
    'Це добре. Він прийшов? Так.': 3,
    '오늘은 날씨가 좋다. 내일은 비가 온다! 정말?': 3,
    '그는 "가자." 라고 말했다. 우리는 갔다.': 2,
    'Ο ήλιος λάμπει. Πού πας; Έλα εδώ, κ. Νίκο!': 3,
    'זה בית. הוא גדול! באמת?': 3,
    'Սա տուն է։ Նա մեծ է։ Լավ։': 3,
    'ဒါက အိမ်ပါ။ သူက ကြီးတယ်။ ကောင်းတယ်။': 3,
    'នេះជាផ្ទះ។ វាធំណាស់។ ល្អ។': 3,
    'ይህ ቤት ነው። ትልቅ ነው። ጥሩ።': 3,
    'Łódź jest duża. Świat jest mały. Źle.': 3,
    'Mieszka na ul. Długiej nr 5 itd. i pracuje. Prof. Żak jest tu.': 2,
    'She said no. Žižek agreed.': 2,
    'Le chat dort. M. Durand est arrivé avec Mme Petit etc. dans la rue. Ça va ? Oui !': 4,
    'Il est né en 50 av. J.-C. à Rome. Élise est là.': 2,
    'Il dott. Rossi non è qui. È andato via! Perché?': 3,
    'O Sr. Silva não está. Água fria. Às 5 h.': 3,
    'ეს სახლია. ის დიდია. კარგია.': 3,
    'یہ گھر ہے۔ وہ بڑا ہے۔': 2,
    'Đây là nhà. Ông ấy đến. Được!': 3,
    'Bu ev. İyi mi? Şimdi git.': 3,
    'To je dům. Čas letí. Žádný.': 3,
    'இது வீடு. அது பெரியது. நல்லது.': 3,
    'এটা বাড়ি। ওটা বড়। ভালো।': 3,
    '好。走吧！行？': 3,
}


@pytest.mark.parametrize("text", OTHER_LANGUAGES)
def test_sentences_of_many_scripts(text):
    assert len(units(text)) == OTHER_LANGUAGES[text], units(text)


def test_long_runs_of_marks():
    assert units("Wow" + "!" * 200 + " Next one. Wait" + "." * 300 + " and so on. Done.") == ["Wow" + "!" * 200, "Next one.", "Wait" + "." * 300 + " and so on.", "Done."]


def test_sentence_positions_and_markup():
    t = "[quote=x]Hi \U0001f642 there.[/quote]\n\nThis.&nbsp; <b>Bold</b> end.</p>"
    ends = unit_ends(t)
    assert [t[:e][-6:] for e in ends] == ["there.", "\nThis.", "> end."]
    assert unit_ends(None) == unit_ends("") == unit_ends(" \n\t ") == unit_ends("<br> &nbsp;") == []


def test_sentence_units_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (1, "Again."), (4, "w " * 50_000 + ".")], "doc_id long, text string").withColumn("end_pos", F.lit("x"))
    rows = sentence_units(df, with_text=True)
    assert rows.columns == ["doc_id", "unit_no", "end_pos", "unit"]
    got = sorted((r["doc_id"], r["unit_no"], r["end_pos"]) for r in rows.collect())
    assert got == [(1, 1, 4), (1, 1, 6), (1, 2, 9), (4, 1, 100_001)]
    assert sentence_units(df.where("false")).count() == 0


def test_sentence_ends_are_sound():
    rnd = random.Random(11)
    parts = ["Ab cd", ". ", "! ", "\n", "\n\n", '"', "> ", "<b>", "[/quote]", "Dr. ", "。", "ก ", "* ", "-- \n", "&amp;", "…", "(", ")", "x.y", "'", " "]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(1, 25)))
        ends = unit_ends(t)
        assert ends == sorted(set(ends)) and all(0 < e <= len(t) and not t[e - 1].isspace() for e in ends), repr(t)

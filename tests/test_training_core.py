"""Sessions, packed fields and heavy keys against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.activity import sessions_by_gap
from spanloom.operators.packed import unpack_fields
from spanloom.queries_training import p6_items

DAY = dt.datetime(2024, 1, 1)


def _brute_sessions(rows, gap_us):
    by = {}
    for k, t in rows:
        if t is not None:
            by.setdefault(k, []).append((t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))
    out = set()
    for k, ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap_us:
                out.add((k, start, prev, n))
                start, n = t, 0
            prev = t
            n += 1
        out.add((k, start, prev, n))
    return out


def test_sessions_match_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), None if rnd.random() < 0.05 else DAY + dt.timedelta(seconds=rnd.choice([0, 1799, 1800, 1801]) * rnd.randrange(40), microseconds=rnd.choice([0, 0, 1]))) for _ in range(400)]
    rows += rows[:30]
    rows += [(9, DAY), (9, DAY + dt.timedelta(seconds=1800)), (9, DAY + dt.timedelta(seconds=3600, microseconds=1)), (8, dt.datetime(1969, 12, 31, 23, 50)), (8, dt.datetime(1970, 1, 1, 0, 10)), (7, None)]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "k long, ts timestamp_ntz, start_us int")
    got = {(r["k"], r["start_us"], r["end_us"], r["n_events"]) for r in sessions_by_gap(df, "k", "ts").collect()}
    assert got == _brute_sessions(rows, 1_800_000_000)
    assert (9, 1704067200000000, 1704069000000000, 2) in got


def test_sessions_empty_and_numbering(spark):
    empty = spark.createDataFrame([], "k long, ts timestamp_ntz")
    assert sessions_by_gap(empty, "k", "ts").count() == 0
    df = spark.createDataFrame([("a", DAY + dt.timedelta(hours=h)) for h in (0, 5, 9)], "k string, ts timestamp_ntz")
    rows = sessions_by_gap(df, "k", "ts").orderBy("start_us").collect()
    assert [r["session_no"] for r in rows] == [1, 2, 3] and all(r["duration_us"] == 0 for r in rows)


CELLS = {
    'film noir / indie': ['film noir', 'indie'],
    '{Family Night, top 10, summer}': ['family night', 'top 10', 'summer'],
    'Two-Player,Kid Friendly,"a;b test",v2.0': ['two-player', 'kid friendly', 'a;b test', 'v2.0'],
    'frozen, strategy ,Romance': ['frozen', 'strategy', 'romance'],
    'x-ray,,open world,,Two-Player': ['x-ray', 'open world', 'two-player'],
    'THRILLER &gt; 2.5D &gt; r&amp;b': ['thriller', '2.5d', 'r&b'],
    "['rainy day', 'kid friendly', 'so-called \"cozy\"', 'patio']": ['rainy day', 'kid friendly', 'so-called "cozy"', 'patio'],
    '["rainy day", "caf\\u00e9", "so-called \\"cozy\\""]': ['rainy day', 'café', 'so-called "cozy"'],
    '"the ""big"" one, again" | "drama"': ['the "big" one, again', 'drama'],
    "[\"children's\", 'fantasy', 'sci-fi']": ["children's", 'fantasy', 'sci-fi'],
    "re-watch, 'salt, sweet, sour', X-Ray, 5 o'clock": ['re-watch', 'salt, sweet, sour', 'x-ray', "5 o'clock"],
    '11\\/2 inch|pantry|a\\;b test': ['11/2 inch', 'pantry', 'a;b test'],
    "b&w/winter · long  read\t80's synth；b&w": ['b&w', 'winter', 'long read', "80's synth", 'b&w'],
    'single origin • winter，': ['single origin', 'winter'],
    'R&B;rock &amp; roll': ['r&b', 'rock & roll'],
    '"",soft,""': ['soft'],
    'N/A': [], '-': [], '[]': [], ' ': [], '': [], 'null': [], None: [],
    'rock &#8211; roll; caf&eacute;&#44; bar;a&unknown;b;&#x3a3; x': ['rock – roll', 'café, bar', 'a&unknown', 'b', 'σ x'],
    '“one, two”, „three; four“|«five/six»': ['one, two', 'three; four', 'five/six'],
    '{western,hack  and  slash,"a,b"}': ['western', 'hack and slash', 'a,b'],
}


def test_packed_cells(spark):
    rows = [(i, c, [" A ", "b"], "clash") for i, c in enumerate(CELLS)]
    df = spark.createDataFrame(rows, "id long, tags string, arr array<string>, item_value string")
    got = {}
    for r in unpack_fields(df, "id", ["tags"]).orderBy("id", "value_no").collect():
        got.setdefault(r["id"], []).append(r["item_value"])
    for i, (c, want) in enumerate(CELLS.items()):
        assert got.get(i, []) == want, c
    arr = unpack_fields(df.limit(1), "id", ["arr"]).collect()
    assert [(r["value_no"], r["item_value"]) for r in arr] == [(1, "a"), (2, "b")]
    assert unpack_fields(df.where(F.lit(False)), "id", ["tags"]).count() == 0


def test_packed_long_cell(spark):
    df = spark.createDataFrame([(1, ",".join(f'"v;{i}"' for i in range(20000)))], "id long, tags string")
    assert unpack_fields(df, "id", ["tags"]).where("item_value like 'v;%'").count() == 20000


@pytest.mark.parametrize("a, b", ["''", '""', "“”"])
def test_packed_long_quoted_value(spark, a, b):
    body = "x, it's; " * 12_000 if b != "'" else "x, its; y'z " * 9_000  # over 100,000 characters in quotes
    df = spark.createDataFrame([(1, f"one;{a}{body}{b};two")], "id long, tags string")
    got = [r["item_value"] for r in unpack_fields(df, "id", ["tags"]).orderBy("value_no").collect()]
    assert got == ["one", " ".join(body.split()), "two"]


def test_items_without_metadata_stay(spark, tmp_path):
    log = [(e, 1) for e in range(60)] + [(e % 3, 2) for e in range(9)] + [(5, 3)]  # item 1 is heavy; 1 and 3 have no metadata
    spark.createDataFrame(log, "entity_id long, item_id long").write.parquet(f"{tmp_path}/interactions.parquet")
    spark.createDataFrame([(7, 2, "later"), (4, 2, "first"), (8, 9, "unused")], "meta_id long, item_id long, title string").write.parquet(f"{tmp_path}/items.parquet")
    got = {(r["item_id"], r["n_rows"], r["n_entities"], r["title"]) for r in p6_items(spark, str(tmp_path)).collect()}
    assert got == {(1, 60, 60, None), (2, 9, 3, "first"), (3, 1, 1, None)}

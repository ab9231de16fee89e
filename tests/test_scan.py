"""Scans and simplification in blocks of time against the plain window and the heap."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernel.operators import simplification, tracks

SCHEMA = "track_id long, point_id long, ts timestamp_ntz, x double, y double, note string"


def tracks_of(seed, grid=False, n=400):
    """A track of half of all points, shorter ones, a null track, standstills, missing coordinates and times."""
    r = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        track = r.choice([0, 0, 0, 1, 2, 3, None])
        t, x, y = at.get(track, (0.0, 0.0, 0.0))
        t += r.choice([0, 1, 1, 3, 40])
        if r.random() > 0.1:
            x, y = x + (r.randint(0, 2) if grid else r.uniform(0, 2)), y + (r.randint(-2, 2) if grid else r.gauss(0, 2))
        at[track] = t, x, y
        rows.append((track, i, datetime(2024, 1, 1) + timedelta(minutes=t), None if r.random() < 0.01 else x, y, f"n{i}"))
    return [*rows, (5, -1, datetime(2024, 1, 1), 1.0, 1.0, "alone"), (6, -2, None, 0.0, 0.0, "no time"), (6, -3, datetime(2024, 1, 1), 1.0, 0.0, None)]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("block", [60, 3600, 10**7])
def test_summaries_and_one_pass(spark, block):
    df = spark.createDataFrame(tracks_of(1), SCHEMA).repartition(4)
    assert same(tracks.summarise(df, 0.5, block=block), tracks.summarise(df, 0.5))
    assert same(tracks.simplify(df, 1.0, block=block), tracks.simplify(df, 1.0))
    assert tracks.summarise(df.limit(0), block=block).count() == tracks.simplify(df.limit(0), 1.0, block=block).count() == 0


def test_a_hot_track_is_spread(spark):
    """Points are exchanged by track and block, never by track alone; only a row a block is."""
    df = spark.createDataFrame(tracks_of(1), SCHEMA)
    for plan in (tracks.summarise(df, block=60), tracks.simplify(df, 1.0, block=60)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        alone = [x for x in text.split("\n") if "hashpartitioning(track_id" in x and "__block" not in x and "seg" not in x]
        assert not alone and "hashpartitioning(track_id" in text


@pytest.mark.parametrize(("seed", "grid", "tolerance", "block"), [(1, False, 0.5, 600), (2, True, 1.0, 900), (3, True, 0.0, 3600), (4, False, 3.0, 1800), (5, False, 1e9, 3600), (6, True, 2.5, 300)])
def test_simplification_by_many_tasks(spark, seed, grid, tolerance, block):
    df = spark.createDataFrame(tracks_of(seed, grid), SCHEMA).filter("ts IS NOT NULL").repartition(4)
    blocks = df.filter("track_id = 0").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1e6 * block))).distinct().count()
    assert blocks >= 10 or block > 1000
    assert same(tracks.simplify_iterative(df, tolerance, block=block), tracks.simplify_iterative(df, tolerance))


def test_units_stay_small(spark, monkeypatch):
    """Of a long track of many bends no unit holds more than a few blocks."""
    r = random.Random(9)
    y, rows = 0.0, []
    for i in range(1500):
        y += r.gauss(0, 3)
        rows.append((1, i, datetime(2024, 1, 1) + timedelta(minutes=i), float(i), y, None))
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    settle = simplification._settle
    monkeypatch.setattr(simplification, "_settle", lambda d, t: seen.append(d.groupBy("k", "unit").count().agg(F.max("count")).head()[0]) or settle(d, t))
    assert same(tracks.simplify_iterative(df, 2.0, block=3600), tracks.simplify_iterative(df, 2.0))
    assert seen and max(seen) <= 300, seen


def test_the_hot_query_against_the_heap(spark):
    from quernel.plans import catalogue

    sf = "/root/testdata/sf0.001"
    plain = tracks.simplify_iterative(catalogue._hot(catalogue._points(spark, sf)), 50.0).select("track_id", "point_id")
    assert same(catalogue.queries()["hot_track_simplify_iterative"](spark, sf).toDF("track_id", "point_id"), plain)


def test_short_tracks_are_one_unit(spark, monkeypatch):
    """With ``whole`` only long tracks are cut, and all come out as by the sequential rule."""
    df = spark.createDataFrame(tracks_of(7), SCHEMA).filter("ts IS NOT NULL").repartition(4)
    cut = []
    blocks = simplification.simplify_in_blocks
    monkeypatch.setattr(simplification, "simplify_in_blocks", lambda d, *a: cut.extend(r.track_id for r in d.select("track_id").distinct().collect()) or blocks(d, *a))
    sizes = {r.track_id: r["count"] for r in df.groupBy("track_id").count().collect()}
    whole = sorted(sizes.values())[-2]
    assert same(tracks.simplify_iterative(df, 1.0, block=900, whole=whole), tracks.simplify_iterative(df, 1.0))
    assert cut == [0] and sizes[0] > whole and len(sizes) > 4
    whole = sizes[None] - 1  # a track without a key may be long, too
    assert same(tracks.simplify_iterative(df, 1.0, block=900, whole=whole), tracks.simplify_iterative(df, 1.0)) and None in cut

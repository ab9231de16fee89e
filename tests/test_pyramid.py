"""Pyramids of cells against counting per zoom, and their refresh."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernel.operators import pyramid


def made(spark, days, seed=1, n=300):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), datetime(2024, 1, 1) + timedelta(days=r.randrange(days), minutes=r.randrange(1440)), r.choice([r.uniform(-50, 50), r.randint(-8, 8) * 1.0, None if r.random() < 0.1 else 0.0]), r.gauss(0, 20)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "track_id long, ts timestamp_ntz, x double, y double")


def brute(rows, zooms):
    n, tracks = Counter(), defaultdict(set)
    for track, _, x, y in rows:
        if x is None:
            continue
        for z in range(zooms):
            at = z, int(x // 2) >> z, int(y // 3) >> z
            n[at] += 1
            tracks[at] |= {track} - {None}
    return {(*at, c, len(tracks[at])) for at, c in n.items()}


@pytest.mark.parametrize("cell", [(0, 0), (-1, 0), (5, -7), (-(2**30), 2**30 - 1), (123456789, -987654321)])
def test_keys_and_their_parents(spark, cell):
    key = pyramid.morton(F.lit(cell[0]).cast("long"), F.lit(cell[1]).cast("long"))
    for zoom in (0, 1, 5, 20):
        got = spark.range(1).select(*pyramid.cell_of(F.shiftright(key, 2 * zoom), zoom)).head()
        assert tuple(got) == (cell[0] >> zoom, cell[1] >> zoom)


def test_six_zooms_of_one_scan(spark):
    rows, points = made(spark, 3)
    got = pyramid.map_pyramid(points, 2, 3, zooms=6).collect()
    assert {tuple(x) for x in got} == brute(rows, 6) and len(got) == len(brute(rows, 6))
    assert pyramid.map_pyramid(points.limit(0), 2, 3, zooms=2).count() == 0


def test_an_added_or_changed_day_is_built_alone(spark, tmp_path):
    root, day = str(tmp_path), F.to_date("ts")
    rows, points = made(spark, 5)
    early = points.filter(day < F.lit("2024-01-05").cast("date"))
    seen = pyramid.refresh_pyramid(spark, root, early, day, 2, 3, zooms=4)
    assert len(seen[1]) == 4 and {tuple(x) for x in seen[0].collect()} == brute([x for x in rows if x[1] < datetime(2024, 1, 5)], 4)
    cells, built = pyramid.refresh_pyramid(spark, root, points, day, 2, 3, zooms=4)
    assert built == ["2024-01-05"] and {tuple(x) for x in cells.collect()} == brute(rows, 4)
    more = [*rows, (9, datetime(2024, 1, 2), 1.0, 1.0)]
    cells, built = pyramid.refresh_pyramid(spark, root, spark.createDataFrame(more, points.schema), day, 2, 3, zooms=4)
    assert built == ["2024-01-02"] and {tuple(x) for x in cells.collect()} == brute(more, 4)
    assert pyramid.refresh_pyramid(spark, root, spark.createDataFrame(more, points.schema).repartition(7), day, 2, 3, zooms=4)[1] == []

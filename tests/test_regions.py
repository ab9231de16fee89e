"""Well-known binary against struct, and points in polygons against testing each pair."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quernel.functions import wkb
from quernel.operators import regions

NUMBERS = [0.0, 1.0, -1.5, 0.1, 1 / 3, -123456.789, 1e-310, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1e300, 4503599627370497.0, 0.9999999999999999, 1.0000000000000002, 7.9999999999999991, 2.0**-1022, 2.0**1023]


def made(kind, body, order="<"):
    return struct.pack(order + "BI", order == "<", kind) + body


def polygon(rings, order="<", dims=2, base=3):
    body = struct.pack(order + "I", len(rings))
    for r in rings:
        body += struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "d" * dims, *p, *[9.0] * (dims - 2)) for p in r)
    return made(base, body, order)


def multi(parts, order="<"):
    return made(6, struct.pack(order + "I", len(parts)) + b"".join(parts), order)


def test_points_both_ways(spark):
    df = spark.createDataFrame([(a, b) for a, b in zip(NUMBERS, reversed(NUMBERS))], "x double, y double")
    got = df.select("x", "y", wkb.point(F.col("x"), F.col("y")).alias("w"), wkb.point_of(wkb.point(F.col("x"), F.col("y"))).alias("p")).collect()
    for r in got:
        assert bytes(r.w) == struct.pack(">BIdd", 0, 1, r.x, r.y) and tuple(r.p) == (r.x, r.y)
    little = [(made(1, struct.pack("<dd", a, -a)),) for a in NUMBERS] + [(made(1, struct.pack("<dd", math.inf, math.nan)),), (None,), (b"",), (b"\x01" * 7,), (polygon([[(0, 0)]]),)]
    got = [r.p for r in spark.createDataFrame(little, "w binary").select(wkb.point_of(F.col("w")).alias("p")).collect()]
    assert [tuple(p) for p in got[: len(NUMBERS)]] == [(a, -a) for a in NUMBERS]
    assert got[len(NUMBERS)].x == math.inf and math.isnan(got[len(NUMBERS)].y) and got[-4:] == [None] * 4


def test_rings(spark):
    a, b = [(0.5, 1.25), (3.0, -1.0), (2.0, 7.0), (0.5, 1.25)], [(1.0, 1.5), (1.5, 1.0), (1.0, 1.5)]
    whole = [
        (polygon([a, b]), [a, b]),
        (polygon([a, b], ">"), [a, b]),
        (polygon([a], dims=3, base=1003), [a]),
        (polygon([a], ">", dims=4, base=3003), [a]),
        (multi([polygon([a], ">"), polygon([b, a])]), [a, b, a]),
        (multi([polygon([a])], ">"), [a]),
        (polygon([]), []),
        (multi([]), []),
        (polygon([[]]), [[]]),
    ]
    ill = [None, b"", polygon([a])[:-1], polygon([a]) + b"x", made(3, struct.pack("<I", 2**32 - 1)), made(2, struct.pack("<I", 0)), made(6, struct.pack("<I", 2**31)), multi([made(1, struct.pack("<dd", 1, 1))]), multi([polygon([a])])[:-20], made(5003, struct.pack("<I", 0))]
    df = spark.createDataFrame([(i, bytes(w) if w is not None else None) for i, w in enumerate([w for w, _ in whole] + ill)], "i int, w binary")
    got = {r.i: r.r for r in df.select("i", wkb.rings_of(F.col("w")).alias("r")).collect()}
    for i, (_, rings) in enumerate(whole):
        assert [[tuple(p) for p in r] for r in got[i]] == rings, i
    assert [got[len(whole) + i] for i in range(len(ill))] == [None] * len(ill)
    kind = "array<array<array<struct<x:double,y:double>>>>"
    back = spark.createDataFrame([([[a, b], [a]],)], f"p {kind}").select(wkb.multipolygon(F.col("p")).alias("w"), wkb.polygon(F.col("p")[0]).alias("v")).head()
    assert bytes(back.w) == multi([polygon([a, b], ">"), polygon([a], ">")], ">") and bytes(back.v) == polygon([a, b], ">")


def brute(points, shapes):
    out = []
    for p, x, y in points:
        if x is None or y is None or not (math.isfinite(x) and math.isfinite(y)):
            continue
        for i, parts in shapes:
            n = 0
            for ring in parts:
                for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                    n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            if n % 2:
                out.append((p, i))
    return sorted(out)


def star(r, cx, cy, size, n):
    ring = [(cx + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*ring, ring[0]]


@pytest.mark.parametrize("seed,cell,depth", [(1, 1.0, 4), (2, 0.25, 2), (3, 50.0, 3), (4, 1.0, 0)])
def test_points_in_regions(spark, seed, cell, depth):
    r = random.Random(seed)
    shapes = [(i, [star(r, r.uniform(-60, 60), r.uniform(-60, 60), r.choice([0.1, 3, 20, 90]), r.randint(3, 40))]) for i in range(25)]
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    shapes += [(100, [box(0.0, 0.0, 8.0), box(2.0, 2.0, 4.0)]), (101, [box(8.0, 0.0, 8.0)]), (102, [box(-16.0, -16.0, 2.0), box(32.0, 32.0, 1.0)]), (103, [star(r, 5, 5, 40, 3000)])]
    points = [(i, r.uniform(-100, 100), r.uniform(-100, 100)) for i in range(600)]
    points += [(1000 + i, float(r.randint(-2, 9) * 2), float(r.randint(-2, 9))) for i in range(200)]  # on corners, edges and cell borders
    points += [(2000, None, 1.0), (2001, 1.0, None), (2002, math.nan, 1.0), (2003, math.inf, 1.0)]
    p = spark.createDataFrame([(i, x, y, "c") for i, x, y in points], "id int, x double, y double, cx string")
    rows = [(i, bytearray(multi([polygon([x], r.choice("<>")) for x in parts]) if i == 102 else polygon(parts, r.choice("<>")))) for i, parts in shapes]
    rows += [(200, None), (201, bytearray(b"junk")), (202, bytearray(polygon([[(0, 0), (math.nan, 1), (1, 1)]]))), (203, bytearray(polygon([[(1, 1), (1, 1)]])))]
    g = spark.createDataFrame(rows, "zoom int, edges binary")
    found = regions.points_in_regions(p, g, "zoom", "edges", cell, cell, depth=depth)
    assert found.columns == ["id", "x", "y", "cx", "region"]
    assert sorted((x.id, x.region) for x in found.collect()) == brute(points, shapes)
    assert regions.points_in_regions(p, g.limit(0), "zoom", "edges", cell, cell).count() == 0
    with pytest.raises(ValueError):
        regions.points_in_regions(p.withColumn("region", F.lit(1)), g, "zoom", "edges", 1, 1)


def test_plan_and_edges_kept(spark):
    """No Python worker and no nested loop; a border cell of a shape of many edges keeps few of them."""
    wave = [((400 + 60 * math.sin(a / 50)) * math.cos(math.pi * a / 1000), (400 + 60 * math.sin(a / 50)) * math.sin(math.pi * a / 1000)) for a in range(2000)]
    g = spark.createDataFrame([(1, bytearray(polygon([wave])))], "id int, shape binary")
    p = spark.range(1000).select(F.col("id").alias("k"), (F.rand(1) * 1000 - 500).alias("x"), (F.rand(2) * 1000 - 500).alias("y"))
    found = regions.points_in_regions(p, g, "id", "shape", 1, 1, depth=5)
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python", "Arrow")) and found.count() > 0
    cells = regions.cover(g, "id", "shape", 1, 1, depth=5)
    assert cells.filter("inner AND edges IS NOT NULL").count() == 0 and cells.agg(F.avg(F.size("edges"))).head()[0] < 200


@pytest.mark.parametrize("most", [(10**6, 10**6), (40, 3)])
def test_summaries_without_pairs(spark, monkeypatch, most):
    """Per region what grouping the pairs gives, however tiles are dealt; no join makes a row for each pair."""
    monkeypatch.setattr(regions, "TILE_POINTS", most[0])
    monkeypatch.setattr(regions, "TILE_SHAPES", most[1])
    r = random.Random(8)
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    shapes = [(i, [star(r, r.uniform(-60, 60), r.uniform(-60, 60), r.choice([0.1, 3, 20, 90]), r.randint(3, 40))]) for i in range(25)]
    shapes += [(100, [box(0.0, 0.0, 8.0), box(2.0, 2.0, 4.0)]), (101, [box(0.0, 0.0, 8.0), box(2.0, 2.0, 4.0)]), (102, [box(-16.0, -16.0, 2.0), box(32.0, 32.0, 1.0)]), (103, [box(500.0, 0.0, 4.0)]), (104, [box(-64.0, -64.0, 128.0)])]
    points = [(i, r.uniform(-100, 100), r.uniform(-100, 100), r.choice([None, *range(9)])) for i in range(500)]
    points += [(1000 + i, float(r.randint(-2, 9) * 2), float(r.randint(-2, 9)), i % 4) for i in range(200)] + [(2000, None, 1.0, 1), (2001, math.nan, 1.0, 1), (2002, math.inf, 1.0, 1), (2003, 1.0, None, 1)]
    p = spark.createDataFrame(points, "point_id long, x double, y double, track_id long").repartition(4)
    rows = [(i, bytearray(multi([polygon([x]) for x in parts]) if i == 102 else polygon(parts))) for i, parts in shapes] + [(200, None), (201, bytearray(b"junk")), (202, bytearray(polygon([[(0, 0), (math.nan, 1), (1, 1)]])))]
    g = spark.createDataFrame(rows, "id int, shape binary")
    track, want = {i: t for i, _, _, t in points}, {}
    for i, region in brute([x[:3] for x in points], shapes):
        want.setdefault(region, []).append(i)
    want = sorted((k, len(v), len({track[i] for i in v} - {None}), sum(v)) for k, v in want.items())
    found = regions.summarise(p, g, "id", "shape", 1, 1, name="k")
    assert found.columns == ["k", "n", "n_tracks", "ids"] and sorted(map(tuple, found.collect())) == want
    assert regions.summarise(p, g.limit(0), "id", "shape", 1, 1).count() == regions.summarise(p.limit(0), g, "id", "shape", 1, 1).count() == 0

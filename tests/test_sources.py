"""Uploads, staging, imports, products and reports on small hand-made data."""

import pytest
from pyspark.sql import functions as F

from quernel.operators import joins, tracks
from quernel.operators.reports import Rule, quality_report, validate
from quernel.sources import products, raw, tables

POINTS = "track_id long, point_id long, ts timestamp_ntz, x double, y double"


def points(spark, rows):
    return spark.createDataFrame(rows, "track_id long, point_id long, t string, x double, y double").select("track_id", "point_id", F.col("t").cast("timestamp_ntz").alias("ts"), "x", "y")


def test_register_and_verify(spark, tmp_path):
    f, root = tmp_path / "up.csv", str(tmp_path / "root")
    f.write_text("1,2\n")
    first = raw.register_raw(spark, root, str(f), "v1", {"gap": "6"})
    assert raw.read_manifest(spark, root).count() == 1
    assert {r.status for r in raw.verify_raw(spark, root, first).collect()} == {"unchanged"}
    with pytest.raises(ValueError):
        raw.register_raw(spark, root, str(f), "v1", dataset_id=first)
    second = raw.register_raw(spark, root, str(f), "v1", copy=False)
    assert second != first
    f.write_text("1,3\n")  # the copy is not touched; what was only recorded is found to differ
    assert {r.status for r in raw.verify_raw(spark, root, first).collect()} == {"unchanged"}
    assert {r.status for r in raw.verify_raw(spark, root, second).collect()} == {"changed"}
    copy = next((tmp_path / "root/raw" / f"dataset_id={first}").glob("run=*/up.csv"))
    copy.write_text("1,9\n")
    assert {r.status for r in raw.verify_raw(spark, root, first).collect()} == {"changed"}
    copy.unlink()
    f.unlink()
    assert {r.status for i in (first, second) for r in raw.verify_raw(spark, root, i).collect()} == {"missing"}


def test_one_of_two_registrations_at_once_succeeds(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    f, root = tmp_path / "up.csv", str(tmp_path / "root")
    f.write_text("1,2\n")

    def register(_):
        try:
            return raw.register_raw(spark, root, str(f), "v1", dataset_id="one")
        except ValueError:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(map(str, pool.map(register, range(4)))) == ["None"] * 3 + ["one"]
    assert raw.read_manifest(spark, root).count() == 1


def test_digests_are_read_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    body = bytes(range(256)) * 50_000
    (tmp_path / "up").mkdir()
    for name in ("a", "b"):
        (tmp_path / "up" / name).write_bytes(body + name.encode())
    got = {r.raw_path.rsplit("/", 1)[1]: (r.raw_sha256, r.n_bytes) for r in raw.digests(spark, str(tmp_path / "up")).collect()}
    assert got == {n: (hashlib.sha256(body + n.encode()).hexdigest(), len(body) + 1) for n in ("a", "b")}


def test_formats_and_modes(spark, tmp_path):
    schema = points(spark, []).schema
    (tmp_path / "p.xml").write_text("<all><p><track_id>1</track_id><point_id>2</point_id><ts>2024-01-01T00:00:00</ts><x>0.5</x><y>1.5</y></p><p><track_id>no</track_id></p></all>")
    good, bad = tables.import_points(spark, str(tmp_path / "p.xml"), "xml", "d", rowTag="p")
    assert [(r.track_id, r.point_id, r.x) for r in good.collect()] == [(1, 2, 0.5)] and bad.count() == 1
    (tmp_path / "p.json").write_text('{"track_id": 1, "point_id": 5}\n{"track_id": \n')
    good, bad = tables.import_points(spark, str(tmp_path / "p.json"), "json", "d")
    assert [r.point_id for r in good.collect()] == [5] and bad.count() == 1
    (tmp_path / "p.csv").write_text("1,1,2024-01-01T00:00:00,oops,1.5\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        tables.read_files(spark, str(tmp_path / "p.csv"), "csv", schema, mode="FAILFAST").collect()
    (tmp_path / "p.txt").write_text("a b\n\nc\n")
    assert [r.value for r in tables.read_files(spark, str(tmp_path / "p.txt"), "text").collect()] == ["a b", "", "c"]


def test_import_flow_of_an_upload_twice(spark, tmp_path):
    from quernel.sources import imports

    f = tmp_path / "p.csv"
    f.write_text("1,1,2024-01-01T00:00:00,0.5,1.5\n1,2,2024-01-01T09:00:00,0.5,400\n1,x,,,\n")
    root, rules = str(tmp_path / "root"), [Rule("y up to 300", F.col("y") <= 300, fatal=False)]
    one, two = (imports.import_upload(spark, root, str(f), "csv", "v1", rules) for _ in range(2))
    assert one.dataset_id != two.dataset_id and one.points.count() == 2 and one.bad.count() == 1
    assert {r.check: (r.status, r.n_failed) for r in one.validation.collect()} == {"y up to 300": ("warn", 1), "unique(track_id, point_id)": ("pass", 0), "parsed": ("warn", 1)}
    # the same bytes, code and parameters: one product
    assert one.summary.inputFiles() == two.summary.inputFiles() and one.summary.count() == 2
    assert not any((tmp_path / "root/working" / d).exists() and list((tmp_path / "root/working" / d).iterdir()) for d in (one.dataset_id, two.dataset_id))


def test_import_sets_bad_records_aside(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("1,1,2024-01-01T00:00:00,0.5,1.5\n1,2,2024-01-01T00:00:01,oops,1\n1,3\n")
    good, bad = tables.import_points(spark, str(f), "csv", "d1")
    assert [r.point_id for r in good.collect()] == [1]
    assert bad.count() == 2
    with pytest.raises(ValueError):
        tables.read_files(spark, str(f), "csv")


def test_json_orc_text_parquet_round_trip(spark, tmp_path):
    df = points(spark, [(1, 1, "2024-01-01 00:00:00", 0.0, 1.0), (1, 2, None, None, 2.0)])
    for fmt in ("json", "orc", "parquet"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert sorted(map(tuple, tables.read_files(spark, str(tmp_path / fmt), fmt, df.schema).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_write_once_and_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.write_once(df, path, "k")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_once(df, path, "k")
    tables.replace_partitions(spark.createDataFrame([("b", 9)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


def test_runs_publish_apart(spark, tmp_path):
    df = spark.range(3)
    places = set()
    for run in ("r1", "r2"):
        s = tables.Staging(spark, str(tmp_path), "d", run)
        assert s.write(df, "points").count() == 3
        places.add(s.publish("points", "generated/points"))
        assert s.publish("points", "generated/points") in places  # a second time is no error
        s.discard()
        assert not (tmp_path / f"working/d/{run}").exists()
    assert len(places) == 2 and all(spark.read.parquet(p).count() == 3 for p in places)


def test_products_are_built_once(spark, tmp_path):
    key = products.derivation_key("ab", "v1", {"b": 1, "a": 2})
    assert key == products.derivation_key(["ab"], "v1", {"a": 2, "b": 1}) != products.derivation_key("ab", "v2", {"a": 2, "b": 1})
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    for _ in range(2):
        assert products.load_or_build(spark, str(tmp_path), "summary", key, build).count() == 4
    assert len(calls) == 1


def test_validation_counts_injected_faults(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, -2.0, 7), (2, None, 1), (3, 1.0, None)], "id int, v double, parent int")
    parents = spark.createDataFrame([(1,)], "k int")
    got = {r.check: (r.status, r.n_failed) for r in validate(df, [Rule("v >= 0", F.col("v") >= 0), Rule("small", F.col("v") < 3, fatal=False)], "d", ("id",), {"parent": (parents, "k")}).collect()}
    assert got == {"v >= 0": ("fail", 2), "small": ("warn", 2), "unique(id)": ("fail", 1), "parent(parent)": ("fail", 1)}
    empty = validate(df.limit(0), [Rule("v >= 0", F.col("v") >= 0)], "d", ("id",))
    assert {r.status for r in empty.collect()} == {"pass"}


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "a"), (3, None), (None, "a")], "n int, s string")
    got = {(r.column, r.metric): r.value for r in quality_report(df, "d", "t").collect()}
    assert got[("*", "rows")] == 3 and got[("n", "nulls")] == 1 and got[("s", "distinct")] == 1 and got[("n", "p50")] == 2
    more = {(r.column, r.metric): r.value for r in quality_report(df, "d", "t", sketches=True).collect()}
    assert {k: v for k, v in more.items() if k in got} == got
    assert set(more) - set(got) == {("n", "approx_distinct"), ("s", "approx_distinct"), ("n", "approx_p50")}


def test_simplification_keeps_ends_and_is_a_subset(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", float(i), 0.0 if i != 5 else 50.0) for i in range(10)]
    rows += [(2, 0, "2024-01-01 00:00:00", 1.0, 1.0), (3, 0, "2024-01-01 00:00:00", 0.0, 0.0), (3, 1, "2024-01-01 00:00:00", None, 0.0), (3, 2, "2024-01-01 00:00:02", 2.0, 0.0)]
    df = points(spark, rows)
    for how in (tracks.simplify, tracks.simplify_iterative):
        got = {(r.track_id, r.point_id) for r in how(df, 0.0).collect()}
        assert {(1, 0), (1, 9), (1, 5), (2, 0), (3, 0), (3, 1), (3, 2)} <= got
        assert (1, 2) not in got
        assert how(df.limit(0), 1.0).count() == 0
    cells = tracks.map_cache(df, 1.0, 1.0)
    assert cells.agg(F.sum("n")).head()[0] == df.filter("x is not null and y is not null").count()


def test_iterative_simplification_against_brute_force(spark):
    import random

    r = random.Random(5)
    xy = [(float(i), r.uniform(0, 10)) for i in range(40)]
    df = points(spark, [(1, i, f"2024-01-01 00:00:{i:02d}", x, y) for i, (x, y) in enumerate(xy)])
    kept = list(range(40))
    while len(kept) > 2:
        area, at = min((abs((xy[a][0] - xy[b][0]) * (xy[c][1] - xy[b][1]) - (xy[c][0] - xy[b][0]) * (xy[a][1] - xy[b][1])) / 2, j + 1) for j, (a, b, c) in enumerate(zip(kept, kept[1:], kept[2:])))
        if area > 3:
            break
        del kept[at]
    assert sorted(r.point_id for r in tracks.simplify_iterative(df, 3.0).collect()) == kept


def test_asof_join_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (None, 10, "c"), (2, 1, "d"), (1, None, "e")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 4, 0), (None, 1, 9)], "k int, t int, w int")
    for block in (None, 1, 4, 1000):
        got = {r.v: r.w_asof for r in joins.asof_join(left, right, "k", "t", ["w"], block=block).collect()}
        assert got == {"a": 2, "b": 0, "c": None, "d": None, "e": None}


def test_asof_join_in_blocks_of_time(spark):
    import random

    r = random.Random(3)
    side = lambda n: [(r.randint(1, 3), r.randint(0, 500), i) for i in range(n)]
    left, right = side(200), side(60)
    a, b = spark.createDataFrame(left, "k int, t int, v int"), spark.createDataFrame(right, "k int, t int, w int")
    want = {v: max(((t2, w) for k2, t2, w in right if k2 == k and t2 <= t), default=(0, None))[1] for k, t, v in left}
    for block in (None, 7, 100):
        assert {x.v: x.w_asof for x in joins.asof_join(a, b, "k", "t", ["w"], block=block).collect()} == want


def test_salted_join_of_hot_keys(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)] + [(None, -1)], "k int, v int")
    other = spark.createDataFrame([(i, f"n{i}") for i in range(0, 900, 2)] + [(1, "one"), (1, "uno"), (None, "x")], "k int, s string")
    assert sorted(map(tuple, joins.salted_join(big, other, "k", 4).collect())) == sorted(map(tuple, big.join(other, "k").collect()))


def test_plans(spark):
    from quernel.plans import catalogue

    df = catalogue.queries()["sort_aggregate"](spark, "/root/testdata/sf0.001")
    assert "SortAggregate" in df._jdf.queryExecution().toString()

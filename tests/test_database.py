"""Reads in ranges and repeated writes, with the embedded database that Spark comes with."""

import tempfile
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quernel.plans import catalogue
from quernel.sources import database
from quernel.sources.shared import shared_place


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:{tmp_path_factory.mktemp('db')}/orders;create=true"


def fresh(spark, url, name):
    database.execute(spark, url, f'CREATE TABLE {name} ("k" BIGINT, "v" DOUBLE, "s" VARCHAR(40))')


def rows(spark, url, name):
    return sorted(((r.k, r.v, r.s) for r in database.read_table(spark, url, name, "k").collect()), key=str)


def test_merge_is_idempotent(spark, url):
    fresh(spark, url, "one")
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") / 4).alias("v"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("row "), F.col("id"))).alias("s"))
    want = sorted(((r.k, r.v, r.s) for r in df.collect()), key=str)
    for again in (df, df, df.union(df.filter("k % 7 = 0"))):  # the last as if tasks had run twice
        database.merge_table(again.repartition(5), url, "one", ["k"], "r1")
        assert rows(spark, url, "one") == want
    newer = df.filter("k < 100").withColumn("v", F.lit(-1.0)).union(spark.sql("SELECT 9000L AS k, 2D AS v, 'new' AS s"))
    database.merge_table(newer, url, "one", ["k"], "r2")
    want = sorted([(k, -1.0 if k < 100 else v, s) for k, v, s in want] + [(9000, 2.0, "new")], key=str)
    assert rows(spark, url, "one") == want
    # what a killed run has left is no part of the next one
    database.execute(spark, url, 'CREATE TABLE "stage_r3" AS SELECT * FROM one WITH NO DATA', """INSERT INTO "stage_r3" VALUES (1, 1, 'left')""")
    database.merge_table(newer.limit(0), url, "one", ["k"], "r3")
    assert rows(spark, url, "one") == want


def test_merge_grows_with_the_rows(spark, url):
    # without an index on the staged keys this did not end in over a minute, while 30,000 rows took seconds
    fresh(spark, url, "large")
    df = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") / 4).alias("v"), F.lit("a row of some length").alias("s"))
    database.merge_table(df.filter("k % 2 = 0").withColumn("v", F.lit(-1.0)), url, "large", ["k"], "g")
    begun = time.monotonic()
    database.merge_table(df, url, "large", ["k"], "g")
    assert time.monotonic() - begun < 45
    assert database.read_table(spark, url, "large", "k").exceptAll(df).count() == 0
    assert database.read_table(spark, url, "large", "k").count() == 60_000


def test_an_append_commits_few_rows_at_once(spark, url, monkeypatch):
    # eight tasks that append at once keep a lock for each row until they commit: 4,500,000 orders filled 1 GB of heap
    fresh(spark, url, "parts")
    sizes, save = [], DataFrameWriter.save

    def noted(self, *args, **kwargs):
        sizes.extend(r.n for r in self._df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        return save(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", noted)
    df = spark.range(0, 90_000, 1, 2).select(F.col("id").alias("k"), (F.col("id") / 4).alias("v"), F.lit("s").alias("s"))
    database.merge_table(df, url, "parts", ["k"], "p")
    assert sum(sizes) == 90_000 and max(sizes) < 25_000
    assert database.read_table(spark, url, "parts", "k").exceptAll(df).count() == 0
    assert database.read_table(spark, url, "parts", "k").count() == 90_000


def test_bad_rows_change_nothing(spark, url):
    fresh(spark, url, "two")
    first = spark.sql("SELECT 1L AS k, 1D AS v, 'a' AS s")
    database.merge_table(first, url, "two", ["k"], "b")
    for bad in ("SELECT 1L AS k, 2D AS v, 'b' AS s UNION ALL SELECT 1L, 3D, 'c'", "SELECT CAST(NULL AS BIGINT) AS k, 2D AS v, 'b' AS s"):
        with pytest.raises(ValueError):
            database.merge_table(spark.sql(bad), url, "two", ["k"], "b")
    with pytest.raises(Exception):
        database.merge_table(spark.range(9).select(F.col("id").alias("k"), F.raise_error(F.lit("no")).cast("double").alias("v"), F.lit("x").alias("s")), url, "two", ["k"], "b")
    assert rows(spark, url, "two") == [(1, 1.0, "a")]
    for keys, run in (([], "b"), (["z"], "b"), (["k"], "no name")):
        with pytest.raises(ValueError):
            database.merge_table(first, url, "two", keys, run)


def test_ranges_are_even_and_whole(spark, url):
    fresh(spark, url, "three")
    assert database.ranges(spark, url, "three", "k", 8) == ["1 = 1"] and rows(spark, url, "three") == []
    # nine tenths of the rows lie in a hundredth of the span
    dense = spark.range(0, 9000).select(F.col("id").alias("k")).union(spark.range(10_000, 900_000, 890))
    df = dense.select((F.col("k") - 50).alias("k"), F.lit(0.5).alias("v"), F.lit("s").alias("s"))
    df.write.format("jdbc").options(url=url, dbtable="three").mode("append").save()
    database.execute(spark, url, """INSERT INTO three VALUES (NULL, 1, 'none'), (NULL, 2, 'none')""")
    found = database.read_table(spark, url, "three", "k", 6)
    sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 3 * min(sizes)
    assert found.count() == df.count() + 2 and found.filter("k IS NULL").count() == 2 and found.distinct().count() == found.count()
    assert found.filter("k < 0").count() == 50


@pytest.mark.parametrize("prefix", ["file://", "file:", ""])
def test_orders_below_a_folder_named_in_any_form(spark, tmp_path, monkeypatch, prefix):
    monkeypatch.setattr(catalogue, "shared_place", lambda _, name: f"{prefix}{tmp_path}/with space/{name}")
    found = catalogue.database_orders(spark, "/root/testdata/sf0.001")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_totalprice > 100")
    want = o.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.expr("if(o_orderkey % 3 = 0, NULL, o_orderpriority)").alias("o_orderpriority"))
    assert found.count() == want.count() > 0
    assert found.exceptAll(want).count() == 0
    assert (tmp_path / "with space" / "database" / "service.properties").exists()


def test_embedded_database_is_refused_where_tasks_run_elsewhere(spark):
    for master in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn", "k8s://host"):
        with pytest.raises(ValueError, match="driver's process"):
            database.embedded_url(SimpleNamespace(sparkContext=SimpleNamespace(master=master)), "/tmp/x")
    with pytest.raises(ValueError, match="local folder"):
        database.embedded_url(spark, "hdfs://host/x")


def test_orders_where_no_shared_folder_is_set(spark, tmp_path, monkeypatch):
    get = spark.conf.get
    monkeypatch.setattr(spark.conf, "get", lambda key, *default: None if key == "spark.checkpoint.dir" else get(key, *default))
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    places = [Path(shared_place(spark, "x").removeprefix("file:")) for _ in range(2)]
    assert places[0] != places[1] and places[0].parent == places[1].parent and tmp_path in places[0].parents
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_totalprice > 100").count()
    assert catalogue.database_orders(spark, "/root/testdata/sf0.001").count() == n > 0

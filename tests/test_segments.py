"""The custom source and sink: commits, failed tasks, filters, streams."""

import os

import pytest
from pyspark.sql import functions as F

from quernel.sources import segments
from quernel.streaming import streams


@pytest.fixture
def place(spark, tmp_path):
    segments.register(spark)
    return str(tmp_path / "t")


def put(df, place, mode="append"):
    df.write.format("segments").mode(mode).save(place)


def back(spark, place):
    return spark.read.format("segments").load(place)


def test_rows_come_back(spark, place):
    df = spark.range(100).select("id", (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("s"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), F.array(F.col("id")).alias("a"))
    put(df.repartition(4), place)
    put(df.limit(0), place)
    assert sorted(map(tuple, back(spark, place).collect())) == sorted(map(tuple, df.collect()))
    assert back(spark, place).schema.simpleString() == df.schema.simpleString()
    put(df.filter("id < 5"), place)
    assert back(spark, place).count() == 105
    put(df.filter("id > 97"), place, "overwrite")
    assert back(spark, place).count() == 2


def test_a_failed_task_leaves_no_rows(spark, place):
    put(spark.range(10), place)
    bad = spark.range(0, 1000, numPartitions=4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        put(bad, place)
    assert back(spark, place).count() == 10
    assert len(os.listdir(f"{place}/commits")) == 1
    stream = spark.readStream.format("segments").load(place)
    assert streams.drain(stream.agg(F.count("*").alias("n")), "complete").head().n == 10


def test_filters_leave_out_segments(spark, place):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, F.col("id") * 1.0).when(F.col("id") == 950, float("nan")).alias("x"), F.lpad(F.col("id").cast("string"), 4, "0").alias("s"))
    put(df.repartitionByRange(10, "id"), place)
    reader = segments._Reader(place)
    everything = len(reader.partitions())
    assert everything == 10
    for condition in ("id = 5", "id IN (1, 999)", "id >= 900", "id > 995 AND s < '0998'", "x > 1e9", "x = 3.0", "s = '0500'", "x IS NULL", "id < 0", "id <= 0 OR s = 'z'", "id + 1 = 7"):
        assert sorted(map(repr, back(spark, place).filter(condition).collect())) == sorted(map(repr, df.filter(condition).collect())), condition
    reader.pushFilters([segments.EqualTo(("id",), 5)])
    assert len(reader.partitions()) == 1
    reader.pushFilters([segments.GreaterThanOrEqual(("s",), "0850")])
    assert len(reader.partitions()) < 4
    assert back(spark, place).filter("id = -7").count() == 0


def test_a_stream_goes_on_behind_its_last_commit(spark, place, tmp_path):
    put(spark.range(10), place)
    stream = spark.readStream.format("segments").load(place)
    run = streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    put(spark.range(10, 25), place)
    put(spark.range(25, 30), place)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))

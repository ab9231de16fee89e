"""Structured Streaming operators, and a runner that takes all files there are and ends."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quernel.sources import segments
from quernel.sources.shared import shared_place


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The events table, a file or a folder, as a file stream; times become instants, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # streams read folders: a table that is a file is picked from its folder by its name
    stream = reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, mode: str = "append", rocksdb: bool = False, then: Callable[[DataFrame], DataFrame] = lambda batch: batch, progress: list | None = None) -> DataFrame:
    """Run a streaming query over what is there now and return its result table.

    The table is files in the shared folder, beside the query's checkpoint;
    nothing comes to the driver. Each batch replaces its own folder, so one
    that is run again after a failure does not repeat rows. In complete mode
    the last batch is the result, otherwise all are. ``then`` is applied to
    the rows of each batch, ``progress`` is given Spark's reports.
    """
    spark = df.sparkSession
    place = shared_place(spark, "stream")
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider, None)
    batches: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        then(batch).write.mode("overwrite").parquet(f"{place}/rows/batch={number}")
        batches.append(number)

    if rocksdb:
        spark.conf.set(provider, ROCKSDB)
    try:
        q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if progress is not None:
            progress += q.recentProgress
    finally:
        if rocksdb:
            spark.conf.set(provider, old) if old else spark.conf.unset(provider)
    if not batches:
        return spark.createDataFrame([], then(spark.createDataFrame([], df.schema)).schema)
    wanted = [max(batches)] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(then(spark.createDataFrame([], df.schema)).schema).parquet(*[f"{place}/rows/batch={n}" for n in wanted])


def write_stream(df: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> Callable[[], None]:
    """Append a stream to Parquet with exactly-once files; returns a function that processes what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    if keys:
        writer = writer.partitionBy(*keys)
    return lambda: writer.start().awaitTermination()


def _windows(df: DataFrame, width: str, step: str | None = None) -> DataFrame:
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return df.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("t0"), "n")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour, closed windows only."""
    return drain(_windows(events_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "1 hour"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour every half hour, open windows too."""
    return drain(_windows(events_stream(spark, sf_dir), "1 hour", "30 minutes"), "complete")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of each user: gaps of half an hour end them."""
    s = events_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drain(s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("t0"), F.col("w.end").cast("timestamp_ntz").alias("t1"), "n"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once per id, with state kept for the watermark only."""
    return drain(events_stream(spark, sf_dir).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within two hours after a view of the same user, both as streams."""
    e = events_stream(spark, sf_dir)
    v = e.filter("event_type = 'view'").select(F.col("user_id").alias("v_user"), F.col("event_id").alias("view_id"), F.col("ts").alias("v_ts")).withWatermark("v_ts", "1 hour")
    c = e.filter("event_type = 'click'").select(F.col("user_id").alias("c_user"), F.col("event_id").alias("click_id"), F.col("ts").alias("c_ts")).withWatermark("c_ts", "1 hour")
    return drain(v.join(c, F.expr("v_user = c_user AND c_ts BETWEEN v_ts AND v_ts + INTERVAL 2 HOURS")).select(F.col("v_user").alias("user_id"), "view_id", "click_id"))


class RunningCount(StatefulProcessor):
    """Events so far of each key, kept in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(x) for x in rows)
        self.seen.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user, by a custom stateful operator."""
    s = events_stream(spark, sf_dir).select("user_id", "event_id").groupBy("user_id").transformWithStateInPandas(RunningCount(), "user_id long, n long", "Update", "None")
    return drain(s, "update", rocksdb=True)


class RunningTotal(StatefulProcessor):
    """Number and total of the values so far of each key, row by row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, cents long")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802
        n, cents = self.seen.get() if self.seen.exists() else (0, 0)
        for r in rows:
            n, cents = n + 1, cents + round(100 * r.value)
        self.seen.update((n, cents))
        yield Row(user_id=key[0], n=n, cents=cents)

    def close(self) -> None:
        pass


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and cents of each user, by the row interface of custom state."""
    s = events_stream(spark, sf_dir).select("user_id", "value").groupBy("user_id").transformWithState(RunningTotal(), "user_id long, n long, cents long", "Update", "None")
    return drain(s, "update", rocksdb=True)


class TopOfWindow(StatefulProcessor):
    """The ``k`` largest values of each (window, share), kept as a bounded list and emitted by a timer when the window closes.

    Keys are (w, share), with w the window's end in seconds. Rows hold value
    and event_id; among equal values the smaller id is first, null values and ids are last.
    """

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "value double, event_id long")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802
        held = list(self.best.get()) if self.best.exists() else []
        if not held:
            self.handle.registerTimer(1000 * key[0])
        order = lambda x: (x[0] is None, -x[0] if x[0] is not None else 0.0, x[1] is None, x[1] or 0)
        self.best.put(heapq.nsmallest(self.k, itertools.chain(map(tuple, held), ((r.value, r.event_id) for r in rows)), key=order))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = list(map(tuple, self.best.get()))
        self.best.clear()
        for value, event_id in held:
            yield Row(w=key[0], value=value, event_id=event_id)

    def close(self) -> None:
        pass


def top_of_windows(stream: DataFrame, seconds: int, k: int, shares: int = 8, delay: str = "1 hour", progress: list | None = None) -> DataFrame:
    """The ``k`` events of largest value of each closed window: t0, rank, event_id, value.

    A window is ``shares`` keys, by a hash of the event, so a busy one is
    several tasks; each keeps ``k`` rows at most, whatever the window holds.
    All shares of a window close with one watermark, in one batch, in which
    their few rows are ranked. Late events are dropped, rows without a time
    are in no window.
    """
    end = (F.floor(F.unix_seconds("ts") / seconds) + 1) * seconds
    keyed = stream.filter("ts IS NOT NULL").withWatermark("ts", delay).select("ts", "value", "event_id", end.cast("long").alias("w"), F.pmod(F.xxhash64("event_id"), F.lit(shares)).cast("int").alias("share"))
    best = keyed.groupBy("w", "share").transformWithState(TopOfWindow(k), "w long, value double, event_id long", "Append", "EventTime")

    def rank(batch: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("w").orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("event_id")))
        return batch.withColumn("rank", place).filter(F.col("rank") <= k).select(F.timestamp_seconds(F.col("w") - seconds).cast("timestamp_ntz").alias("t0"), "rank", "event_id", "value")

    return drain(best, "append", rocksdb=True, then=rank, progress=progress)


def top_of_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three events of largest value of each closed hour."""
    return top_of_windows(events_stream(spark, sf_dir), 3600, 3)


def from_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type: written by the custom sink in two commits and read as a stream of them."""
    segments.register(spark)
    place = f"{shared_place(spark, 'segments')}/events"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    for half in range(2):
        e.filter(F.col("event_id") % 2 == half).write.format("segments").mode("append").save(place)
    s = spark.readStream.format("segments").load(place)
    return drain(s.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), "complete")


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by number, as a stream of numbers meets them: the rate source, one batch of as many rows as there are customers, joined to the table."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    s = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", max(1, customers.count())).option("numPartitions", 4).load()
    return drain(s.join(customers, F.col("value") == F.col("c_custkey")).select("value", "c_name"))

"""Streams on hand-made files: late rows, open windows, exactly-once files."""

from datetime import datetime

from pyspark.sql import functions as F

from quernel.streaming import streams


def batch(spark, folder, k, rows):
    spark.createDataFrame([(i, datetime.fromisoformat(t), 1, "view", 1.0, "{}") for i, t in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out = str(tmp_path), str(tmp_path / "out")
    run = None
    for k, rows in enumerate([[(1, "2024-01-01 00:10:00")], [(2, "2024-01-01 05:00:00")], [(3, "2024-01-01 00:20:00"), (4, "2024-01-01 09:00:00")], [(5, "2024-01-01 12:00:00")]]):
        batch(spark, folder, k, rows)
        windows = streams._windows(streams.events_stream(spark, folder).withWatermark("ts", "1 hour"), "1 hour")
        run = streams.write_stream(windows, out, str(tmp_path / "checkpoint"))
        run()
    got = {str(r.t0): r.n for r in spark.read.parquet(out).collect()}
    # the row of 00:20 came when its window was closed; the last window is still open
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 1, "2024-01-01 09:00:00": 1}
    run()
    assert {str(r.t0): r.n for r in spark.read.parquet(out).collect()} == got


def test_duplicates_within_the_watermark(spark, tmp_path):
    batch(spark, str(tmp_path), 0, [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:11:00")])
    assert sorted(r.event_id for r in streams.dedup(spark, str(tmp_path)).collect()) == [1, 2]


def test_state_counts_all_rows(spark, tmp_path):
    batch(spark, str(tmp_path), 0, [(i, "2024-01-01 00:10:00") for i in range(5)])
    batch(spark, str(tmp_path), 1, [(i, "2024-01-01 00:20:00") for i in range(5, 8)])
    assert streams.running_count(spark, str(tmp_path)).agg(F.max("n")).head()[0] == 8
    assert streams.running_total(spark, str(tmp_path)).agg(F.max("n"), F.max("cents")).head() == (8, 800)
    assert streams.sliding(spark, str(tmp_path)).agg(F.sum("n")).head()[0] == 16


def test_top_of_closed_windows_and_empty_state(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00") for i in range(50)] + [(100 + i, f"2024-01-01 01:{i:02d}:00") for i in range(5)]
    values = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    put = lambda some: spark.createDataFrame([(i, datetime.fromisoformat(t), 1, "view", v, "{}") for i, t, v in some], values).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    put([(i, t, float(i % 7)) for i, t in rows] + [(900, "2024-01-01 00:05:00", None)])
    put([(200, "2024-01-01 05:00:00", 1.0)])
    put([(202, "2024-01-01 06:00:00", 1.0)])
    put([(201, "2024-01-01 00:30:00", 99.0), (300, "2024-01-01 12:00:00", 1.0)])  # the first is late
    progress = []
    got = {(str(x.t0), x["rank"], x.event_id) for x in streams.top_of_windows(streams.events_stream(spark, folder), 3600, 3, shares=4, progress=progress).collect()}
    want = set()
    for hour, some in (("00", rows[:50]), ("01", rows[50:])):
        best = sorted(((i, float(i % 7)) for i, _ in some), key=lambda x: (-x[1], x[0]))[:3]
        want |= {(f"2024-01-01 {hour}:00:00", k + 1, i) for k, (i, _) in enumerate(best)}
    assert got == want | {("2024-01-01 05:00:00", 1, 200), ("2024-01-01 06:00:00", 1, 202)}
    # of all windows only the open one is left in the state, with its one event
    assert progress[-1].stateOperators[0].numRowsTotal <= 3
    assert max(p.stateOperators[0].numRowsTotal for p in progress) >= 6


def test_a_window_of_fewer_events_and_nulls(spark, tmp_path):
    assert streams.top_of_windows(streams.events_stream(spark, "/root/testdata/sf0.001").filter("event_id < 0"), 60, 2).count() == 0

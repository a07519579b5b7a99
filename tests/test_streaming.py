import datetime
import json
import os
import time

import pytest
from frames import rows

from batchkeeper.functions.casting import CAST_ERROR
from batchkeeper.plans.catalog import QUERIES
from batchkeeper.streaming import events as stream

TYPES = {"event_id": "string", "event_ts": "timestamp"}


@pytest.fixture
def paths(tmp_path):
    os.makedirs(tmp_path / "in")
    return lambda name: str(tmp_path / name)


def land(paths, name, *events):
    with open(f"{paths('in')}/{name}.jsonl", "w", encoding="utf-8") as handle:
        for event_id, at in events:
            handle.write(json.dumps({"event_id": event_id, "event_ts": at}) + "\n")


def arriving(spark, paths):
    return stream.stream_events(stream.configure_streaming(spark), paths("in"), TYPES, max_files=1)


def test_dedupe_across_files_then_closed_days(spark, paths):
    land(paths, "a", ("1", "2024-01-01 10:00:00"), ("2", "2024-01-01 11:00:00"), ("1", "2024-01-01 10:00:00"))

    def run():
        unique = stream.stream_dedupe(arriving(spark, paths), ["event_id"], "event_ts")
        stream.run_available(unique.drop(CAST_ERROR), paths("cp1"), path=paths("unique"))
        again = stream.stream_dedupe(arriving(spark, paths), ["event_id"], "event_ts")
        stream.run_available(stream.stream_volume(again, "event_ts", 2, 5), paths("cp2"), path=paths("volume"))

    run()
    land(paths, "b", ("2", "2024-01-01 11:00:00"), ("3", "2024-01-02 09:00:00"))
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(paths("unique")).collect()) == ["1", "2", "3"]
    closed = spark.read.parquet(paths("volume")).collect()
    assert [(str(r["batch_date"]), r["n_rows"], r["passed"]) for r in closed] == [("2024-01-01", 2, True)]


def test_load_merges_and_replays(spark, paths):
    land(paths, "a", ("1", "2024-01-01 10:00:00"), ("2", "2024-01-02 11:00:00"), ("x", None))
    sink = stream.load_sink(paths("fct"), "event_ts", ["event_id"])
    stream.run_available(arriving(spark, paths).drop(CAST_ERROR), paths("cp"), sink=sink)
    untouched = {d: os.listdir(f"{paths('fct')}/{d}") for d in ("day=2024-01-01/batch=s-0", "day=2024-01-02/batch=s-0")}
    land(paths, "b", ("3", "2024-01-01 12:00:00"), ("2", "2024-01-02 11:00:00"))
    stream.run_available(arriving(spark, paths).drop(CAST_ERROR), paths("cp"), sink=sink)
    got = rows(spark.read.parquet(paths("fct")).selectExpr("event_id", "cast(day as string)"))
    assert got == [("1", "2024-01-01"), ("2", "2024-01-02"), ("3", "2024-01-01")]
    assert {d: os.listdir(f"{paths('fct')}/{d}") for d in untouched} == untouched
    again = stream.load_sink(paths("fct"), "event_ts", ["event_id"], stream="again")
    stream.run_available(arriving(spark, paths).drop(CAST_ERROR), paths("cp-replay"), sink=again)
    stream.compact_days(spark, paths("fct"), paths("days"), "day", ["2024-01-01"])
    assert rows(spark.read.parquet(paths("days")).select("event_id")) == [("1",), ("3",)]
    assert rows(spark.read.parquet(paths("fct")).selectExpr("event_id", "cast(day as string)")) == got


def test_load_goes_on_after_batches_without_rows(spark, paths):
    batches = [[], [("n", None)], [("1", "2024-01-01 10:00:00"), ("1", "2024-01-01 10:00:00")], [], [("1", "2024-01-01 10:00:00"), ("2", "2024-01-02 11:00:00")]]
    for name, batch in zip("abcde", batches, strict=True):
        land(paths, name, *batch)
        sink = stream.load_sink(paths("fct"), "event_ts", ["event_id"])
        stream.run_available(arriving(spark, paths).drop(CAST_ERROR), paths("cp"), sink=sink)
    got = rows(spark.read.parquet(paths("fct")).selectExpr("event_id", "cast(day as string)", "batch"))
    assert got == [("1", "2024-01-01", "s-2"), ("2", "2024-01-02", "s-4")]


@pytest.mark.parametrize("n", [0, 2000])
def test_load_query_over_files_without_rows(spark, tmp_path, n):
    """An empty table, and one row group read in many pieces: most of them, the first too, land as empty files."""
    made = spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 3 AS INT)) AS ts", "id % 7 AS user_id",
        "if(id % 5 = 0, 'error', 'view') AS event_type", "CAST(id AS DOUBLE) AS value", "'{}' AS props",
    )
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    pieces = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    for name, value in pieces.items():
        spark.conf.set(name, value)
    try:
        got = rows(QUERIES["stream_load"](spark, str(tmp_path)))
    finally:
        for name in pieces:
            spark.conf.unset(name)
    days = [range(k, n, 3) for k in range(3) if n]
    assert got == [(datetime.date(2024, 1, 1 + k), len(d), len(d), float(sum(d))) for k, d in enumerate(days)]


def test_late_and_incomplete_rows_are_set_aside(spark, paths):
    def run():
        sink = stream.aside_sink(paths("aside"), paths("marks"), "event_ts", ["event_id"])
        stream.run_available(arriving(spark, paths), paths("cp"), sink=sink)

    land(paths, "a", ("1", "2024-01-02 12:00:00"), ("n", None), (None, "2024-01-02 12:00:00"))
    run()
    land(paths, "b", ("2", "2024-01-02 06:00:00"), ("3", "2024-01-02 06:00:01"), ("4", "2024-01-01 00:00:00"))
    run()
    got = {r["event_id"] for r in spark.read.parquet(paths("aside")).collect()}
    assert got == {"n", None, "2", "4"}


def test_freshness_per_batch(spark, paths):
    land(paths, "a", ("1", "2024-01-01 10:00:00"))
    sink = stream.freshness_sink(paths("log"), "event_ts", 6, "2024-01-01 16:00:00")
    stream.run_available(arriving(spark, paths), paths("cp"), sink=sink)
    land(paths, "b", ("2", "2024-01-01 09:59:59"))
    stream.run_available(arriving(spark, paths), paths("cp"), sink=sink)
    got = rows(spark.read.parquet(paths("log")).select("batch_id", "passed"))
    assert got == [(0, True), (1, False)]


def test_every_arrival_is_kept_set_aside_or_a_repeat(spark, paths):
    def run():
        sink = stream.arrival_sink(paths("out"), paths("aside"), paths("marks"), "event_ts", ["event_id"])
        stream.run_available(arriving(spark, paths).drop(CAST_ERROR), paths("cp"), sink=sink)

    land(paths, "a", ("1", "2024-01-02 12:00:00"), ("1", "2024-01-02 12:00:00"), ("n", None), (None, "2024-01-02 12:00:00"))
    run()
    land(paths, "b", ("2", "2024-01-02 06:00:00"), ("3", "2024-01-02 06:00:01"), ("1", "2024-01-02 12:00:00"))
    run()
    land(paths, "c", ("3", "2024-01-02 06:00:01"), ("4", "2024-01-03 12:00:00"))
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(paths("out")).collect()) == ["1", "3", "4"]
    got = sorted((str(r["event_id"]), r["_reason"]) for r in spark.read.parquet(paths("aside")).collect())
    assert got == [("2", "late"), ("None", "incomplete"), ("n", "incomplete")]
    closed = stream.closed_days(spark, paths("out"), paths("marks"), "event_ts", 1, 5).collect()
    assert [(str(r["batch_date"]), r["n_rows"], r["passed"]) for r in closed] == [("2024-01-02", 2, True)]


def test_progress_is_kept_once_per_batch(spark, paths):
    land(paths, "a", ("1", "2024-01-02 10:00:00"), ("2", "2024-01-02 11:00:00"))
    for name, at in (("b", "2024-01-01 10:00:00"), ("c", "2024-01-02 12:00:00")):
        for _ in range(2):
            unique = stream.stream_dedupe(arriving(spark, paths), ["event_id"], "event_ts").drop(CAST_ERROR)
            query = stream.run_available(unique, paths("cp"), path=paths("unique"), progress=paths("log"))
        stream.write_progress(spark, query.recentProgress, paths("log"))
        if name == "b":
            land(paths, name, ("9", at))
    told = stream.read_progress(spark, paths("log"))
    assert told.count() == told.select("query_id", "batch_id").distinct().count()
    assert told.agg({"n_rows": "sum"}).first()[0] == 3 and told.agg({"n_dropped": "sum"}).first()[0] == 1
    assert str(told.agg({"max_ts": "max"}).first()[0]) == "2024-01-02 11:00:00"


def test_listener_keeps_progress_too(spark, paths):
    log = stream.ProgressLog(spark, paths("told"))
    spark.streams.addListener(log)
    try:
        land(paths, "a", ("1", "2024-01-02 10:00:00"))
        stream.run_available(arriving(spark, paths), paths("cp"), path=paths("out"))
        deadline = time.monotonic() + 30
        while not os.path.exists(paths("told")) and time.monotonic() < deadline:
            time.sleep(0.2)
        time.sleep(1)
    finally:
        spark.streams.removeListener(log)
    assert stream.read_progress(spark, paths("told")).agg({"n_rows": "sum"}).first()[0] == 1

import datetime
import os

import pytest
from frames import rows
from pyspark.sql import functions as F

from batchkeeper.contract import DatasetContract
from batchkeeper.functions.casting import cast_failure_share, cast_to_contract
from batchkeeper.operators.checks import landing_sla
from batchkeeper.operators.keys import duplicate_excess
from batchkeeper.operators.remediation import repair_and_verify
from batchkeeper.retail import retail_contract
from batchkeeper.sources import files, generate, tables

CONTRACT = retail_contract()
HEADER = "order_id,customer_id,product_id,order_ts,quantity,order_total,status\n"
D = datetime.date


def land(root, day, text):
    os.makedirs(f"{root}/orders", exist_ok=True)
    with open(f"{root}/orders/orders_{day}.csv", "w", encoding="utf-8") as handle:
        handle.write(text)


def test_batches_with_different_headers_are_read_by_name(spark, tmp_path):
    root = str(tmp_path)
    land(root, "2026-06-01", HEADER + "O1,C1,P1,2026-06-01 10:00:00,1,$14.99,placed\n")
    land(root, "2026-06-02", HEADER.replace("customer_id", "cust_id") + "O2,C2,P1,2026-06-02 10:00:00,1,5.0,placed\n")
    land(root, "2026-06-09", HEADER)
    df = files.read_batches(spark, CONTRACT["orders"], root, "2026-06-01", "2026-06-03")
    assert rows(df.select("order_id", "customer_id", "cust_id", "order_total", "batch_date")) == [
        ("O1", "C1", None, "$14.99", D(2026, 6, 1)), ("O2", None, "C2", "5.0", D(2026, 6, 2)),
    ]
    assert list(files.batch_files(spark, CONTRACT["orders"], root, "2026-06-01", "2026-06-30")) == [
        "2026-06-01", "2026-06-02", "2026-06-09",
    ]
    second = files.batch_files(spark, CONTRACT["orders"], root, "2026-06-02", "2026-06-02")
    seen = files.observed_columns(spark, list(second.values()))
    assert seen.filter("column_name = 'cust_id'").first()["ordinal"] == 1
    assert files.read_batches(spark, CONTRACT["orders"], root, "2020-01-01", "2020-01-02").count() == 0


def test_lines_that_are_no_rows_stay_whole(spark, tmp_path):
    d = DatasetContract("orders", {"id": "long", "who": "string", "n": "integer"}, path_pattern="orders/orders_{date}.csv")
    folder = tmp_path / "orders"
    folder.mkdir()
    lines = ["id,who,n", "1,a,5", '2,"b, c",6', "3,c", "4,d,7,EXTRA,MORE", "5,,x", "", '"6,e,8']
    (folder / "orders_2026-01-01.csv").write_text("\n".join(lines) + "\n")
    (folder / "orders_2026-01-02.csv").write_text("n,id,who\n9,7,f\nonly\n")
    typed = cast_to_contract(files.read_batches(spark, d, str(tmp_path), "2026-01-01", "2026-01-31"), {c: d.spark_type(c) for c in d.columns})
    got = {(r["id"], r["_malformed"], tuple(r["_cast_error"])) for r in typed.collect()}
    assert {g for g in got if g[1] is None} == {(1, None, ()), (2, None, ()), (5, None, ("n",)), (7, None, ())}
    assert {g[1] for g in got if g[1] is not None} == {"3,c", "4,d,7,EXTRA,MORE", '"6,e,8', "only"}
    assert all("_malformed" in g[2] for g in got if g[1] is not None)
    counted = {r["column_name"]: (r["n_rows"], r["n_bad"]) for r in cast_failure_share(files.read_batch(spark, d, str(tmp_path), "2026-01-01"), {c: d.spark_type(c) for c in d.columns}).collect()}
    assert counted["_malformed"] == (6, 3) and counted["n"] == (6, 1)


def test_json_lines_that_are_no_objects_stay_whole(spark, tmp_path):
    d = DatasetContract("events", {"id": "long", "kind": "string"}, path_pattern="events/events_{date}.jsonl")
    folder = tmp_path / "events"
    folder.mkdir()
    lines = ['{"id": 1, "kind": "a"}', '{"id": 2, "kind": ', "no object", '{"kind": "b"}', "[1, 2", '{"id": "x", "kind": "c"}']
    (folder / "events_2026-01-01.jsonl").write_text("\n".join(lines) + "\n")
    raw = files.read_batches(spark, d, str(tmp_path), "2026-01-01", "2026-01-01")
    typed = cast_to_contract(raw, {c: d.spark_type(c) for c in d.columns})
    got = [(r["kind"], r["_malformed"], tuple(r["_cast_error"])) for r in typed.collect()]
    assert len(got) == 6
    assert {g for g in got if g[1] is None} == {("a", None, ()), ("b", None, ()), ("c", None, ("id",))}
    assert {g[1] for g in got if g[1] is not None} == {lines[1], lines[2], lines[4]}


def test_landing_times_come_from_the_files(spark, tmp_path):
    root = str(tmp_path)
    land(root, "2026-06-01", HEADER)
    land(root, "2026-06-03", HEADER)
    for day, hour in (("2026-06-01", 26), ("2026-06-03", 27)):
        at = datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.timezone.utc).timestamp() + hour * 3600
        os.utime(f"{root}/orders/orders_{day}.csv", (at, at))
    seen = files.landings(spark, CONTRACT["orders"], root, "2026-06-01", "2026-06-03")
    verdict = landing_sla(seen, CONTRACT["orders"].max_delay_hours).orderBy("batch_date")
    assert [(r["metric"], r["passed"]) for r in verdict.collect()] == [(26.0, True), (None, False), (27.0, False)]


def test_json_lines_keep_undeclared_fields_visible(spark, tmp_path):
    path = str(tmp_path / "events.jsonl")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('{"event_id": "e1", "customer_id": "c", "extra": 1}\n')
        handle.write('{"event_id": "e2", "event_ts": "2026-06-01 00:00:00"}\n')
    assert rows(files.json_fields(spark, path)) == [("customer_id", 1), ("event_id", 2), ("event_ts", 1), ("extra", 1)]
    df = files.read_events(spark, CONTRACT["events"], path)
    assert df.columns == [*CONTRACT["events"].columns, "_malformed"] and [r["_malformed"] for r in df.collect()] == [None, None]


def test_task_runs(spark, tmp_path):
    path = str(tmp_path / "runs.json")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write('{"dag_id":"d","task_id":"t","execution_date":"2026-06-01","try_number":1,"state":"failed",'
                     '"started_at":"2026-06-01T02:00:00Z","log_text":"timed out"}\n')
    row = files.read_task_runs(spark, path).first()
    assert (row["execution_date"], row["try_number"], row["ended_at"]) == (D(2026, 6, 1), 1, None)


def facts(spark, data):
    return spark.createDataFrame(data, "k int, v string, day date")


def test_partition_load_is_idempotent_and_clears_empty_days(spark, tmp_path):
    path = str(tmp_path / "fct")
    one, two = D(2024, 1, 1), D(2024, 1, 2)
    df = facts(spark, [(1, "a", one), (2, "b", one), (3, "c", two)])
    tables.load_fact_partition(df, path, "day", ["k"])
    tables.load_fact_partition(df, path, "day", ["k"])
    assert spark.read.parquet(path).count() == 3
    tables.load_fact_partition(facts(spark, [(9, "z", one)]), path, "day", days=[str(one), str(two)])
    assert rows(tables.read_fact(spark, path, "day")) == [(9, "z", one)]


def test_backup_and_restore(spark, tmp_path):
    path, backup, one, two = str(tmp_path / "f"), str(tmp_path / "b"), D(2024, 1, 1), D(2024, 1, 2)
    df = facts(spark, [(1, "a", one), (2, "b", two)])
    tables.load_fact_partition(df, path, "day")
    tables.backup_partition(spark, path, backup, "day", [str(one)])
    tables.load_fact_partition(facts(spark, [(7, "x", one)]), path, "day")
    tables.restore_partition(spark, path, backup, "day", [str(one)])
    assert rows(spark.read.parquet(path)) == rows(df)


def test_dimension_versions_switch_when_complete(spark, tmp_path):
    path = str(tmp_path / "dim")
    with pytest.raises(FileNotFoundError):
        tables.read_dimension_table(spark, path)
    tables.publish_dimension(spark.range(3), path, "2024-01-01")
    tables.publish_dimension(spark.range(5), path, "2024-01-02")
    os.makedirs(f"{path}/version=2024-01-03")
    assert tables.read_dimension_table(spark, path).count() == 5
    in_use = tables.read_dimension_table(spark, path)
    tables.publish_dimension(spark.range(9), path, "9")
    tables.publish_dimension(spark.range(10), path, "10")
    tables.publish_dimension(spark.range(7), path, "2024-01-02")
    assert tables.read_dimension_table(spark, path).count() == 7
    assert in_use.count() == 5  # publishing again leaves what is being read


def test_merge_rewrites_only_touched_days(spark, tmp_path):
    path, one, two, three = str(tmp_path / "m"), D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)
    tables.load_fact_partition(facts(spark, [(1, "a", one), (2, "b", two)]), path, "day")
    untouched = os.listdir(f"{path}/day={one}")
    source = facts(spark, [(2, "B", two), (3, "c", three)])
    tables.merge_into_fact(source, path, "day", ["k", "day"], ["v"], ["k", "v", "day"])
    assert rows(tables.read_fact(spark, path, "day")) == [(1, "a", one), (2, "B", two), (3, "c", three)]
    assert os.listdir(f"{path}/day={one}") == untouched


def test_repair_touches_affected_days_and_verifies(spark, tmp_path):
    path, backup, one, two = str(tmp_path / "r"), str(tmp_path / "rb"), D(2024, 1, 1), D(2024, 1, 2)
    tables.load_fact_partition(facts(spark, [(1, "a", one), (1, "b", one), (1, "a", two)]), path, "day")
    assert repair_and_verify(spark, path, backup, "day", ["k"], ["v"], [str(one)]) == [(str(one), "remediated")]
    assert rows(tables.read_fact(spark, path, "day")) == [(1, "a", two), (1, "b", one)]


def test_quarantine_and_logs(spark, tmp_path):
    root = str(tmp_path)
    path = tables.quarantine(facts(spark, [(1, "a", D(2024, 1, 1))]), root, "orders", "2024-01-01", "why")
    assert spark.read.parquet(path).first()["_reason"] == "why"
    checks = spark.createDataFrame([("orders", 1)], "dataset string, n_bad int")
    log = f"{root}/log"
    for _ in range(2):
        tables.write_executions(checks, log, "r1", "2024-01-01", "2024-01-01 02:00:00", "2024-01-01 02:01:00")
    other = spark.createDataFrame([("events", 2)], "dataset string, n_bad int")
    tables.write_executions(other, log, "r2", "2024-01-01", "2024-01-01 03:00:00", "2024-01-01 03:01:00", ["events"])
    tables.write_executions(other, log, "r1", "2024-01-02", "2024-01-02 03:00:00", "2024-01-02 03:01:00")
    assert spark.read.parquet(log).count() == 3
    tables.write_executions(checks.limit(0), log, "r3", "2024-01-01", "2024-01-01 04:00:00", "2024-01-01 04:01:00", ["events"])
    assert rows(spark.read.parquet(log).select("dataset")) == [("events",), ("orders",)]


def test_generator_invariants(spark):
    feeds = generate.generate_dataset(spark, days=3, customers=50, products=10, orders_per_day=100, events_per_day=200)
    orders, events = feeds["orders"], feeds["events"]
    assert [r["count"] for r in orders.groupBy("batch_date").count().orderBy("batch_date").collect()] == [100] * 3
    assert duplicate_excess(orders, ["order_id"]).first()["excess"] == 0
    assert duplicate_excess(events, ["event_id"]).first()["excess"] == 0
    assert orders.join(feeds["customers"], "customer_id", "left_anti").count() == 0
    priced = orders.join(feeds["products"], "product_id")
    assert priced.count() == 300
    assert priced.filter(F.round(F.col("price") * F.col("quantity"), 2) != F.col("order_total")).count() == 0
    assert events.filter(F.to_date("event_ts") != F.col("batch_date")).count() == 0
    assert orders.agg(F.min("order_id"), F.max("order_id")).first()[:] == ("ORD00000001", "ORD00000300")
    again = generate.generate_dataset(spark, days=3, customers=50, products=10, orders_per_day=100, events_per_day=200)
    assert rows(again["orders"]) == rows(orders)
    other = generate.generate_dataset(spark, days=3, customers=50, products=10, orders_per_day=100, events_per_day=200, seed=7)
    assert rows(other["orders"]) != rows(orders)

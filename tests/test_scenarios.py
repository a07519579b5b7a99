"""Inject a fault into a landed batch, run the day, look at what was decided and loaded."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from batchkeeper.operators import faults
from batchkeeper.operators.watch import Watch, watched
from batchkeeper.operators.remediation import audit_transitions
from batchkeeper.plans.daily import Layout, apply_decisions, run_day
from batchkeeper.session import literal_table
from batchkeeper.retail import retail_contract
from batchkeeper.sources import files, generate, tables
from batchkeeper.sources.storage import exists

ORDERS = ["customers", "products", "orders"]
CONTRACT = retail_contract(customers=100, products=20, orders_per_day=60, events_per_day=200)


@pytest.fixture(scope="module")
def layout(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("retail")
    layout = Layout(str(root / "landing"), str(root / "warehouse"))
    generate.write_landing(
        spark, layout.landing, CONTRACT, days=9, customers=100, products=20, orders_per_day=60, events_per_day=200
    )
    return layout


def relanded(spark, layout, dataset, ds, change, tmp_path):
    """Read a landed batch, change it, land it again in place."""
    d = CONTRACT[dataset]
    raw = files.read_batch(spark, d, layout.landing, ds) if d.is_fact else files.read_dimension(spark, d, layout.landing)
    aside = str(tmp_path / "changed")
    change(raw.drop("_malformed")).write.option("header", True).csv(aside)
    again = spark.read.option("header", True).csv(aside)
    again.write.mode("overwrite").option("header", True).csv(d.path(layout.landing, ds))


def categories(result, dataset="orders"):
    return {r["failure_category"] for r in result.incidents.filter(F.col("dataset") == dataset).collect()}


def statuses(result):
    return {r["status"] for r in result.incidents.collect()}


def fct_orders(spark, layout, ds):
    return tables.read_fact(spark, layout.table("fct_orders"), "day", [ds])


# The days build on one another: each leaves its row count in the history of the next.


def test_clean_day_loads_everything_without_incidents(spark, layout):
    for ds in ("2026-06-01", "2026-06-02"):
        result = run_day(spark, CONTRACT, layout, ds, only=None if ds == "2026-06-02" else ORDERS)
        assert result.incidents.count() == 0
        assert result.halted == []
    assert sorted(result.loaded) == ["customers", "events", "orders", "products"]
    assert fct_orders(spark, layout, "2026-06-01").count() == 60
    assert tables.read_dimension_table(spark, layout.table("dim_customers")).count() == 100
    assert spark.read.parquet(layout.table("fct_events")).count() == 200


def test_rerun_changes_nothing(spark, layout):
    before = fct_orders(spark, layout, "2026-06-01").collect()
    run_day(spark, CONTRACT, layout, "2026-06-01", only=ORDERS)
    after = fct_orders(spark, layout, "2026-06-01")
    assert sorted(map(tuple, before)) == sorted(map(tuple, after.collect()))


def test_null_spike_escalates_without_imputation(spark, layout, tmp_path):
    ds = "2026-06-03"
    every_fourth = F.substring("order_id", 4, 8).cast("int") % 4 == 0
    relanded(spark, layout, "orders", ds, lambda df: faults.blank(df, "order_total", every_fourth), tmp_path)
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    assert categories(result) == {"null_spike"}
    assert statuses(result) == {"escalated"}
    assert result.halted == ["orders"] and "customers" in result.loaded
    assert fct_orders(spark, layout, ds).count() == 0


def test_orphans_escalate_with_their_count(spark, layout, tmp_path):
    ds = "2026-06-04"
    first = F.substring("order_id", 4, 8).cast("int") <= 200
    relanded(
        spark, layout, "orders", ds, lambda df: faults.break_reference(df, "customer_id", first, "99999"), tmp_path
    )
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    assert categories(result) == {"referential_break"}
    row = result.incidents.first()
    assert row["n_bad"] == 20 and "keys=1" in row["error_message"]
    assert row["severity"] == "high" and result.halted == ["orders"]
    assert row["evidence"]["key_sample"] == "99999" and row["evidence"]["heavy_keys"] == "99999 x20"


def decide(spark, layout, ds, decision):
    rows = spark.read.parquet(layout.table("incidents")).filter(F.col("execution_date") == F.lit(ds).cast("date"))
    approvals = rows.select(
        "incident_id", F.lit("someone").alias("approved_by"), F.lit("").alias("comment"),
        F.lit(decision).alias("decision"), F.lit("2026-06-20 09:00:00").cast("timestamp").alias("at"),
    )
    return apply_decisions(spark, CONTRACT, layout, ds, approvals, "2026-06-20 09:00:00")


def test_approved_orphans_are_quarantined_and_the_rest_loaded(spark, layout):
    ds = "2026-06-04"
    undecided = apply_decisions(
        spark, CONTRACT, layout, ds,
        literal_table(spark, [], "incident_id string, approved_by string, comment string, decision string, at timestamp"),
        "2026-06-20 08:00:00",
    )
    assert [r["status"] for r in undecided.collect()] == ["pending_approval"]
    assert fct_orders(spark, layout, ds).count() == 0
    final = decide(spark, layout, ds, "approve")
    assert [r["status"] for r in final.collect()] == ["remediated"]
    assert fct_orders(spark, layout, ds).count() == 40
    aside = spark.read.parquet(f"{layout.table('approved')}/split/orders/{ds}/route=rejected")
    assert aside.count() == 20 and aside.select("customer_id").distinct().collect() == [("99999",)]


def test_declined_finding_lets_the_batch_stand(spark, layout):
    ds = "2026-06-03"
    final = decide(spark, layout, ds, "decline")
    assert [r["status"] for r in final.collect()] == ["declined"]
    day = fct_orders(spark, layout, ds)
    assert (day.count(), day.filter("order_total IS NULL").count()) == (60, 15)


def test_stale_source_escalates(spark, layout, tmp_path):
    ds = "2026-06-05"

    def shift(df):
        moved = faults.make_stale(df.withColumn("order_ts", F.col("order_ts").cast("timestamp")), "order_ts", F.lit(True), 2)
        return moved.withColumn("order_ts", F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss"))

    relanded(spark, layout, "orders", ds, shift, tmp_path)
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    assert categories(result) == {"staleness"}
    assert result.halted == ["orders"]


def test_duplicates_are_repaired_verified_and_closed(spark, layout, tmp_path):
    ds = "2026-06-06"
    half = F.substring("order_id", 4, 8).cast("int") % 2 == 0
    relanded(spark, layout, "orders", ds, lambda df: faults.append_duplicates(df, half), tmp_path)
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    assert {"duplicate_ingestion", "volume_anomaly_spike"} == categories(result)
    assert statuses(result) == {"remediated"}
    assert result.repaired == ["orders"] and result.halted == []
    day = fct_orders(spark, layout, ds)
    assert day.count() == 60 == day.select("order_id").distinct().count()
    assert spark.read.parquet(f"{layout.table('staging')}/orders/{ds}").count() == 90


def test_twelve_rows_escalate_by_bound_and_history(spark, layout, tmp_path):
    ds = "2026-06-07"
    relanded(spark, layout, "orders", ds, lambda df: df.orderBy("order_id").limit(12), tmp_path)
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    assert categories(result) == {"volume_anomaly_drop"}
    assert {r["check_name"] for r in result.incidents.collect()} == {"row_count", "volume_history"}
    assert result.halted == ["orders"]


def test_currency_text_is_drift_not_nulls(spark, layout, tmp_path):
    ds = "2026-06-08"
    relanded(spark, layout, "orders", ds, lambda df: faults.currency_text(
        df.withColumn("order_total", F.col("order_total").cast("double")), "order_total", F.lit(True)), tmp_path)
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    assert "schema_drift" in categories(result)
    drift = result.incidents.filter("failure_category = 'schema_drift'").first()
    assert drift["column_name"] == "order_total" and drift["confidence"] == "High"
    assert result.halted == ["orders"]


def test_renamed_key_escalates_and_other_datasets_go_on(spark, layout, tmp_path):
    ds = "2026-06-09"
    relanded(spark, layout, "customers", None, lambda df: faults.rename_column(df, "customer_id", "cust_id"), tmp_path)
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    drift = {(r["column_name"], r["failure_category"]) for r in result.incidents.collect() if r["dataset"] == "customers"}
    assert drift == {("customer_id", "schema_drift"), ("cust_id", "schema_drift")}
    assert result.halted == ["customers"]
    assert sorted(result.loaded) == ["orders", "products"]


def test_missing_batch_is_a_volume_drop(spark, layout):
    result = run_day(spark, CONTRACT, layout, "2026-06-10", only=["orders"])
    assert categories(result) == {"volume_anomaly_drop"}
    assert result.halted == ["orders"] and result.loaded == []


def test_registry_and_audit_agree(spark, layout):
    registry = spark.read.parquet(layout.table("incidents"))
    assert registry.count() == registry.select("incident_id").distinct().count()
    trail = spark.read.parquet(layout.table("incident_audit_trail"))
    steps = audit_transitions(trail, tie_break=["step"])
    assert steps.filter(~F.col("legal")).count() == 0
    assert trail.count() == trail.select("incident_id", "step").distinct().count()
    assert registry.select("execution_date").distinct().count() == 8
    assert registry.filter(F.col("execution_date") == F.lit(datetime.date(2026, 6, 6))).count() > 0


@pytest.fixture
def fresh(spark, tmp_path):
    """A small landing of its own for each test."""
    own = Layout(str(tmp_path / "landing"), str(tmp_path / "warehouse"))
    generate.write_landing(
        spark, own.landing, CONTRACT, days=2, customers=100, products=20, orders_per_day=60, events_per_day=200
    )
    return own


def state(spark, layout):
    """Registry, check log and audit trail as comparable rows."""
    registry = spark.read.parquet(layout.table("incidents")).select("incident_id", "dataset", "status")
    log = spark.read.parquet(layout.table("executions")).select("dataset", "check_name", "column_name", "metric", "passed")
    trail = spark.read.parquet(layout.table("incident_audit_trail")).select("incident_id", "step", "state")
    return [sorted(map(str, df.collect())) for df in (registry, log, trail)]


def test_reruns_keep_close_and_reopen(spark, fresh, tmp_path):
    ds = "2026-06-01"
    d = CONTRACT["orders"]
    raw = files.read_batch(spark, d, fresh.landing, ds)
    raw.drop("_malformed").write.option("header", True).csv(str(tmp_path / "clean"))

    def land(change):
        clean = spark.read.option("header", True).csv(str(tmp_path / "clean"))
        change(clean).write.mode("overwrite").option("header", True).csv(d.path(fresh.landing, ds))

    def blanked(df):
        return faults.blank(df, "order_total", F.substring("order_id", 4, 8).cast("int") % 4 == 0)

    land(blanked)
    run_day(spark, CONTRACT, fresh, ds, only=ORDERS)
    once = state(spark, fresh)
    run_day(spark, CONTRACT, fresh, ds, only=ORDERS)
    assert state(spark, fresh) == once  # a rerun leaves the same tables
    run_day(spark, CONTRACT, fresh, ds, only=["customers"])
    assert state(spark, fresh) == once  # and a partial one the other datasets' rows

    land(lambda df: df)
    result = run_day(spark, CONTRACT, fresh, ds, only=ORDERS)
    assert result.halted == [] and result.incidents.count() == 0
    registry = spark.read.parquet(fresh.table("incidents"))
    assert [r["status"] for r in registry.collect()] == ["closed"]

    land(blanked)
    run_day(spark, CONTRACT, fresh, ds, only=ORDERS)
    steps = audit_transitions(spark.read.parquet(fresh.table("incident_audit_trail")), tie_break=["step"])
    assert steps.filter(~F.col("legal")).count() == 0
    assert [r["state"] for r in steps.orderBy("step").collect()] == ["open", "escalated", "closed", "open", "escalated"]

    decide(spark, fresh, ds, "decline")
    result = run_day(spark, CONTRACT, fresh, ds, only=ORDERS)
    assert statuses(result) == {"declined"} and "orders" in result.loaded  # what a human decided stays decided


def test_dimension_with_repeated_keys_is_repaired_before_it_is_published(spark, fresh, tmp_path):
    again = F.substring("customer_id", 5, 6).cast("int") <= 3
    relanded(spark, fresh, "customers", None, lambda df: faults.append_duplicates(df, again), tmp_path)
    result = run_day(spark, CONTRACT, fresh, "2026-06-01", only=ORDERS)
    customers = tables.read_dimension_table(spark, fresh.table("dim_customers"))
    assert customers.count() == 100 == customers.select("customer_id").distinct().count()
    assert "customers" in result.repaired and "remediated" in statuses(result)
    assert "orders" in result.loaded


def test_dimension_cut_short_is_no_reference(spark, fresh, tmp_path):
    run_day(spark, CONTRACT, fresh, "2026-06-01", only=ORDERS)
    relanded(spark, fresh, "customers", None, lambda df: df.orderBy("customer_id").limit(12), tmp_path)
    result = run_day(spark, CONTRACT, fresh, "2026-06-02", only=ORDERS)
    assert result.halted == ["customers"] and "orders" in result.loaded
    assert tables.read_dimension_table(spark, fresh.table("dim_customers")).count() == 100


def test_rows_of_another_day_halt_until_somebody_decides(spark, fresh, tmp_path):
    ds = "2026-06-01"

    def stray(df):
        third = F.substring("order_id", 4, 8).cast("int") % 3 == 0
        return df.withColumn("order_ts", F.when(third, F.lit("2026-05-20 10:00:00")).otherwise(F.col("order_ts")))

    relanded(spark, fresh, "orders", ds, stray, tmp_path)
    result = run_day(spark, CONTRACT, fresh, ds, only=ORDERS)
    found = result.incidents.filter("check_name = 'stray_rows'").collect()
    assert [(r["metric"], r["status"]) for r in found] == [(20.0, "escalated")]
    assert result.halted == ["orders"]
    final = decide(spark, fresh, ds, "approve")
    assert {r["status"] for r in final.filter("check_name = 'stray_rows'").collect()} == {"remediated"}
    assert fct_orders(spark, fresh, ds).count() == 40
    aside = spark.read.parquet(f"{fresh.warehouse}/quarantine/orders/{ds}")
    assert aside.count() == 20 and aside.first()["_reason"] == "event time outside the batch day"


def test_malformed_lines_halt_and_are_set_aside_once_approved(spark, fresh, tmp_path):
    """Lines that lost or gained fields are neither NULLs nor rows; approved, they go aside and all others load."""
    layout, ds = fresh, "2026-06-02"
    path = Path(CONTRACT["orders"].path(layout.landing, ds))
    part = next(p for p in ([path] if path.is_file() else sorted(path.glob("part-*"))) if len(p.read_text().splitlines()) > 3)
    lines = part.read_text().splitlines()
    cut, long = lines[1].split(",")[0], lines[2] + ",EXTRA"
    part.write_text("\n".join([lines[0], cut, long, *lines[3:]]) + "\n")
    for crc in part.parent.glob(f".{part.name}.crc"):
        crc.unlink()
    result = run_day(spark, CONTRACT, layout, ds, only=ORDERS)
    found = {(r["check_name"], r["column_name"]) for r in result.incidents.filter("dataset = 'orders'").collect()}
    assert ("schema", "_malformed") in found and not any(c == "null_rate" for c, _ in found)
    assert "orders" in result.halted and not exists(spark, layout.table("fct_orders"))
    ids = [(r["incident_id"],) for r in result.incidents.filter("dataset = 'orders'").collect()]
    approvals = literal_table(spark, [(i, "ops", "ok", "approve", "2026-06-03 08:00:00") for (i,) in ids], "incident_id string, approved_by string, comment string, decision string, at timestamp")
    apply_decisions(spark, CONTRACT, layout, ds, approvals, "2026-06-03 09:00:00")
    loaded = tables.read_fact(spark, layout.table("fct_orders"), "day", [ds])
    assert loaded.count() == 58 and "_malformed" not in loaded.columns
    aside = spark.read.parquet(f"{layout.table('approved')}/split/orders/{ds}").filter("route = 'rejected'")
    assert {r["_malformed"] for r in aside.collect()} == {cut, long}


def test_declared_checks_against_the_past_run_each_day(spark, fresh):
    judged = {}
    for ds in ("2026-06-01", "2026-06-02"):
        result = run_day(spark, CONTRACT, fresh, ds, only=ORDERS, limits=Watch(landing_hours=1e9))
        assert result.halted == [] and result.incidents.count() == 0
        for r in result.checks.filter("dataset = 'orders'").collect():
            judged.setdefault(r["check_name"], []).append((str(r["batch_date"]), r["evidence"]))
    for name in ("volume_median", "static_source", "landing_sla"):
        assert [d for d, _ in sorted(judged[name])] == ["2026-06-01", "2026-06-02"]
    assert "median=60" in sorted(judged["volume_median"])[1][1]
    assert "before=2026-06-01" in sorted(judged["static_source"])[1][1]
    never = run_day(spark, CONTRACT, fresh, "2026-06-03", only=ORDERS, limits=Watch(landing_hours=1e9))
    assert never.halted == ["orders"] and categories(never) == {"volume_anomaly_drop", "staleness"}


def test_watch_tells_each_fault_apart(spark):
    days = [f"2026-06-{d:02d}" for d in range(1, 7)]
    rates, counts, lags = [0.01, 0.01, 0.02, 0.09, 0.01, None], [100, 100, 104, 100, 20, 100], [100.0, 76.0, 52.0, 28.0, 30.0, 4.0]
    log = [("o", d, "null_rate", "c", r) for d, r in zip(days, rates)] + [("o", d, "row_count", None, float(n)) for d, n in zip(days, counts)]
    log += [("o", d, "freshness", "t", h) for d, h in zip(days, lags)] + [("p", days[3], "null_rate", "c", 0.9)]
    frame = literal_table(spark, [(*x, "2026-06-08 00:00:00") for x in log], "dataset string, batch_date date, check_name string, column_name string, metric double, as_of timestamp")
    arrivals = literal_table(spark, [("o", days[0], "2026-06-01 05:00:00"), ("o", days[1], None)], "dataset string, batch_date date, landed_at timestamp")
    got = watched(frame, Watch(landing_hours=5.0), arrivals)
    bad = {(r["dataset"], r["check_name"], str(r["batch_date"])) for r in got.filter("NOT passed").collect()}
    assert bad == {("o", "null_spike", days[3]), ("o", "volume_median", days[4]), ("o", "static_source", days[4]), ("o", "landing_sla", days[1])}
    assert got.count() == 6 + 6 + 6 + 2
    assert watched(frame.limit(0), Watch()).count() == 0

import datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from batchkeeper.contract import Contract
from batchkeeper.functions import scalars
from batchkeeper.functions.casting import CAST_ERROR, cast_failure_share, cast_to_contract, standardize
from batchkeeper.retail import retail_contract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp")


def test_hours_are_exact(spark):
    lag = scalars.hours_between(ts("2024-01-30 23:57:12"), ts("2024-01-31 06:00:00"))
    assert one(spark, lag) == pytest.approx(6.0466667, abs=1e-6)


@pytest.mark.parametrize(
    "n,expected", [(1450, 302), (360, 0), (240, 0), (300, 0), (361, 0), (12, -95), (0, -100)]
)
def test_deviation_beyond_the_violated_bound(spark, n, expected):
    assert one(spark, scalars.beyond_bound_pct(F.lit(n), F.lit(240), F.lit(360))) == expected


@pytest.mark.parametrize("n,expected", [(240, True), (360, True), (239, False), (361, False), (None, False)])
def test_bounds_are_inclusive(spark, n, expected):
    assert one(spark, scalars.in_bounds(F.lit(n).cast("int"), F.lit(240), F.lit(360))) is expected


def test_rate_of_nothing_is_unknown(spark):
    assert one(spark, scalars.rate(F.lit(0), F.lit(0))) is None


def test_incident_ids_are_stable(spark):
    day = F.lit("2024-01-15").cast("date")
    first = one(spark, scalars.incident_id(day, F.lit("orders"), F.lit("row_count")))
    assert first == one(spark, scalars.incident_id(day, F.lit("orders"), F.lit("row_count")))
    assert first.startswith("INC-20240115-") and len(first) == len("INC-20240115-") + 8
    assert first != one(spark, scalars.incident_id(day, F.lit("events"), F.lit("row_count")))


def test_padded_ids_keep_long_numbers(spark):
    assert one(spark, scalars.padded_id("ORD", 8, F.lit(42))) == "ORD00000042"
    assert one(spark, scalars.padded_id("ORD", 8, F.lit(1234567890))) == "ORD1234567890"


def test_weighted_pick_follows_the_weights(spark):
    drawn = spark.range(20000).select(
        scalars.pick(scalars.uniform(7, "s", F.col("id")), ["a", "b", "c"], [50, 30, 20]).alias("v")
    )
    share = {r["v"]: r["count"] / 20000 for r in drawn.groupBy("v").count().collect()}
    assert share["a"] == pytest.approx(0.5, abs=0.02) and share["c"] == pytest.approx(0.2, abs=0.02)


def test_casting_lists_what_does_not_fit(spark):
    raw = spark.createDataFrame(
        [("1", "14.99", "2024-01-01 10:00:00"), ("2", "$14.99", "soon"), (None, None, None), ("x", "1e2", "2024-01-01")],
        "n string, price string, at string",
    )
    typed = cast_to_contract(raw, {"n": "int", "price": "double", "at": "timestamp"})
    got = [(r["n"], r["price"], r[CAST_ERROR]) for r in typed.collect()]
    assert got == [(1, 14.99, []), (2, None, ["price", "at"]), (None, None, []), (None, 100.0, ["n"])]
    shares = {r["column_name"]: (r["n_rows"], r["n_bad"]) for r in cast_failure_share(
        raw, {"n": "int", "price": "double", "at": "timestamp", "gone": "int"}).collect()}
    assert shares == {"n": (4, 1), "price": (4, 1), "at": (4, 1)}


def test_standardize(spark):
    raw = spark.createDataFrame(
        [("2024-02-03", "  New   York "), ("03/02/2024", "x"), ("Feb 3, 2024", None), ("never", "")], "d string, t string"
    )
    out = standardize(raw, dates={"d": ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy"]}, text={"t": "lower"})
    day = datetime.date(2024, 2, 3)
    assert [tuple(r) for r in out.collect()] == [(day, "new york"), (day, "x"), (day, None), (None, "")]


def test_contract_from_its_file_layout(tmp_path):
    text = """
datasets:
  customers:
    source: csv
    path_pattern: "customers.csv"
    primary_key: customer_id
    expected_row_count: {min: 480, max: 520}
    schema: {customer_id: string, signup_date: date}
    freshness_sla: null
  orders:
    source: csv
    path_pattern: "orders/orders_{date}.csv"
    primary_key: order_id
    foreign_keys: {customer_id: customers.customer_id}
    expected_row_count_per_batch: {min: 240, max: 360}
    schema: {order_id: string, customer_id: string, order_ts: timestamp, quantity: integer, order_total: float}
    null_tolerance: {order_total: 0.02, customer_id: 0.0}
    freshness_sla: {max_delay_hours: 26}
warehouse:
  tables: {customers: dim_customers, orders: fct_orders}
agent:
  remediation_policy: {duplicate_ingestion: auto_fix, staleness: escalate}
"""
    path = tmp_path / "contract.yaml"
    path.write_text(text)
    contract = Contract.from_file(str(path))
    orders = contract["orders"]
    assert orders.is_fact and orders.ts_column == "order_ts" and orders.table == "fct_orders"
    assert orders.spark_type("order_total") == "double" and orders.max_delay_hours == 26
    assert (orders.row_bounds.lower, orders.row_bounds.upper, orders.row_bounds.scope) == (240, 360, "batch")
    assert orders.path("/r", "2026-06-01") == "/r/orders/orders_2026-06-01.csv"
    assert contract["customers"].row_bounds.scope == "table" and not contract["customers"].is_fact
    assert contract.policy == {"duplicate_ingestion": "auto_fix", "staleness": "escalate"}
    with pytest.raises(ValueError):
        orders.path("/r")


def test_rules_as_frames(spark):
    contract = retail_contract()
    assert rows(contract.bounds_frame(spark)) == [
        ("customers", "table", 480.0, 520.0),
        ("events", "batch", 900.0, 1500.0),
        ("orders", "batch", 240.0, 360.0),
        ("products", "table", 55.0, 65.0),
    ]
    assert rows(contract.tolerance_frame(spark)) == [("orders", "customer_id", 0.0), ("orders", "order_total", 0.02)]
    assert contract.foreign_key_frame(spark).count() == 3
    assert rows(contract.freshness_frame(spark)) == [("events", "event_ts", 6.0), ("orders", "order_ts", 26.0)]
    assert contract.policy_frame(spark).count() == 7

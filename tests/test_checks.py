import datetime

from frames import rows
from pyspark.sql import functions as F

from batchkeeper.operators import baselines, checks
from batchkeeper.retail import retail_contract

D = datetime.date


def days(spark, counts, dataset="orders", start=D(2024, 1, 1)):
    data = [(dataset, start + datetime.timedelta(days=i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(data, "dataset string, batch_date date, n_rows bigint")


def test_row_count_at_the_bounds(spark):
    bounds = retail_contract().bounds_frame(spark)
    judged = checks.row_count_check(checks.contract_bounds(days(spark, [239, 240, 360, 361, 0]), bounds))
    assert [(r["passed"], r["n_bad"]) for r in judged.orderBy("batch_date").collect()] == [
        (False, 1), (True, 0), (True, 0), (False, 1), (False, 240),
    ]


def test_absent_batches_appear_with_zero_rows(spark):
    counts = days(spark, [10, 20, 30, 40]).filter(F.dayofmonth("batch_date") != 3).withColumn("lower", F.lit(5.0))
    filled = checks.fill_missing_batches(counts, "1 day").orderBy("batch_date")
    assert [(r["batch_date"].day, r["n_rows"], r["lower"]) for r in filled.collect()] == [
        (1, 10, 5.0), (2, 20, 5.0), (3, 0, 5.0), (4, 40, 5.0),
    ]
    calendar = checks.expected_batches(days(spark, [10]), "orders", "2023-12-31", "2024-01-02").orderBy("batch_date")
    assert [r["n_rows"] for r in calendar.collect()] == [0, 10, 0]


def test_rows_without_a_batch_date_are_kept(spark):
    counts = days(spark, [10, 20]).unionByName(
        spark.createDataFrame([("orders", None, 3)], "dataset string, batch_date date, n_rows bigint")
    )
    filled = checks.fill_missing_batches(counts, "1 day")
    assert rows(filled.select("batch_date", "n_rows"))[0] == (None, 3)
    assert filled.count() == 3


def test_profile_in_one_pass(spark):
    df = spark.createDataFrame(
        [(D(2024, 1, 1), 1, None, 0.0), (D(2024, 1, 1), 1, 5, 1.0), (D(2024, 1, 1), None, None, 2.0)],
        "b date, k int, c int, z double",
    )
    p = checks.batch_profile(df, "d", "b", ["k"], ["c"], ["z"]).first()
    assert (p["n_rows"], p["excess"], p["n_null_key"], p["null_c"], p["zero_z"]) == (3, 1, 1, 2, 1)
    assert checks.batch_profile(df.limit(0), "d", "b", ["k"], ["c"]).count() == 0


def test_null_rate_fails_strictly_above_the_tolerance(spark):
    p = spark.createDataFrame(
        [("d", D(2024, 1, 1), 100, 2), ("d", D(2024, 1, 2), 100, 3), ("d", D(2024, 1, 3), 0, 0)],
        "dataset string, batch_date date, n_rows bigint, null_c bigint",
    )
    assert [r["passed"] for r in checks.null_rate(p, {"c": 0.02}).orderBy("batch_date").collect()] == [True, False, True]


def test_freshness_and_landing_at_the_limit(spark):
    p = spark.createDataFrame(
        [("d", D(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 0)), ("e", D(2024, 1, 1), None)],
        "dataset string, batch_date date, max_ts timestamp",
    )
    got = {r["dataset"]: r["passed"] for r in checks.freshness(p, "ts", "2024-01-01 06:00:00", 6).collect()}
    assert got == {"d": True, "e": False}
    late = {r["dataset"]: r["passed"] for r in checks.freshness(p, "ts", "2024-01-01 06:00:01", 6).collect()}
    assert late == {"d": False, "e": False}
    arrivals = spark.createDataFrame(
        [("d", D(2024, 1, 1), datetime.datetime(2024, 1, 2, 2, 0)), ("d", D(2024, 1, 2), datetime.datetime(2024, 1, 3, 2, 1)),
         ("d", D(2024, 1, 3), None)],
        "dataset string, batch_date date, landed_at timestamp",
    )
    assert [r["passed"] for r in checks.landing_sla(arrivals, 26).orderBy("batch_date").collect()] == [True, False, False]


def columns(spark, names):
    data = [(c, t, i) for i, (c, t) in enumerate(names)]
    return spark.createDataFrame(data, "column_name string, type string, ordinal int")


def test_schema_diff(spark):
    expected = columns(spark, [("a", "int"), ("b", "string"), ("c", "double"), ("d", "string")])
    observed = columns(spark, [("b", "string"), ("a", "int"), ("x", "string"), ("c", "double")])
    failures = spark.createDataFrame([("c", 4, 4)], "column_name string, n_rows bigint, n_bad bigint")
    diff = checks.schema_diff(observed, expected, failures)
    assert {(r["column_name"], r["kind"]) for r in diff.collect()} == {
        ("a", "reordered"), ("b", "reordered"), ("c", "type_changed"), ("d", "missing"), ("x", "unexpected"),
    }
    assert checks.schema_diff(expected, expected).count() == 0
    failed = checks.schema_check(diff, "t", "2024-01-01")
    assert failed.filter("passed").count() == 0 and failed.columns == list(checks.CHECK_COLUMNS)


def test_three_sigma_needs_history(spark):
    got = [r["status"] for r in baselines.three_sigma(days(spark, [100, 101, 99, 100, 12, 100, 500]), 14)
           .orderBy("batch_date").collect()]
    assert got[:2] == ["insufficient_history"] * 2 and got[4] == "drop" and got[6] == "spike"


def test_trailing_median(spark):
    got = baselines.vs_trailing_median(days(spark, [10, 20, 30, 12]), 7, 0.5).orderBy("batch_date").collect()
    assert [r["median"] for r in got] == [None, 10.0, 15.0, 20.0]
    assert [r["passed"] for r in got] == [None, False, False, True]


def test_null_spike_and_static_source(spark):
    rates = days(spark, [1, 1, 1]).withColumn(
        "rate", F.when(F.dayofmonth("batch_date") == 3, 0.25).otherwise(0.004)
    )
    assert [r["spike"] for r in baselines.null_spike(rates, 7, 3.0, 0.005).orderBy("batch_date").collect()] == [
        False, False, True,
    ]
    t = datetime.datetime
    b = spark.createDataFrame(
        [("d", D(2024, 1, 1), t(2024, 1, 1)), ("d", D(2024, 1, 2), t(2024, 1, 1)), ("d", D(2024, 1, 3), t(2024, 1, 3))],
        "dataset string, batch_date date, max_ts timestamp",
    )
    assert [r["static"] for r in baselines.static_source(b).orderBy("batch_date").collect()] == [False, True, False]


def test_holt_by_hand(spark):
    got = baselines.holt_forecast(days(spark, [10, 12, 13]), 0.5, 0.3).orderBy("batch_date").collect()
    assert [r["forecast"] for r in got][:2] == [None, 10.0]
    # level 11, trend 0.3 after the second value
    assert abs(got[2]["forecast"] - 11.3) < 1e-9 and abs(got[2]["residual"] - 1.7) < 1e-9


def test_history_and_deviation(spark):
    counts = days(spark, [300, 300, 1450]).withColumn("lower", F.lit(240.0)).withColumn("upper", F.lit(360.0))
    assert [r["deviation_pct"] for r in baselines.volume_deviation(counts).orderBy("batch_date").collect()] == [0, 0, 302]
    last = baselines.seven_day_history(counts, 2).orderBy("batch_date").collect()
    assert [r["status"] for r in last] == ["healthy", "anomaly"]


def test_column_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5), (2, "b", None)], "i int, s string, x double")
    got = {r["column_name"]: tuple(r)[2:] for r in checks.profile(df, "t").collect()}
    assert got == {
        "i": (3, 0, 2, "1", "2"), "s": (3, 1, 2, "a", "b"), "x": (3, 1, 2, "1.500000", "2.500000"),
    }
    rough = checks.profile(df, "t", approximate=True).filter("column_name = 'i'").first()
    assert rough["n_distinct"] == 2

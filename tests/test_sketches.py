"""Samples of offending keys, column fingerprints, stored profiles and forecast states."""

import datetime

from frames import rows
from pyspark.sql import functions as F

from batchkeeper.operators import baselines, checks, fingerprints, incidents, monitoring
from batchkeeper.operators.offenders import SCHEMA, key_sample, offending_keys
from batchkeeper.sources import tables

D = datetime.date(2024, 1, 1)
CHECK = (
    "dataset string, batch_date date, check_name string, column_name string, metric double, lower double, upper double, "
    "passed boolean, n_bad bigint, evidence string"
)


def test_key_sample_is_exact_and_settles_ties(spark):
    counts = spark.createDataFrame([("a", i, 1 + (i % 3)) for i in range(20)] + [("b", 7, 4)], "g string, k int, n bigint")
    got = rows(key_sample(counts, ["g"], ["k"], 3))
    assert got == [("a", "0,1,2", "2 x3,5 x3,8 x3"), ("b", "7", "7 x4")]


def test_a_group_sends_k_rows_a_task(spark):
    counts = spark.range(1000).selectExpr("id % 2 AS g", "id AS k", "1L AS n")
    plan = key_sample(counts, ["g"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") >= 2


def offending_case(spark):
    data = [(1, 10, 1.0), (1, 10, 1.0), (2, None, 0.0), (3, 99, None), (None, 99, None), (4, 10, 2.0)]
    df = spark.createDataFrame(data, "id int, fk int, x double").withColumn("d", F.lit(D))
    found = [
        ("t", D, check, column, 1.0, None, 0.0, False, 1, "e")
        for check, column in (("duplicates", "id"), ("foreign_key", "fk"), ("null_rate", "x"), ("zero_rate", "x"), ("row_count", None))
    ]
    dim = spark.createDataFrame([(10,)], "pk int")
    return df, spark.createDataFrame(found, CHECK), {"fk": (dim, "pk")}


def test_offending_keys_of_every_check(spark):
    df, found, references = offending_case(spark)
    got = {(r["check_name"], r["key_sample"], r["heavy_keys"]) for r in offending_keys(found, df, "t", "d", ["id"], references).collect()}
    assert got == {
        ("duplicates", "1", "1 x2"), ("foreign_key", "99", "99 x2"), ("null_rate", "NULL,3", "NULL x1,3 x1"), ("zero_rate", "2", "2 x1"),
    }


def test_offending_keys_of_passed_other_and_empty_batches(spark):
    df, found, references = offending_case(spark)
    passed = found.withColumn("passed", F.lit(True))
    assert offending_keys(passed, df, "t", "d", ["id"], references).count() == 0
    assert offending_keys(found, df, "u", "d", ["id"], references).count() == 0
    assert offending_keys(found, df.limit(0), "t", "d", ["id"], references).count() == 0
    assert offending_keys(found, df.drop("fk"), "t", "d", ["id"]).filter("check_name = 'foreign_key'").count() == 0


def test_evidence_holds_sample_kind_and_header(spark):
    _, found, _ = offending_case(spark)
    drift = spark.createDataFrame([("t", D, "schema", "y", 1.0, None, 0.0, False, 1, "missing: expected int, observed -")], CHECK)
    sample = spark.createDataFrame([("t", D, "duplicates", "id", "1", "1 x2")], SCHEMA)
    built = incidents.build_incidents(found.unionByName(drift), "dag", offenders=sample)
    row = built.filter("check_name = 'duplicates'").first()["evidence"]
    assert (row["anomaly_type"], row["key_sample"], row["heavy_keys"]) == ("repeats", "1", "1 x2")
    assert row["header_mismatch"] == "y missing: expected int, observed -"
    assert built.filter("check_name = 'zero_rate'").first()["evidence"]["key_sample"] is None


def hints(observed, expected):
    told = (fingerprints.column_fingerprints(df) for df in (observed, expected))
    return rows(fingerprints.rename_hints(*told).select("expected_name", "observed_name", "kind"))


def test_renamed_swapped_gone_and_new(spark):
    df = spark.range(500).selectExpr("id AS a", "concat('n', id) AS b", "concat('m', id % 9) AS c", "id * 0.5D AS d", "id + 10000 AS e")
    assert hints(df, df) == []
    changed = df.selectExpr("a AS a2", "c AS b", "b AS c", "d + 9e9D AS d2", "e")
    assert hints(changed, df) == [
        (None, "d2", "new"), ("a", "a2", "renamed"), ("b", "c", "swapped"), ("c", "b", "swapped"), ("d", None, "gone"),
    ]


def test_columns_without_values_match_nothing(spark):
    df = spark.createDataFrame([(None, ""), (None, "")], "a string, b string")
    assert hints(df.withColumnRenamed("a", "x"), df) == [(None, "x", "new"), ("a", None, "gone")]
    assert hints(df.limit(0).withColumnRenamed("a", "x"), df.limit(0)) == [(None, "x", "new"), ("a", None, "gone")]


def test_two_columns_alike_are_matched_once(spark):
    df = spark.range(50).selectExpr("id AS a")
    twice = df.selectExpr("a AS x", "a AS y")
    assert hints(twice, df) == [(None, "y", "new"), ("a", "x", "renamed")]


def test_merged_days_equal_one_profile(spark):
    df = spark.range(3000).selectExpr("date_add(DATE '2024-01-01', CAST(id % 5 AS INT)) AS d", "id % 700 AS v", "if(id % 3 = 0, NULL, concat('s', id % 11)) AS s")
    daily = fingerprints.daily_profile(df, "d", ["v", "s"])
    got = {r["column_name"]: tuple(r)[2:] for r in fingerprints.merged_profile(daily, "t", ["v", "s"]).collect()}
    exact = {r["column_name"]: tuple(r)[2:] for r in checks.profile(df.select("v", "s"), "t").collect()}
    for c in ("v", "s"):
        assert got[c][:2] == exact[c][:2] and got[c][3:] == exact[c][3:]
        assert abs(got[c][2] - exact[c][2]) <= 0.03 * exact[c][2]
    none = fingerprints.merged_profile(daily.limit(0), "t", ["v", "s"]).collect()
    assert [tuple(r)[2:] for r in none] == [(0, 0, 0, None, None)] * 2


def test_a_state_advanced_day_by_day_equals_the_whole_series(spark, tmp_path):
    values = [100, 140, 90, 210, 160, 120]
    series = spark.createDataFrame([("s", D + datetime.timedelta(days=i), v) for i, v in enumerate(values)], "dataset string, batch_date date, n_rows bigint")
    path, got = str(tmp_path / "state"), []
    for i in (0, 1, 2, 2, 3, 4, 5):  # one day twice
        ds = str(D + datetime.timedelta(days=i))
        state = tables.read_state(spark, path, ds, baselines.STATE)
        step = baselines.holt_advance(state, series.filter(F.col("batch_date") <= F.lit(ds).cast("date")), 0.4, 0.2)
        row = step.collect()
        assert len(row) == 1
        got.append((row[0]["batch_date"], row[0]["forecast"]))
        tables.write_state(baselines.next_state(state, step), path, ds)
    whole = [(r["batch_date"], r["forecast"]) for r in baselines.holt_forecast(series, 0.4, 0.2).orderBy("batch_date").collect()]
    assert sorted(set(got), key=lambda t: t[0]) == whole


def test_run_history_opens_incidents(spark):
    failures = spark.createDataFrame(
        [("load", D, 3, 0, "exhausted_retries", True), ("check", D, 1, 0, "transient", False)],
        "task_id string, execution_date date, n_transient bigint, n_data_fault bigint, verdict string, needs_incident boolean",
    )
    opened = incidents.build_incidents(monitoring.run_checks(failures), "dag").collect()
    assert [(r["dataset"], r["n_bad"], r["failure_category"]) for r in opened] == [("load", 3, "unclassified")]

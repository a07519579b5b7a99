import datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from batchkeeper.contract import policy_frame
from batchkeeper.operators import checks, incidents, monitoring, remediation
from batchkeeper.retail import POLICY

DAY = datetime.date(2024, 1, 2)
SCHEMA = (
    "dataset string, batch_date date, check_name string, column_name string, metric double, lower double, "
    "upper double, passed boolean, n_bad bigint, evidence string"
)


def found(spark, *extra, rows_staged=300.0, passed=True):
    base = [("orders", DAY, "row_count", None, rows_staged, 240.0, 360.0, passed, 0, "rows")]
    return spark.createDataFrame([*base, *extra], SCHEMA)


def triaged(spark, *extra, **kw):
    return incidents.triage(found(spark, *extra, **kw), policy_frame(spark, POLICY), "dag")


def dup(n):
    return ("orders", DAY, "duplicates", "order_id", float(n), None, 0.0, False, n, "dup")


def test_clean_checks_open_nothing(spark):
    assert triaged(spark).count() == 0


def test_undecided_check_is_a_failed_one(spark):
    assert checks.failed(found(spark, passed=None)).count() == 1


@pytest.mark.parametrize(
    "row,category,decision",
    [
        (dup(10), "duplicate_ingestion", "auto_fix"),
        (("orders", DAY, "null_rate", "t", 0.25, None, 0.02, False, 75, "n"), "null_spike", "escalate"),
        (("orders", DAY, "foreign_key", "c", 9.0, None, 0.0, False, 9, "f"), "referential_break", "escalate"),
        (("orders", DAY, "freshness", "ts", 30.0, None, 26.0, False, 1, "s"), "staleness", "escalate"),
        (("orders", DAY, "schema", "p", 1.0, None, 0.0, False, 1, "s"), "schema_drift", "escalate"),
        (("orders", DAY, "brand_new", "p", 1.0, None, 0.0, False, 1, "s"), "unclassified", "escalate"),
    ],
)
def test_category_and_decision(spark, row, category, decision):
    got = triaged(spark, row).first()
    assert (got["failure_category"], got["decision"]) == (category, decision)
    assert got["status"] == ("remediation_pending" if decision == "auto_fix" else "escalated")
    if category == "unclassified":
        assert got["confidence"] == "Low" and got["task_id"] == "validate_other"


def test_spike_is_fixed_only_when_duplicates_explain_it(spark):
    explained = triaged(spark, dup(1150), rows_staged=1450.0, passed=False)
    assert {r["decision"] for r in explained.collect()} == {"auto_fix"}
    grown = triaged(spark, dup(10), rows_staged=1450.0, passed=False).filter("check_name = 'row_count'").first()
    assert (grown["decision"], grown["escalation_reason"]) == ("escalate", "gate_evidence")


def test_gates_fail_closed(spark):
    base = spark.createDataFrame(
        [
            ("a", "High", "deduplicate_partition", "auto_fix"),
            ("b", None, "deduplicate_partition", "auto_fix"),
            ("c", "High", "drop_table", "auto_fix"),
            ("d", "High", "deduplicate_partition", None),
            ("e", "High", "report_orphans", "escalate"),
        ],
        "incident_id string, confidence string, action string, policy string",
    )
    got = {r["incident_id"]: (r["decision"], r["escalation_reason"]) for r in incidents.decide(base).collect()}
    assert got == {
        "a": ("auto_fix", None), "b": ("escalate", "gate_evidence"), "c": ("escalate", "gate_deterministic"),
        "d": ("escalate", "gate_approved"), "e": ("escalate", "gate_approved"),
    }


def test_contradiction_lowers_confidence(spark):
    opened = incidents.diagnose(incidents.build_incidents(found(spark, dup(5)), "dag"))
    other = spark.createDataFrame(
        [("orders", DAY, "duplicates", "order_id", True)],
        "dataset string, execution_date date, check_name string, column_name string, independent_passed boolean",
    )
    row = incidents.contradict(opened, other).first()
    assert (row["confidence"], row["contradicted"]) == ("Low", True)
    assert incidents.contradict(opened, other.limit(0)).first()["confidence"] == "High"


def test_a_denied_failure_does_not_pass_the_evidence_gate(spark):
    args = (found(spark, dup(5)), policy_frame(spark, POLICY), "dag")
    other = spark.createDataFrame(
        [("orders", DAY, "duplicates", "order_id", True)],
        "dataset string, execution_date date, check_name string, column_name string, independent_passed boolean",
    )
    assert incidents.triage(*args).first()["decision"] == "auto_fix"
    row = incidents.triage(*args, independent=other).first()
    assert (row["decision"], row["escalation_reason"]) == ("escalate", "gate_evidence")
    agreeing = other.withColumn("independent_passed", F.lit(False))
    assert incidents.triage(*args, independent=agreeing).first()["decision"] == "auto_fix"


def test_evidence_counts_history_before_the_day_only(spark):
    before = [
        ("orders", DAY - datetime.timedelta(days=i), "row_count", None, 100.0 * i, 0.0, 999.0, True, 0, "r")
        for i in (1, 2)
    ]
    row = incidents.build_incidents(found(spark, dup(5), *before), "dag").first()["evidence"]
    assert (row["staged_row_count"], row["historical_average"], row["duplicate_rows"]) == (300, 150.0, 5)


def test_latest_approval_counts(spark):
    rows_ = triaged(spark, dup(5), ("orders", DAY, "null_rate", "t", 0.25, None, 0.02, False, 75, "n"))
    null_id = rows_.filter("failure_category = 'null_spike'").first()["incident_id"]
    t = datetime.datetime
    approvals = spark.createDataFrame(
        [(null_id, "x", "", "approve", t(2024, 1, 3, 9)), (null_id, "y", "no", "decline", t(2024, 1, 3, 10))],
        "incident_id string, approved_by string, comment string, decision string, at timestamp",
    )
    got = {r["failure_category"]: (r["status"], r["approved_by"]) for r in incidents.apply_approvals(rows_, approvals).collect()}
    assert got == {"duplicate_ingestion": ("remediation_pending", None), "null_spike": ("declined", "y")}
    waiting = incidents.apply_approvals(rows_, approvals.limit(0)).filter("failure_category = 'null_spike'").first()
    assert waiting["status"] == "pending_approval"


def test_halt_gate_blocks_one_dataset_day_only(spark):
    rows_ = triaged(spark, ("orders", DAY, "null_rate", "t", 0.25, None, 0.02, False, 75, "n"))
    load = spark.createDataFrame([("orders", DAY), ("events", DAY)], "dataset string, batch_date date")
    assert rows(incidents.halt_gate(load, rows_)) == [("events", DAY)]
    assert incidents.halt_gate(load, triaged(spark, dup(3))).count() == 2


def test_post_verification_needs_a_passing_recheck(spark):
    rows_ = triaged(spark, dup(5))
    ok = spark.createDataFrame(
        [("orders", DAY, "duplicates", True)], "dataset string, batch_date date, check_name string, passed boolean"
    )
    assert remediation.post_verification(rows_, ok).first()["status"] == "remediated"
    assert remediation.post_verification(rows_, ok.limit(0)).first()["status"] == "remediation_failed"


def test_audit_order(spark):
    t = datetime.datetime
    log = spark.createDataFrame(
        [
            ("i", "open", t(2024, 1, 1, 0)), ("i", "remediation_pending", t(2024, 1, 1, 1)),
            ("i", "remediated", t(2024, 1, 1, 1, 30)), ("j", "remediated", t(2024, 1, 1, 2)),
        ],
        "incident_id string, state string, at timestamp",
    )
    steps = remediation.audit_transitions(log).orderBy("incident_id", "at").collect()
    assert [(r["incident_id"], r["state"], r["legal"]) for r in steps] == [
        ("i", "open", True), ("i", "remediation_pending", True), ("i", "remediated", True), ("j", "remediated", False),
    ]
    times = monitoring.time_to_resolution(log, "open", "remediated").first()
    assert (times["n_resolved"], times["mean_seconds"], times["p50_seconds"], times["max_seconds"]) == (1, 5400.0, 5400.0, 5400)


def test_retries(spark):
    runs = spark.createDataFrame(
        [("a", 1, True, "timed out"), ("a", 2, False, ""), ("b", 1, True, "lock"), ("b", 2, True, "lock"),
         ("b", 3, True, "rate limit"), ("c", 1, False, ""), ("d", 1, False, ""), ("d", 2, True, "bad column")],
        "task_id string, at int, failed boolean, log_text string",
    ).withColumn("execution_date", F.lit(DAY))
    out = monitoring.retry_outcome(runs, 2)
    assert {r["task_id"]: (r["trailing_failures"], r["outcome"]) for r in out.collect()} == {
        "a": (0, "recovered"), "b": (3, "exhausted"), "c": (0, "clean"), "d": (1, "retrying"),
    }
    verdict = {r["task_id"]: (r["verdict"], r["needs_incident"]) for r in monitoring.failure_class(runs, out).collect()}
    assert verdict == {"a": ("transient", False), "b": ("exhausted_retries", True), "d": ("data_fault", True)}


def test_run_status_without_runs(spark):
    runs = spark.createDataFrame([], "state string, at timestamp")
    assert tuple(monitoring.run_status(runs).first()) == ("idle", 0, None, None)


def test_impact_follows_the_lineage(spark):
    edges = [("a", "fct_a"), ("fct_a", "report"), ("report", "board"), ("b", "fct_b"), ("board", "report")]
    impact = incidents.lineage_impact(spark, edges, ["a", "b"]).collect()
    got = {r["dataset"]: (r["target_table"], r["downstream"]) for r in impact}
    assert got == {"a": ("fct_a", "board,report"), "b": ("fct_b", "")}

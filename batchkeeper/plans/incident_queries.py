"""Registered queries: from the failed checks of the faulty batches to decisions and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from batchkeeper.contract import policy_frame
from batchkeeper.operators import checks, incidents, keys, monitoring, remediation
from batchkeeper.operators.offenders import offending_keys
from batchkeeper.plans import inputs
from batchkeeper.plans.contract_checks import all_checks, checks_ctes
from batchkeeper.plans.inputs import tidy
from batchkeeper.plans.registry import query
from batchkeeper.retail import POLICY
from batchkeeper.session import materialize, new_scratch
from batchkeeper.sources import tables

DAG = "daily_batches"

# Declared lineage between datasets, tables and reports.
LINEAGE = [
    ("orders", "fct_orders"),
    ("lineitem", "fct_items"),
    ("events", "fct_events"),
    ("fct_orders", "daily_sales_summary"),
    ("fct_items", "daily_sales_summary"),
    ("fct_events", "daily_volume"),
    ("daily_sales_summary", "weekly_sales_forecast"),
]


def _checks(spark, sf):
    """The check rows as a table, as a run has them: whatever follows reads these few rows, not the facts."""
    return materialize(all_checks(spark, sf, faulty=True), "checks")


def _triage(spark, sf):
    return incidents.triage(_checks(spark, sf), policy_frame(spark, POLICY), DAG)


def _case(column, pairs, other):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{other}' END"


INCIDENTS_SQL = (
    checks_ctes(faulty=True)
    + f""",
ev AS (
  SELECT *, max(CASE WHEN check_name = 'row_count' THEN metric END) OVER b AS staged,
    max(CASE WHEN check_name = 'duplicates' THEN n_bad END) OVER b AS dup,
    max(CASE WHEN check_name = 'row_count' THEN upper END) OVER b AS bu,
    max(CASE WHEN check_name = 'row_count' THEN lower END) OVER b AS bl,
    avg(CASE WHEN check_name = 'row_count' THEN metric END) OVER (PARTITION BY dataset ORDER BY batch_date
      RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS hist
  FROM checks WINDOW b AS (PARTITION BY dataset, batch_date)),
inc AS (
  SELECT 'INC-' || strftime(batch_date, '%Y%m%d') || '-'
      || substr(sha256(dataset || '|' || check_name || '|' || coalesce(column_name, '')), 1, 8) AS incident_id,
    '{DAG}' AS dag_id, {_case("check_name", incidents.TASKS, "validate_other")} AS task_id, dataset,
    batch_date AS execution_date, 1 AS try_number,
    CASE WHEN check_name = 'row_count' AND metric > upper THEN 'volume_anomaly_spike'
         WHEN check_name = 'row_count' AND metric < lower THEN 'volume_anomaly_drop'
         WHEN check_name IN ('null_rate', 'zero_rate') THEN 'null_spike'
         WHEN check_name = 'duplicates' THEN 'duplicate_ingestion'
         WHEN check_name = 'foreign_key' THEN 'referential_break'
         WHEN check_name = 'freshness' THEN 'staleness' ELSE 'unclassified' END AS failure_category,
    check_name || ' failed on ' || dataset || ' ' || evidence AS error_message,
    check_name, column_name, metric, lower, upper, CAST(n_bad AS BIGINT) AS n_bad,
    CAST(staged AS BIGINT) AS staged_row_count, hist AS historical_average, CAST(dup AS BIGINT) AS duplicate_rows,
    coalesce(dup > 0 AND staged - coalesce(dup, 0) BETWEEN bl AND bu, FALSE) AS explained_by_duplicates,
    n_bad * 1.0e0 / staged AS bad_share
  FROM ev WHERE NOT passed),
dia AS (
  SELECT *, CASE WHEN failure_category IN ('schema_drift', 'null_spike', 'referential_break') THEN 'high'
                 ELSE 'medium' END AS severity,
    CASE failure_category
      WHEN 'volume_anomaly_spike' THEN CASE WHEN explained_by_duplicates THEN 'High' ELSE 'Medium' END
      WHEN 'null_spike' THEN CASE WHEN bad_share >= 0.1e0 THEN 'High' ELSE 'Medium' END
      WHEN 'duplicate_ingestion' THEN 'High' WHEN 'referential_break' THEN 'High' ELSE 'Medium' END AS confidence,
    CASE failure_category
      WHEN 'volume_anomaly_spike' THEN CASE WHEN explained_by_duplicates THEN 'batch was transmitted more than once'
                                            ELSE 'source volume grew' END
      WHEN 'volume_anomaly_drop' THEN 'source export was cut short'
      WHEN 'null_spike' THEN CASE WHEN bad_share >= 0.1e0 THEN 'source exported unpopulated values'
                                  ELSE 'a few values are missing at the source' END
      WHEN 'duplicate_ingestion' THEN 'batch was ingested more than once'
      WHEN 'referential_break' THEN 'dimension is behind the facts'
      ELSE 'source did not refresh' END AS hypothesis,
    CASE failure_category
      WHEN 'volume_anomaly_spike' THEN CASE WHEN explained_by_duplicates THEN 'deduplicate_partition'
                                            ELSE 'review_volume' END
      WHEN 'volume_anomaly_drop' THEN 'review_volume' WHEN 'null_spike' THEN 'review_nulls'
      WHEN 'duplicate_ingestion' THEN 'deduplicate_partition' WHEN 'referential_break' THEN 'report_orphans'
      ELSE 'review_source' END AS action,
    {_case("failure_category", POLICY, "escalate")} AS policy
  FROM inc),
gated AS (
  SELECT *, confidence = 'High' AS gate_evidence, action IN ('deduplicate_partition', 'report_orphans') AS gate_deterministic,
    TRUE AS gate_safe, policy = 'auto_fix' AS gate_approved, TRUE AS gate_reversible
  FROM dia),
decided AS (
  SELECT *, CASE WHEN gate_evidence AND gate_deterministic AND gate_approved THEN 'auto_fix' ELSE 'escalate' END
      AS decision,
    CASE WHEN NOT gate_evidence THEN 'gate_evidence' WHEN NOT gate_deterministic THEN 'gate_deterministic'
         WHEN NOT gate_approved THEN 'gate_approved' END AS escalation_reason,
    CASE WHEN gate_evidence AND gate_deterministic AND gate_approved THEN 'remediation_pending' ELSE 'escalated' END
      AS status
  FROM gated)"""
)


ANOMALY_SQL = """CASE WHEN check_name = 'row_count' AND metric > upper THEN 'spike'
    WHEN check_name = 'row_count' AND metric < lower THEN 'drop' WHEN check_name = 'null_rate' THEN 'nulls'
    WHEN check_name = 'zero_rate' THEN 'zeros' WHEN check_name = 'duplicates' THEN 'repeats'
    WHEN check_name = 'foreign_key' THEN 'orphans' WHEN check_name = 'freshness' THEN 'stale' ELSE 'other' END"""


@query(
    "incidents",
    "WITH "
    + INCIDENTS_SQL
    + """
SELECT incident_id, dag_id, task_id, dataset, execution_date, try_number, failure_category, severity, 'open' AS status,
  error_message, check_name, column_name, round(metric, 6) AS metric, round(lower, 6) AS lower, round(upper, 6) AS upper,
  n_bad FROM dia""",
)
def incident_rows(spark, sf):
    return tidy(incidents.build_incidents(_checks(spark, sf), DAG).drop("evidence"))


@query(
    "fault_class",
    "WITH " + INCIDENTS_SQL + """
SELECT dataset, execution_date AS batch_date, check_name, column_name, failure_category FROM inc""",
)
def fault_class(spark, sf):
    bad = checks.failed(_checks(spark, sf))
    return bad.select(
        "dataset", "batch_date", "check_name", "column_name", incidents.fault_class().alias("failure_category")
    )


@query(
    "evidence",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, staged_row_count, round(historical_average, 6) AS historical_average, duplicate_rows,
  explained_by_duplicates, round(bad_share, 6) AS bad_share, """ + ANOMALY_SQL + """ AS anomaly_type FROM inc""",
)
def evidence(spark, sf):
    rows = incidents.build_incidents(_checks(spark, sf), DAG)
    samples = ("header_mismatch", "key_sample", "heavy_keys")
    return tidy(rows.select("incident_id", "evidence.*").drop(*samples))


def _offenders_sql(dataset, check, column, source, batch, key, where, having=""):
    label = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
    order = ", ".join(key)
    return f"""SELECT '{dataset}' AS dataset, {batch} AS batch_date, '{check}' AS check_name, '{column}' AS column_name,
    {label} AS k, count(*) AS n, row_number() OVER (PARTITION BY {batch} ORDER BY {order}) AS low,
    row_number() OVER (PARTITION BY {batch} ORDER BY count(*) DESC, {order}) AS heavy
  FROM {source} WHERE {where} GROUP BY {batch}, {order} {having}"""


_MONTH, _SHIP, _DAY = (f"CAST(date_trunc('{p}', {c}) AS DATE)" for p, c in (("month", "o_orderdate"), ("month", "l_shipdate"), ("day", "ts")))
_ITEM = ["l_orderkey", "l_linenumber"]


def _orphan(column, table, ref):
    return f"{column} IS NOT NULL AND {column} NOT IN (SELECT {ref} FROM {table})"


OFFENDERS_SQL = "\n  UNION ALL\n  ".join(
    _offenders_sql(*row)
    for row in (
        ("orders", "duplicates", "o_orderkey", "f_orders", _MONTH, ["o_orderkey"], "true", "HAVING count(*) > 1"),
        ("lineitem", "duplicates", "l_orderkey,l_linenumber", "lineitem", _SHIP, _ITEM, "true", "HAVING count(*) > 1"),
        ("events", "duplicates", "event_id", "f_events", _DAY, ["event_id"], "true", "HAVING count(*) > 1"),
        ("orders", "null_rate", "o_custkey", "f_orders", _MONTH, ["o_orderkey"], "o_custkey IS NULL"),
        ("orders", "null_rate", "o_totalprice", "f_orders", _MONTH, ["o_orderkey"], "o_totalprice IS NULL"),
        ("events", "null_rate", "user_id", "f_events", _DAY, ["event_id"], "user_id IS NULL"),
        ("lineitem", "zero_rate", "l_discount", "lineitem", _SHIP, _ITEM, "l_discount = 0"),
        ("orders", "foreign_key", "o_custkey", "f_orders", _MONTH, ["o_custkey"], _orphan("o_custkey", "customer", "c_custkey")),
        ("lineitem", "foreign_key", "l_orderkey", "lineitem", _SHIP, ["l_orderkey"], _orphan("l_orderkey", "orders", "o_orderkey")),
        ("lineitem", "foreign_key", "l_partkey", "lineitem", _SHIP, ["l_partkey"], _orphan("l_partkey", "part", "p_partkey")),
        ("events", "foreign_key", "user_id", "f_events", _DAY, ["user_id"], _orphan("user_id", "customer", "c_custkey")),
    )
)


@query(
    "evidence_keys",
    "WITH "
    + INCIDENTS_SQL
    + """,
off AS (SELECT dataset, batch_date, check_name, column_name,
    string_agg(k, ',' ORDER BY low) FILTER (WHERE low <= 5) AS key_sample,
    string_agg(k || ' x' || n, ',' ORDER BY heavy) FILTER (WHERE heavy <= 5) AS heavy_keys
  FROM ("""
    + OFFENDERS_SQL
    + f""") o GROUP BY 1, 2, 3, 4)
SELECT incident_id, key_sample, heavy_keys, CASE WHEN inc.dataset = 'events' AND execution_date = DATE '{inputs.LONG_DAY}' THEN
    'event_time unexpected: expected -, observed timestamp_ntz; ts missing: expected timestamp_ntz, observed -' END AS header_mismatch
FROM inc LEFT JOIN off ON inc.dataset = off.dataset AND execution_date = off.batch_date AND inc.check_name = off.check_name
  AND inc.column_name = off.column_name""",
)
def evidence_keys(spark, sf):
    """Keys behind each failure of the faulty batches; one day's header has its time column under another name too."""
    events = inputs.faulty_events(spark, sf)
    renamed = checks.columns_frame(events.drop("batch_date").withColumnRenamed("ts", "event_time"))
    diff = checks.schema_diff(renamed, checks.columns_frame(events.drop("batch_date")))
    drift = checks.schema_check(diff, "events", inputs.LONG_DAY)
    found = materialize(checks.union_checks(all_checks(spark, sf, faulty=True), drift), "checks")
    customer = inputs.table(spark, sf, "customer")
    parts = [
        offending_keys(found, inputs.faulty_orders(spark, sf), "orders", "batch_date", ["o_orderkey"], {"o_custkey": (customer, "c_custkey")}),
        offending_keys(
            found, inputs.items(spark, sf), "lineitem", "batch_date", ["l_orderkey", "l_linenumber"],
            {"l_orderkey": (inputs.table(spark, sf, "orders"), "o_orderkey"), "l_partkey": (inputs.table(spark, sf, "part"), "p_partkey")},
        ),
        offending_keys(found, events, "events", "batch_date", ["event_id"], {"user_id": (customer, "c_custkey")}),
    ]
    rows = incidents.build_incidents(found, DAG, offenders=reduce(lambda a, b: a.unionByName(b), parts))
    wanted = ("key_sample", "heavy_keys", "header_mismatch")
    return rows.filter("check_name <> 'schema'").select("incident_id", *[f"evidence.{c}" for c in wanted])


@query(
    "diagnosis",
    "WITH " + INCIDENTS_SQL + " SELECT incident_id, failure_category, confidence, hypothesis, action FROM dia",
)
def diagnosis(spark, sf):
    rows = incidents.diagnose(incidents.build_incidents(_checks(spark, sf), DAG))
    return rows.select("incident_id", "failure_category", "confidence", "hypothesis", "action")


@query("policy_decision", "WITH " + INCIDENTS_SQL + " SELECT incident_id, failure_category, policy FROM dia")
def policy_decision(spark, sf):
    rows = incidents.build_incidents(_checks(spark, sf), DAG)
    return incidents.apply_policy(rows, policy_frame(spark, POLICY)).select("incident_id", "failure_category", "policy")


@query(
    "gate_decision",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, gate_evidence, gate_deterministic, gate_safe, gate_approved, gate_reversible, decision,
  escalation_reason, status FROM decided""",
)
def gate_decision(spark, sf):
    return _triage(spark, sf).select(
        "incident_id", "gate_evidence", "gate_deterministic", "gate_safe", "gate_approved", "gate_reversible",
        "decision", "escalation_reason", "status",
    )


@query(
    "contradictory_evidence",
    "WITH d AS (WITH " + INCIDENTS_SQL + " SELECT * FROM dia), c AS (WITH " + checks_ctes() + """ SELECT * FROM checks)
SELECT incident_id, CASE WHEN coalesce(c.passed, FALSE) THEN 'Low' ELSE d.confidence END AS confidence,
  coalesce(c.passed, FALSE) AS contradicted
FROM d LEFT JOIN c ON d.dataset = c.dataset AND d.execution_date = c.batch_date AND d.check_name = c.check_name
  AND d.column_name IS NOT DISTINCT FROM c.column_name""",
)
def contradictory_evidence(spark, sf):
    """Failures reported on the faulty batches against the same checks on the source tables."""
    reported = incidents.diagnose(incidents.build_incidents(_checks(spark, sf), DAG))
    return incidents.contradict(reported, _source_checks(spark, sf)).select("incident_id", "confidence", "contradicted")


def _source_checks(spark, sf):
    """The checks of the source tables, as a second opinion on the faulty batches."""
    return all_checks(spark, sf).select(
        "dataset", F.col("batch_date").alias("execution_date"), "check_name", "column_name",
        F.col("passed").alias("independent_passed"),
    )


@query(
    "gate_contradicted",
    "WITH d AS (WITH " + INCIDENTS_SQL + " SELECT * FROM decided), c AS (WITH " + checks_ctes() + """ SELECT * FROM checks),
j AS (SELECT d.*, gate_evidence AND NOT coalesce(c.passed, FALSE) AS agreed
  FROM d LEFT JOIN c ON d.dataset = c.dataset AND d.execution_date = c.batch_date AND d.check_name = c.check_name
    AND d.column_name IS NOT DISTINCT FROM c.column_name)
SELECT incident_id, agreed AS gate_evidence,
  CASE WHEN agreed AND gate_deterministic AND gate_approved THEN 'auto_fix' ELSE 'escalate' END AS decision,
  CASE WHEN NOT agreed THEN 'gate_evidence' WHEN NOT gate_deterministic THEN 'gate_deterministic'
       WHEN NOT gate_approved THEN 'gate_approved' END AS escalation_reason FROM j""",
)
def gate_contradicted(spark, sf):
    """Decisions where a failure that the second opinion denies no longer passes the evidence gate."""
    rows = incidents.triage(_checks(spark, sf), policy_frame(spark, POLICY), DAG, independent=_source_checks(spark, sf))
    return rows.select("incident_id", "gate_evidence", "decision", "escalation_reason")


@query(
    "incident_list",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, execution_date, task_id, failure_category, severity, status FROM decided
ORDER BY execution_date DESC, incident_id""",
)
def incident_list(spark, sf):
    rows = _triage(spark, sf).select(
        "incident_id", "execution_date", "task_id", "failure_category", "severity", "status"
    )
    return monitoring.incident_list(rows)


@query(
    "pending_incidents",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, dataset, execution_date, failure_category FROM decided
WHERE status = 'escalated' AND task_id IN ('validate_row_count', 'validate_joins')""",
)
def pending_incidents(spark, sf):
    rows = incidents.filter_incidents(
        _triage(spark, sf), status=["escalated"], task=["validate_row_count", "validate_joins"]
    )
    return rows.select("incident_id", "dataset", "execution_date", "failure_category")


@query(
    "incident_counts",
    "WITH " + INCIDENTS_SQL + """
SELECT failure_category, status, severity, count(*) AS n_incidents FROM decided GROUP BY ALL""",
)
def incident_counts(spark, sf):
    return monitoring.incident_counts(_triage(spark, sf))


@query(
    "apply_approvals",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, failure_category,
  CASE WHEN status <> 'escalated' THEN status
       WHEN failure_category = 'referential_break' THEN 'remediation_pending'
       WHEN failure_category = 'null_spike' THEN 'declined' ELSE 'pending_approval' END AS status,
  CASE WHEN failure_category IN ('referential_break', 'null_spike') THEN 'second' END AS approved_by
FROM decided""",
)
def apply_approvals(spark, sf):
    """Two decisions on every orphan and null incident, of which the later one counts."""
    rows = _triage(spark, sf)
    orphan = F.col("failure_category") == "referential_break"
    judged = rows.filter(F.col("failure_category").isin("referential_break", "null_spike"))

    def decision(first: bool):
        approve = orphan if not first else ~orphan
        at = "2024-02-01 08:00:00" if first else "2024-02-01 09:00:00"
        return F.struct(
            F.lit("first" if first else "second").alias("approved_by"),
            F.lit("").alias("comment"),
            F.when(approve, "approve").otherwise("decline").alias("decision"),
            F.lit(at).cast("timestamp").alias("at"),
        )

    approvals = judged.select("incident_id", F.inline(F.array(decision(True), decision(False))))
    moved = incidents.apply_approvals(rows, approvals)
    return moved.select("incident_id", "failure_category", "status", "approved_by")


@query(
    "loadable_batches",
    "WITH " + INCIDENTS_SQL + """
SELECT dataset, batch_date FROM checks c WHERE check_name = 'row_count' AND NOT EXISTS (
  SELECT 1 FROM decided d WHERE d.dataset = c.dataset AND d.execution_date = c.batch_date
    AND (d.status = 'escalated' OR d.severity = 'high'))""",
)
def loadable_batches(spark, sf):
    found = _checks(spark, sf)
    load_list = found.filter(F.col("check_name") == "row_count").select("dataset", "batch_date")
    return incidents.halt_gate(load_list, incidents.triage(found, policy_frame(spark, POLICY), DAG))


@query(
    "incident_detail",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, task_id, execution_date, failure_category, severity,
  CASE WHEN decision = 'escalate' OR dataset = 'lineitem' THEN 'ESCALATED'
       WHEN dataset = 'orders' THEN 'RESOLVED' ELSE 'IN_PROGRESS' END AS report_status,
  CASE WHEN decision = 'escalate' THEN 'none' WHEN dataset = 'lineitem' THEN 'failed'
       WHEN dataset = 'orders' THEN 'passed' ELSE 'outstanding' END AS verification, error_message AS observed,
  staged_row_count, round(historical_average, 6) AS historical_average, hypothesis, confidence,
  CASE dataset WHEN 'orders' THEN 'fct_orders' WHEN 'lineitem' THEN 'fct_items' ELSE 'fct_events' END AS target_table,
  CASE dataset WHEN 'events' THEN 'daily_volume' ELSE 'daily_sales_summary,weekly_sales_forecast' END AS downstream,
  CASE WHEN decision = 'auto_fix' THEN action ELSE 'none' END AS remediation, escalation_reason,
  CASE WHEN decision = 'auto_fix' THEN 'restore day partition from backup' ELSE 'none' END AS rollback_plan,
  CASE WHEN decision = 'auto_fix' AND dataset <> 'lineitem' THEN 'none' ELSE 'investigate: ' || hypothesis END
    AS recommended_action
FROM decided""",
)
def incident_detail(spark, sf):
    """Reports after a repair of the orders that held, one of the items that did not, and none yet of the events."""
    impact = incidents.lineage_impact(spark, LINEAGE, ["orders", "lineitem", "events"])
    pending = F.col("status") == incidents.PENDING
    status = (
        F.when(pending & (F.col("dataset") == "orders"), incidents.REMEDIATED)
        .when(pending & (F.col("dataset") == "lineitem"), incidents.FAILED)
        .otherwise(F.col("status"))
    )
    return tidy(incidents.incident_report(_triage(spark, sf).withColumn("status", status), impact))


@query(
    "feedback_accuracy",
    "WITH " + INCIDENTS_SQL + """
SELECT failure_category, count(*) AS n_incidents, count(*) FILTER (WHERE n_bad > 1) AS n_judged,
  round(avg(CASE WHEN n_bad > 1 THEN CASE WHEN n_bad % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END END), 6) AS accuracy
FROM dia GROUP BY 1""",
)
def feedback_accuracy(spark, sf):
    """Feedback stand-in: incidents with more than one bad row are judged, even counts confirm."""
    rows = incidents.build_incidents(_checks(spark, sf), DAG)
    feedback = rows.filter("n_bad > 1").select("incident_id", (F.col("n_bad") % 2 == 0).alias("confirmed"))
    return tidy(incidents.feedback_accuracy(rows, feedback))


@query(
    "incident_registry",
    "WITH " + INCIDENTS_SQL + " SELECT incident_id, execution_date, failure_category, status, n_bad FROM decided",
)
def incident_registry(spark, sf):
    """Register the incidents twice, as a rerun would; the registry holds each once."""
    path = new_scratch(spark, "incidents")
    rows = _triage(spark, sf)
    tables.write_incidents(rows, path)
    tables.write_incidents(materialize(spark.read.parquet(path), "rerun"), path)
    return spark.read.parquet(path).select("incident_id", "execution_date", "failure_category", "status", "n_bad")


@query(
    "audit_trail",
    "WITH " + INCIDENTS_SQL + """
SELECT incident_id, CASE WHEN decision = 'auto_fix' THEN 'remediated' ELSE 'escalated' END AS state,
  CASE WHEN decision = 'auto_fix' THEN '2024-02-01 02:10:00' ELSE '2024-02-01 02:05:00' END AS last_at,
  CAST(CASE WHEN decision = 'auto_fix' THEN 3 ELSE 2 END AS BIGINT) AS n_steps
FROM decided""",
)
def audit_trail(spark, sf):
    """Append opening, decision and repair steps to the log, then fold it to the latest state."""
    path, staged = new_scratch(spark, "audit"), new_scratch(spark, "incidents")
    _triage(spark, sf).write.parquet(staged)
    rows = spark.read.parquet(staged)
    auto, manual = rows.filter("decision = 'auto_fix'"), rows.filter("decision = 'escalate'")
    steps = [
        (rows, "open", "2024-02-01 02:00:00"),
        (manual, "escalated", "2024-02-01 02:05:00"),
        (auto, "remediation_pending", "2024-02-01 02:05:00"),
        (auto, "remediated", "2024-02-01 02:10:00"),
    ]
    for subset, state, at in steps:
        tables.append_audit(remediation.audit_rows(subset, state, at, "job-1"), path)
    ranks = {state: i for i, (_, state, _) in enumerate(steps)}
    return tidy(monitoring.current_state(spark.read.parquet(path), ranks)).withColumnRenamed("at", "last_at")


@query(
    "executions",
    "WITH " + checks_ctes() + """
SELECT dataset, check_name, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed,
  CAST(sum(n_bad) AS BIGINT) AS n_bad, 'run-1' AS run_id
FROM checks GROUP BY 1, 2""",
)
def executions(spark, sf):
    """Log a run's check results, then sum them up from the log."""
    path = new_scratch(spark, "executions")
    tables.write_executions(
        all_checks(spark, sf), path, "run-1", "2024-01-31", "2024-01-31 02:00:00", "2024-01-31 02:10:00"
    )
    return monitoring.executions(spark.read.parquet(path), "run-1")


@query(
    "post_verification",
    "WITH " + INCIDENTS_SQL + """,
again AS (SELECT batch_date, count(*) - count(DISTINCT o_orderkey) AS excess FROM (
    SELECT DISTINCT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date FROM f_orders) x GROUP BY 1)
SELECT incident_id, execution_date, d.n_bad, coalesce(excess = 0, FALSE) AS verified,
  CASE WHEN coalesce(excess = 0, FALSE) THEN 'remediated' ELSE 'remediation_failed' END AS status
FROM decided d LEFT JOIN again ON batch_date = execution_date AND dataset = 'orders'
WHERE check_name = 'duplicates'""",
)
def post_verification(spark, sf):
    """Duplicate incidents of all datasets; only orders are repaired, so only those verify."""
    opened = _triage(spark, sf).filter("check_name = 'duplicates'")
    repaired = keys.dedupe_latest(inputs.faulty_orders(spark, sf), ["o_orderkey", "batch_date"], ["o_orderdate"])
    again = checks.duplicate_check(
        checks.batch_profile(repaired, "orders", "batch_date", ["o_orderkey"]), ["o_orderkey"]
    )
    verified = remediation.post_verification(opened, again)
    return verified.select("incident_id", "execution_date", "n_bad", "verified", "status")

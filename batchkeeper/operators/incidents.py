"""From failed checks to incidents, evidence, diagnosis and a fail-closed decision.

All rules are tables: the reasoning is joins and boolean columns over check results,
which hold one row per dataset, batch and check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.functions.scalars import incident_id
from batchkeeper.operators.checks import failed
from batchkeeper.operators.joins import deep_reach
from batchkeeper.session import literal_table

# Canonical incident states.
OPEN, PENDING_APPROVAL, PENDING, REMEDIATED, FAILED, ESCALATED, DECLINED, ACCEPTED, CLOSED = (
    "open",
    "pending_approval",
    "remediation_pending",
    "remediated",
    "remediation_failed",
    "escalated",
    "declined",
    "accepted",  # a human took the batch as it is; nothing was left to check again
    "closed",  # a later run of the same day no longer finds it
)

# The validation task that runs each check.
TASKS = {
    "schema": "validate_schema",
    "row_count": "validate_row_count",
    "volume_history": "validate_row_count",
    "volume_median": "validate_row_count",
    "null_rate": "validate_null_rate",
    "zero_rate": "validate_null_rate",
    "null_spike": "validate_null_rate",
    "duplicates": "validate_duplicates",
    "foreign_key": "validate_joins",
    "freshness": "validate_freshness",
    "landing_sla": "validate_freshness",
    "stray_rows": "validate_freshness",
    "static_source": "validate_freshness",
}

HIGH_SEVERITY = ("schema_drift", "null_spike", "referential_break")

# (category, rule, least share of bad rows, only when duplicates explain the excess,
#  confidence, hypothesis, proposed action); the first rule that applies wins.
RULE_COLUMNS = (
    "failure_category string, rule int, min_bad_share double, needs_duplicates boolean, "
    "confidence string, hypothesis string, action string"
)
RULES = [
    ("schema_drift", 1, 1.0, False, "High", "source changed the layout or format of a column", "block_and_escalate"),
    ("schema_drift", 2, 0.0, False, "Medium", "some rows arrive in another format", "block_and_escalate"),
    ("volume_anomaly_spike", 1, 0.0, True, "High", "batch was transmitted more than once", "deduplicate_partition"),
    ("volume_anomaly_spike", 2, 0.0, False, "Medium", "source volume grew", "review_volume"),
    ("volume_anomaly_drop", 1, 0.0, False, "Medium", "source export was cut short", "review_volume"),
    ("null_spike", 1, 0.1, False, "High", "source exported unpopulated values", "review_nulls"),
    ("null_spike", 2, 0.0, False, "Medium", "a few values are missing at the source", "review_nulls"),
    ("duplicate_ingestion", 1, 0.0, False, "High", "batch was ingested more than once", "deduplicate_partition"),
    ("referential_break", 1, 0.0, False, "High", "dimension is behind the facts", "report_orphans"),
    ("staleness", 1, 0.0, False, "Medium", "source did not refresh", "review_source"),
]

# (action, deterministic, destructive, reversible). An action that is not listed passes no gate.
ACTION_COLUMNS = "action string, deterministic boolean, destructive boolean, reversible boolean"
ACTIONS = [
    ("deduplicate_partition", True, False, True),
    ("block_and_escalate", True, False, True),
    ("review_volume", False, False, True),
    ("review_nulls", False, False, True),
    ("report_orphans", True, False, True),
    ("review_source", False, False, True),
]


def fault_class() -> Column:
    """Fault category of a failed check row; unknown checks are ``unclassified`` and can only escalate."""
    return F.expr(
        """CASE
        WHEN check_name = 'schema' THEN 'schema_drift'
        WHEN check_name IN ('row_count', 'volume_history', 'volume_median') AND metric > upper THEN 'volume_anomaly_spike'
        WHEN check_name IN ('row_count', 'volume_history', 'volume_median') AND metric < lower THEN 'volume_anomaly_drop'
        WHEN check_name IN ('null_rate', 'zero_rate', 'null_spike') THEN 'null_spike'
        WHEN check_name = 'duplicates' THEN 'duplicate_ingestion'
        WHEN check_name = 'foreign_key' THEN 'referential_break'
        WHEN check_name IN ('freshness', 'landing_sla', 'static_source', 'stray_rows') THEN 'staleness'
        ELSE 'unclassified' END"""
    )


def severity(category: Column) -> Column:
    return F.when(category.isin(*HIGH_SEVERITY), "high").otherwise("medium")


def task_of(check: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TASKS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, check), F.lit("validate_other"))


def anomaly_type() -> Column:
    """What went wrong in one word, from a check row."""
    return F.expr(
        """CASE
        WHEN check_name IN ('row_count', 'volume_history', 'volume_median') AND metric > upper THEN 'spike'
        WHEN check_name IN ('row_count', 'volume_history', 'volume_median') AND metric < lower THEN 'drop'
        WHEN check_name = 'schema' THEN 'drift'
        WHEN check_name IN ('null_rate', 'null_spike') THEN 'nulls'
        WHEN check_name = 'zero_rate' THEN 'zeros'
        WHEN check_name = 'duplicates' THEN 'repeats'
        WHEN check_name = 'foreign_key' THEN 'orphans'
        WHEN check_name IN ('freshness', 'landing_sla', 'static_source', 'stray_rows') THEN 'stale'
        ELSE 'other' END"""
    )


def collect_evidence(checks: DataFrame) -> DataFrame:
    """Beside every check row: rows staged, historical average, duplicates, kind of anomaly, mismatch of the header.

    ``header_mismatch`` lists what the batch's schema checks found, by column; null where they found nothing.

    Windows over the check results themselves; the facts are not read again.
    """
    batch = "OVER (PARTITION BY dataset, batch_date)"
    before = (
        "OVER (PARTITION BY dataset ORDER BY datediff(batch_date, DATE '1970-01-01') "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    count = "CASE WHEN check_name = 'row_count' THEN {} END"
    rows = checks.selectExpr(
        "*",
        f"CAST(max({count.format('metric')}) {batch} AS BIGINT) AS staged_row_count",
        f"max(CASE WHEN check_name = 'duplicates' THEN n_bad END) {batch} AS duplicate_rows",
        f"avg({count.format('metric')}) {before} AS historical_average",
        f"max({count.format('upper')}) {batch} AS batch_upper",
        f"max({count.format('lower')}) {batch} AS batch_lower",
        # one text per declared or observed column at most
        f"""array_join(sort_array(collect_list(CASE WHEN check_name = 'schema' AND NOT coalesce(passed, false)
            THEN concat(column_name, ' ', evidence) END) {batch}), '; ') AS mismatches""",
    )
    return rows.selectExpr(
        *checks.columns,
        "staged_row_count",
        "duplicate_rows",
        "historical_average",
        """coalesce(duplicate_rows > 0 AND staged_row_count - duplicate_rows BETWEEN batch_lower AND batch_upper, false)
           AS explained_by_duplicates""",
        """CASE WHEN check_name = 'schema' THEN metric
                WHEN staged_row_count > 0 THEN n_bad / staged_row_count END AS bad_share""",
        "nullif(mismatches, '') AS header_mismatch",
    ).withColumn("anomaly_type", anomaly_type())


def build_incidents(checks: DataFrame, dag_id: str, try_number: int = 1, offenders: DataFrame | None = None) -> DataFrame:
    """One incident per failed check. Ids depend on the finding alone, so reruns agree.

    ``offenders``: what ``offenders.offending_keys`` found, at most one row per finding; without it the samples are null.
    """
    rows = failed(collect_evidence(checks))
    if offenders is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("key_sample", "heavy_keys")})
    else:
        x = offenders.select(*[F.col(c).alias(f"_{c}") for c in ("dataset", "batch_date", "check_name", "column_name")], "key_sample", "heavy_keys")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("dataset", "batch_date", "check_name", "column_name")]
        rows = rows.join(x, same, "left")
    number = F.coalesce(F.col("column_name"), F.lit(""))
    category = fault_class()
    message = F.concat_ws(" ", F.col("check_name"), F.lit("failed on"), F.col("dataset"), F.col("evidence"))
    return rows.select(
        incident_id(F.col("batch_date"), F.col("dataset"), F.col("check_name"), number).alias("incident_id"),
        F.lit(dag_id).alias("dag_id"),
        task_of(F.col("check_name")).alias("task_id"),
        F.col("dataset"),
        F.col("batch_date").alias("execution_date"),
        F.lit(try_number).alias("try_number"),
        category.alias("failure_category"),
        severity(category).alias("severity"),
        F.lit(OPEN).alias("status"),
        message.alias("error_message"),
        "check_name",
        "column_name",
        "metric",
        "lower",
        "upper",
        "n_bad",
        F.struct(
            "staged_row_count", "historical_average", "duplicate_rows", "explained_by_duplicates", "bad_share",
            "anomaly_type", "header_mismatch", "key_sample", "heavy_keys",
        ).alias("evidence"),
    )


def apply_policy(incidents: DataFrame, policy: DataFrame) -> DataFrame:
    """Attach the declared policy; a category without one escalates."""
    known = F.broadcast(policy.select("failure_category", "policy"))  # one row per category
    joined = incidents.join(known, "failure_category", "left")
    return joined.withColumn("policy", F.coalesce("policy", F.lit("escalate")))


def diagnose(incidents: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Attach confidence, hypothesis and action of the first rule whose conditions the evidence meets."""
    spark = incidents.sparkSession
    rules = rules if rules is not None else literal_table(spark, RULES, RULE_COLUMNS)
    enough = F.coalesce("evidence.bad_share", F.lit(0.0)) >= F.col("min_bad_share")
    explained = ~F.col("needs_duplicates") | F.col("evidence.explained_by_duplicates")
    fits = F.coalesce(enough & explained, F.lit(False))
    chosen = F.when(fits, F.struct("rule", "confidence", "hypothesis", "action"))
    matched = incidents.join(F.broadcast(rules), "failure_category", "left")  # the fixed rule table
    best = matched.groupBy("incident_id").agg(
        F.first(F.struct(*incidents.columns)).alias("incident"), F.min(chosen).alias("best")
    )
    return best.select(
        "incident.*",
        F.coalesce("best.confidence", F.lit("Low")).alias("confidence"),
        F.coalesce("best.hypothesis", F.lit("no rule explains this")).alias("hypothesis"),
        F.coalesce("best.action", F.lit("none")).alias("action"),
    )


def contradict(incidents: DataFrame, independent: DataFrame) -> DataFrame:
    """Lower confidence to Low where an independent check disagrees with the reported failure.

    ``independent(dataset, execution_date, check_name, column_name, independent_passed)``.
    A failure nobody else has judged stands as it is.
    """
    on = (
        (F.col("i.dataset") == F.col("x.dataset"))
        & F.col("i.execution_date").eqNullSafe(F.col("x.execution_date"))
        & (F.col("i.check_name") == F.col("x.check_name"))
        & F.col("i.column_name").eqNullSafe(F.col("x.column_name"))
    )
    joined = incidents.alias("i").join(independent.alias("x"), on, "left")
    disagrees = F.coalesce(F.col("x.independent_passed"), F.lit(False))
    kept = [F.col(f"i.{c}") for c in incidents.columns if c != "confidence"]
    return joined.select(
        *kept,
        F.when(disagrees, "Low").otherwise(F.col("i.confidence")).alias("confidence"),
        disagrees.alias("contradicted"),
    )


def decide(diagnosed: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """The five gates, all of which must hold; anything false or unknown escalates.

    ``diagnosed`` carries confidence, action and policy.
    """
    spark = diagnosed.sparkSession
    actions = actions if actions is not None else literal_table(spark, ACTIONS, ACTION_COLUMNS)
    known = diagnosed.join(F.broadcast(actions), "action", "left")  # the fixed action table

    def holds(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    gates = {
        "gate_evidence": holds(F.col("confidence") == "High"),
        "gate_deterministic": holds(F.col("deterministic")),
        "gate_safe": holds(~F.col("destructive")),
        "gate_approved": holds(F.col("policy") == "auto_fix"),
        "gate_reversible": holds(F.col("reversible")),
    }
    gated = known.withColumns(gates)
    passed = F.lit(True)
    reason = F.lit(None).cast("string")
    for gate in reversed(gates):
        passed = passed & F.col(gate)
        reason = F.when(~F.col(gate), F.lit(gate)).otherwise(reason)
    return (
        gated.withColumn("decision", F.when(passed, "auto_fix").otherwise("escalate"))
        .withColumn("escalation_reason", reason)
        .withColumn("status", F.when(passed, PENDING).otherwise(ESCALATED))
        .drop("deterministic", "destructive", "reversible")
    )


def triage(
    checks: DataFrame,
    policy: DataFrame,
    dag_id: str,
    offenders: DataFrame | None = None,
    independent: DataFrame | None = None,
) -> DataFrame:
    """Checks to decided incidents, in one lazy plan.

    A failure that an ``independent`` check (see :func:`contradict`) denies has Low confidence, so the evidence gate
    escalates it, whatever its policy.
    """
    diagnosed = diagnose(apply_policy(build_incidents(checks, dag_id, offenders=offenders), policy))
    if independent is not None:
        diagnosed = contradict(diagnosed, independent).drop("contradicted")
    return decide(diagnosed)


def apply_approvals(incidents: DataFrame, approvals: DataFrame) -> DataFrame:
    """The latest human decision per incident moves escalated incidents on.

    ``approvals(incident_id, approved_by, comment, decision, at)``; decision is
    ``approve`` or ``decline``. Incidents that need no approval are left as they are.
    """
    latest = approvals.groupBy("incident_id").agg(
        F.max(F.struct("at", "decision", "approved_by", "comment")).alias("human")
    )
    joined = incidents.join(latest, "incident_id", "left")
    waiting = F.col("status").isin(ESCALATED, PENDING_APPROVAL)
    status = (
        F.when(~waiting, F.col("status"))
        .when(F.col("human.decision") == "approve", PENDING)
        .when(F.col("human.decision") == "decline", DECLINED)
        .otherwise(PENDING_APPROVAL)
    )
    return joined.select(
        *[c for c in incidents.columns if c != "status"],
        status.alias("status"),
        F.col("human.approved_by").alias("approved_by"),
        F.col("human.comment").alias("comment"),
    )


def filter_incidents(
    incidents: DataFrame,
    status: Sequence[str] = (),
    category: Sequence[str] = (),
    task: Sequence[str] = (),
) -> DataFrame:
    for column, wanted in (("status", status), ("failure_category", category), ("task_id", task)):
        if wanted:
            incidents = incidents.filter(F.col(column).isin(*wanted))
    return incidents


def halt_gate(load_list: DataFrame, incidents: DataFrame) -> DataFrame:
    """Dataset-days that may load: those without an open high-severity or escalated incident.

    ``load_list(dataset, batch_date)``. One broken batch blocks itself and nothing else.
    """
    blocking = F.col("status").isin(ESCALATED, PENDING_APPROVAL, FAILED) | (
        (F.col("severity") == "high") & ~F.col("status").isin(REMEDIATED, DECLINED, ACCEPTED, CLOSED)
    )
    blocked = incidents.filter(blocking).select("dataset", F.col("execution_date").alias("batch_date")).distinct()
    return load_list.join(blocked, ["dataset", "batch_date"], "left_anti")


def incident_report(decided: DataFrame, impact: DataFrame) -> DataFrame:
    """The report fields of each incident: status, diagnosis, impact, action, rollback.

    Resolved is what a recheck has closed, not what is about to be repaired; ``verification`` says which.
    ``impact(dataset, target_table, downstream)``: what hangs off each dataset.
    """
    auto = F.col("decision") == "auto_fix"
    status = F.col("status")
    verified = status.isin(REMEDIATED, CLOSED)
    report_status = (
        F.when(verified, "RESOLVED")
        .when(status.isin(DECLINED, ACCEPTED), "DISMISSED")
        .when(status == PENDING, "IN_PROGRESS")
        .otherwise("ESCALATED")
    )
    verification = (
        F.when(verified, "passed").when(status == FAILED, "failed").when(status == PENDING, "outstanding").otherwise("none")
    )
    recommended = F.when(verified | (auto & (status == PENDING)), "none").otherwise(F.concat(F.lit("investigate: "), F.col("hypothesis")))
    return decided.join(F.broadcast(impact), "dataset", "left").select(  # one row per dataset
        "incident_id",
        "task_id",
        "execution_date",
        "failure_category",
        "severity",
        report_status.alias("report_status"),
        verification.alias("verification"),
        F.col("error_message").alias("observed"),
        F.col("evidence.staged_row_count").alias("staged_row_count"),
        F.col("evidence.historical_average").alias("historical_average"),
        "hypothesis",
        "confidence",
        "target_table",
        "downstream",
        F.when(auto, F.col("action")).otherwise("none").alias("remediation"),
        "escalation_reason",
        F.when(auto, "restore day partition from backup").otherwise("none").alias("rollback_plan"),
        recommended.alias("recommended_action"),
    )


def feedback_accuracy(diagnoses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Share of diagnoses humans confirmed, per category. ``feedback(incident_id, confirmed)``."""
    judged = diagnoses.join(feedback, "incident_id", "left")
    return judged.groupBy("failure_category").agg(
        F.count(F.lit(1)).alias("n_incidents"),
        F.count("confirmed").alias("n_judged"),
        F.avg(F.col("confirmed").cast("int")).alias("accuracy"),
    )


def lineage_impact(spark: SparkSession, edges: Sequence[tuple[str, str]], datasets: Sequence[str]) -> DataFrame:
    """(dataset, target_table, downstream) from declared table lineage; a few names per dataset. Runs jobs.

    The target table is what a dataset feeds directly, downstream is all that hangs off it.
    """
    graph = literal_table(spark, edges, "src string, dst string")
    start = literal_table(spark, [(d, d) for d in datasets], "dataset string, node string")
    reached = deep_reach(graph, start, by=["dataset"]).filter("depth > 0")

    def names(condition: str, alias: str) -> Column:
        found = F.sort_array(F.collect_set(F.when(F.expr(condition), F.col("node"))))
        return F.array_join(found, ",").alias(alias)

    return reached.groupBy("dataset").agg(names("depth = 1", "target_table"), names("depth > 1", "downstream"))

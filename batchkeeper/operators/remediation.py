"""The one approved repair, its verification and its rollback. These functions run jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.operators.incidents import FAILED, REMEDIATED
from batchkeeper.operators.keys import dedupe_latest, duplicate_excess, with_previous
from batchkeeper.sources.tables import backup_partition, load_fact_partition, read_fact, restore_partition

# Legal moves of an incident; None is the start.
TRANSITIONS = (
    (None, "open"),
    ("open", "escalated"),
    ("open", "pending_approval"),
    ("open", "remediation_pending"),
    ("escalated", "pending_approval"),
    ("escalated", "remediation_pending"),
    ("escalated", "declined"),
    ("pending_approval", "remediation_pending"),
    ("pending_approval", "declined"),
    ("remediation_pending", "remediated"),
    ("remediation_pending", "remediation_failed"),
    ("remediation_failed", "escalated"),
    ("remediation_pending", "accepted"),
    ("escalated", "closed"),
    ("pending_approval", "closed"),
    ("remediated", "closed"),
    ("declined", "closed"),
    ("accepted", "closed"),
    ("closed", "open"),
)


def duplicate_days(spark: SparkSession, path: str, day: str, key: Sequence[str]) -> list[str]:
    """Days of a table that hold duplicate keys; one short string per day reaches the driver."""
    report = duplicate_excess(spark.read.parquet(path), key, by=[day]).filter(F.col("excess") > 0)
    return sorted(str(row[0]) for row in report.select(day).collect() if row[0] is not None)


def remediate_duplicates(
    spark: SparkSession,
    path: str,
    backup: str,
    day: str,
    key: Sequence[str],
    newest_by: Sequence[str],
    days: Sequence[str],
    cluster_by: Sequence[str] = (),
) -> None:
    """Back up the affected days, then rewrite each without duplicates.

    Reads from the backup and writes to the table, so nothing is overwritten while it
    is being read, and a crash between the two steps can simply be run again.
    """
    backup_partition(spark, path, backup, day, days, cluster_by)
    # the day is part of the key: the same key on another day is another row
    repaired = dedupe_latest(read_fact(spark, backup, day, days), [day, *[k for k in key if k != day]], newest_by)
    load_fact_partition(repaired, path, day, cluster_by, days=days)


def verify_days(spark: SparkSession, path: str, day: str, key: Sequence[str], days: Sequence[str]) -> DataFrame:
    """Rerun the check that flagged the incident, on the repaired days only."""
    checked = duplicate_excess(read_fact(spark, path, day, days), key, by=[day])
    return checked.select(F.col(day).alias("batch_date"), "n_rows", "excess", (F.col("excess") == 0).alias("passed"))


def repair_and_verify(
    spark: SparkSession,
    path: str,
    backup: str,
    day: str,
    key: Sequence[str],
    newest_by: Sequence[str],
    days: Sequence[str],
    cluster_by: Sequence[str] = (),
) -> list[tuple[str, str]]:
    """Repair, recheck, and put back every day that still fails: [(day, outcome)]."""
    if not days:
        return []
    remediate_duplicates(spark, path, backup, day, key, newest_by, days, cluster_by)
    verdicts = {str(r["batch_date"]): r["passed"] for r in verify_days(spark, path, day, key, days).collect()}
    still_bad = [d for d in days if not verdicts.get(d, False)]
    if still_bad:
        restore_partition(spark, path, backup, day, still_bad, cluster_by)
    return [(d, FAILED if d in still_bad else REMEDIATED) for d in days]


def post_verification(incidents: DataFrame, recheck: DataFrame) -> DataFrame:
    """Join incidents with the rerun of their own check; a missing recheck is a failed one.

    ``recheck(dataset, batch_date, check_name, passed)``.
    """
    again = recheck.select(
        F.col("dataset").alias("r_dataset"),
        F.col("batch_date").alias("r_date"),
        F.col("check_name").alias("r_check"),
        F.col("passed").alias("r_passed"),
    )
    on = (
        (F.col("dataset") == F.col("r_dataset"))
        & F.col("execution_date").eqNullSafe(F.col("r_date"))
        & (F.col("check_name") == F.col("r_check"))
    )
    ok = F.coalesce(F.col("r_passed"), F.lit(False))
    return incidents.join(again, on, "left").select(
        *[c for c in incidents.columns if c != "status"],
        ok.alias("verified"),
        F.when(ok, REMEDIATED).otherwise(FAILED).alias("status"),
    )


def audit_rows(incidents: DataFrame, state: str, at, job_id: str) -> DataFrame:
    """Audit-trail rows for incidents entering a state."""
    action = F.col("action") if "action" in incidents.columns else F.lit(None).cast("string")
    evidence = F.to_json("evidence") if "evidence" in incidents.columns else F.lit(None).cast("string")
    return incidents.select(
        "incident_id",
        F.col("dag_id").alias("dag_run_id"),
        F.lit(state).alias("state"),
        evidence.alias("evidence_collected"),
        action.alias("selected_action"),
        F.lit(job_id).alias("remediation_job_id"),
        F.lit(at).cast("timestamp").alias("at"),
    )


def audit_transitions(audit: DataFrame, tie_break: Sequence[str] = ("state",)) -> DataFrame:
    """Every logged step with its predecessor and whether the move is legal."""
    legal = F.lit(False)
    for before, after in TRANSITIONS:
        was = F.col("previous").isNull() if before is None else F.col("previous") == before
        legal = legal | (F.coalesce(was, F.lit(False)) & (F.col("state") == after))
    steps = with_previous(audit, ["incident_id"], ["at", *tie_break], "state", F.date_trunc("hour", "at"))
    return steps.withColumn("legal", legal)

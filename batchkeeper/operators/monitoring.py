"""Run history, incident states and the figures an operator looks at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchkeeper.functions.scalars import money, seconds_between
from batchkeeper.operators.checks import check_row, rows_of

# (class, pattern in the task log): operational errors that a plain retry cures.
TRANSIENT_LOGS = (
    ("timeout", r"(?i)time[d]?[ -]?out"),
    ("lock", r"(?i)lock"),
    ("rate_limit", r"(?i)rate[ -]?limit"),
    ("connection", r"(?i)connection (reset|refused)|temporarily unavailable"),
)


def transient_class(log: Column) -> Column:
    """Kind of operational error a log shows, NULL for none."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TRANSIENT_LOGS):
        found = F.when(log.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def retry_outcome(
    runs: DataFrame, max_retries: int, keys: Sequence[str] = ("task_id", "execution_date")
) -> DataFrame:
    """Per task and date: tries, failures, trailing failures and whether retries ran out.

    ``runs``: keys, ``at`` (unique order within a key) and ``failed``. Only
    aggregates, no ranking window: the newest success is found with map-side
    combination, and the failures after it are counted in a second pass against that one
    row per key.
    """
    w_key = list(keys)
    ends = runs.groupBy(*w_key).agg(
        F.count(F.lit(1)).alias("n_tries"),
        F.count_if("failed").alias("n_failed"),
        F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_success"),
    )
    successes = ends.select(*w_key, "last_success")
    after = F.col("last_success").isNull() | (F.col("at") > F.col("last_success"))
    trailing = (
        runs.filter("failed").join(successes, w_key).filter(after)
        .groupBy(*w_key).agg(F.count(F.lit(1)).alias("trailing_failures"))
    )
    n = F.coalesce(F.col("trailing_failures"), F.lit(0))
    outcome = (
        F.when((n == 0) & (F.col("n_failed") > 0), "recovered")
        .when(n == 0, "clean")
        .when(n > max_retries, "exhausted")
        .otherwise("retrying")
    )
    return ends.join(trailing, w_key, "left").select(
        *w_key, "n_tries", "n_failed", n.alias("trailing_failures"), outcome.alias("outcome")
    )


def failure_class(runs: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("task_id", "execution_date")) -> DataFrame:
    """Failed runs as transient (retry) or data fault, per key; data faults and exhausted retries need an incident.

    ``runs``: keys, ``failed``, ``log_text``.
    """
    w_key = list(keys)
    kind = transient_class(F.col("log_text"))
    logs = runs.filter("failed").groupBy(*w_key).agg(
        F.count(kind).alias("n_transient"), F.count_if(kind.isNull()).alias("n_data_fault")
    )
    verdict = (
        F.when(F.col("n_data_fault") > 0, "data_fault")
        .when(F.col("outcome") == "exhausted", "exhausted_retries")
        .otherwise("transient")
    )
    joined = logs.join(outcomes.select(*w_key, "outcome"), w_key)
    return joined.select(
        *w_key, "n_transient", "n_data_fault", verdict.alias("verdict"),
        (verdict != "transient").alias("needs_incident"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """One row: active runs, last completed run, success rate over finished runs, overall state.

    ``runs``: ``state`` (running, success, failed) and ``at``.
    """
    state = F.col("state")
    finished = state.isin("success", "failed")
    ok = F.count_if(state == "success")
    done = F.count_if(finished)
    totals = runs.agg(
        F.count_if(state == "running").alias("active_runs"),
        F.max(F.when(finished, F.col("at"))).alias("last_completed_run"),
        ok.alias("n_succeeded"),
        done.alias("n_finished"),
        F.max(F.when(finished, F.struct("at", "state"))).alias("_last"),
    )
    success = F.when(F.col("n_finished") > 0, F.col("n_succeeded") / F.col("n_finished"))
    status = F.when(F.col("n_finished") == 0, "idle").when(F.col("_last.state") == "failed", "failed").otherwise("healthy")
    return totals.select(
        status.alias("status"), "active_runs", "last_completed_run", success.alias("success_rate")
    )


def run_checks(failures: DataFrame, task: str = "task_id", date: str = "execution_date") -> DataFrame:
    """:func:`failure_class` as check rows, one per task and date, so that run history opens incidents like any check.

    The metric counts failed runs. A failure that retries have mended passes; a data fault or exhausted retries do not.
    No policy covers them, so they escalate.
    """
    keyed = failures.withColumn("dataset", F.col(task).cast("string")).withColumn("batch_date", F.col(date).cast("date"))
    evidence = "concat(verdict, ': data faults=', n_data_fault, ' transient=', n_transient)"
    bad = "if(coalesce(needs_incident, true), n_data_fault + n_transient, 0)"
    passed = "NOT coalesce(needs_incident, true)"
    return rows_of(keyed, check_row("task_runs", "NULL", "n_data_fault + n_transient", passed, bad, evidence))


def current_state(audit: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """Fold the append-only log to each incident's latest state; equal times go by state rank."""
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    step = F.struct("at", F.coalesce(F.try_element_at(rank, F.col("state")), F.lit(-1)).alias("rank"), "state")
    return audit.groupBy("incident_id").agg(
        F.max(step).alias("_latest"), F.count(F.lit(1)).alias("n_steps")
    ).select("incident_id", F.col("_latest.state").alias("state"), F.col("_latest.at").alias("at"), "n_steps")


def time_to_resolution(audit: DataFrame, opened: str, closed: str) -> DataFrame:
    """Mean, median and longest time from the first opening to the last success, in seconds.

    The median counts whole seconds, so its state is bounded by the horizon of the log
    and not by the number of incidents.
    """
    per_incident = audit.groupBy("incident_id").agg(
        F.min(F.when(F.col("state") == opened, F.col("at"))).alias("opened_at"),
        F.max(F.when(F.col("state") == closed, F.col("at"))).alias("closed_at"),
    )
    resolved = per_incident.filter(F.col("closed_at") > F.col("opened_at"))
    seconds = F.floor(seconds_between(F.col("opened_at"), F.col("closed_at")))
    return resolved.select(seconds.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_resolved"),
        (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean_seconds"),
        F.percentile("s", F.lit(0.5), F.col("n")).alias("p50_seconds"),
        F.max("s").alias("max_seconds"),
    )


def incident_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("failure_category", "status", "severity").agg(F.count(F.lit(1)).alias("n_incidents"))


def incident_list(incidents: DataFrame) -> DataFrame:
    """Newest first; equal dates by id, so that pages are stable."""
    return incidents.orderBy(F.desc("execution_date"), "incident_id")


def daily_volume(counts: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """One row per batch date and one column per dataset. ``counts(dataset, batch_date, n_rows)``."""
    return counts.groupBy("batch_date").pivot("dataset", list(datasets)).agg(F.sum("n_rows")).fillna(0, list(datasets))


def daily_sales_summary(
    orders: DataFrame, items: DataFrame, day: str, key: str, item_key: str, total: str, status: str,
    reversed_status: Sequence[str], quantity: str,
) -> DataFrame:
    """Per day: orders, units, revenue, and apart from it the revenue of reversed orders.

    Units are added up per order before the join, so the wide item table meets the
    orders as one row per order.
    """
    units = items.groupBy(F.col(item_key).alias(key)).agg(F.sum(money(F.col(quantity))).alias("units"))
    joined = orders.join(units, key, "left")
    undone = F.col(status).isin(*reversed_status)
    amount = money(F.col(total))
    return joined.groupBy(F.to_date(F.col(day)).alias("day")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.coalesce(F.sum("units").cast("double"), F.lit(0.0)).alias("units"),
        F.sum(amount).cast("double").alias("revenue"),
        F.coalesce(F.sum(F.when(undone, amount)).cast("double"), F.lit(0.0)).alias("reversed_revenue"),
    )


def executions(checks: DataFrame, run_id: str) -> DataFrame:
    """Outcome of a run per dataset and check: facts judged, failures, rows seen bad."""
    return checks.groupBy("dataset", "check_name").agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("n_failed"),
        F.sum("n_bad").alias("n_bad"),
    ).withColumn("run_id", F.lit(run_id))


"""Registered queries: batches against their history, run history and operator figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from batchkeeper.contract import policy_frame
from batchkeeper.operators import baselines, checks, faults, incidents, monitoring, remediation, watch
from batchkeeper.plans import inputs
from batchkeeper.plans.inputs import FAULTY_SQL, tidy
from batchkeeper.plans.registry import query
from batchkeeper.retail import POLICY
from batchkeeper.session import materialize, new_scratch
from batchkeeper.sources import tables

COUNTS_SQL = (
    FAULTY_SQL
    + """,
counts AS (
  SELECT 'events' AS dataset, CAST(ts AS DATE) AS batch_date, count(*) AS n FROM f_events GROUP BY 2
  UNION ALL
  SELECT 'orders', CAST(date_trunc('month', o_orderdate) AS DATE), count(*) FROM f_orders GROUP BY 2)"""
)


def _counts(spark, sf):
    daily = checks.batch_counts(inputs.faulty_events(spark, sf), "events", "batch_date")
    return daily.unionByName(checks.batch_counts(inputs.faulty_orders(spark, sf), "orders", "batch_date"))


@query(
    "volume_three_sigma",
    "WITH "
    + COUNTS_SQL
    + """,
b AS (SELECT *, count(n) OVER w AS n_prior, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd FROM counts
  WINDOW w AS (PARTITION BY dataset ORDER BY batch_date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT dataset, batch_date, n AS n_rows, n_prior, round(mean, 6) AS mean, round(sd, 6) AS sd,
  CASE WHEN n_prior < 2 THEN 'insufficient_history' WHEN n > mean + 3 * sd THEN 'spike'
       WHEN n < mean - 3 * sd THEN 'drop' ELSE 'ok' END AS status
FROM b""",
)
def volume_three_sigma(spark, sf):
    return tidy(baselines.three_sigma(_counts(spark, sf), 14))


@query(
    "volume_vs_median",
    "WITH "
    + COUNTS_SQL
    + """,
b AS (SELECT *, quantile_cont(n, 0.5) OVER w AS m FROM counts
  WINDOW w AS (PARTITION BY dataset ORDER BY batch_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT dataset, batch_date, n AS n_rows, CAST(m AS DOUBLE) AS median, round(CAST(n AS DOUBLE) / m - 1, 6) AS deviation,
  abs(CAST(n AS DOUBLE) / m - 1) <= 0.2e0 AS passed
FROM b""",
)
def volume_vs_median(spark, sf):
    return tidy(baselines.vs_trailing_median(_counts(spark, sf), 7, 0.2))


@query(
    "volume_deviation",
    "WITH "
    + COUNTS_SQL
    + """,
b AS (SELECT *, avg(n) OVER (PARTITION BY dataset) * 0.8e0 AS lower, avg(n) OVER (PARTITION BY dataset) * 1.2e0 AS upper
  FROM counts)
SELECT dataset, batch_date, n AS n_rows, round(lower, 6) AS lower, round(upper, 6) AS upper,
  CAST(trunc(CASE WHEN n > upper THEN (n - upper) * 100.0e0 / upper WHEN n < lower THEN (n - lower) * 100.0e0 / lower
    ELSE 0 END) AS BIGINT) AS deviation_pct
FROM b""",
)
def volume_deviation(spark, sf):
    return tidy(baselines.volume_deviation(checks.relative_bounds(_counts(spark, sf), 0.2, 0.2)))


@query(
    "seven_day_history",
    """WITH d AS (SELECT CAST(ts AS DATE) AS batch_date, count(*) AS n FROM events GROUP BY 1),
b AS (SELECT *, avg(n) OVER (ORDER BY batch_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS running,
  avg(n) OVER () * 0.96e0 AS lower, avg(n) OVER () * 1.04e0 AS upper,
  row_number() OVER (ORDER BY batch_date DESC) AS back FROM d)
SELECT 'events' AS dataset, batch_date, n AS n_rows, round(running, 6) AS running_mean,
  CASE WHEN n BETWEEN lower AND upper THEN 'healthy' ELSE 'anomaly' END AS status
FROM b WHERE back <= 7""",
)
def seven_day_history(spark, sf):
    counts = checks.batch_counts(inputs.events(spark, sf), "events", "batch_date")
    return tidy(baselines.seven_day_history(checks.relative_bounds(counts, 0.04, 0.04)))


HOLT_SQL = """WITH RECURSIVE s AS (
  SELECT event_type AS dataset, CAST(ts AS DATE) AS batch_date, CAST(count(*) AS DOUBLE) AS y,
    row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS i FROM events GROUP BY 1, 2),
r(dataset, i, batch_date, y, forecast, level, trend) AS (
  SELECT dataset, i, batch_date, y, CAST(NULL AS DOUBLE), y, 0.0e0 FROM s WHERE i = 1
  UNION ALL
  SELECT s.dataset, s.i, s.batch_date, s.y, level + trend, 0.3217e0 * s.y + (1 - 0.3217e0) * (level + trend),
    0.2113e0 * ((0.3217e0 * s.y + (1 - 0.3217e0) * (level + trend)) - level) + (1 - 0.2113e0) * trend
  FROM r JOIN s ON s.dataset = r.dataset AND s.i = r.i + 1)"""


@query(
    "holt_forecast",
    HOLT_SQL + """
SELECT dataset, batch_date, CAST(y AS BIGINT) AS n_rows, round(forecast, 6) AS forecast, round(y - forecast, 6) AS residual
FROM r""",
)
def holt_forecast(spark, sf):
    daily = inputs.events(spark, sf).groupBy(F.col("event_type").alias("dataset"), "batch_date")
    return tidy(baselines.holt_forecast(daily.agg(F.count(F.lit(1)).alias("n_rows")), 0.3217, 0.2113))


@query(
    "holt_state",
    HOLT_SQL + """
SELECT dataset, batch_date, CAST(y AS BIGINT) AS n_rows, round(forecast, 6) AS forecast, round(y - forecast, 6) AS residual,
  round(level, 6) AS level, round(trend, 6) AS trend FROM r""",
)
def holt_state(spark, sf):
    """The same forecasts, advanced from a stored state: twenty days at once, then one day, that day again, and the rest."""
    daily = inputs.events(spark, sf).groupBy(F.col("event_type").alias("dataset"), "batch_date")
    series = materialize(daily.agg(F.count(F.lit(1)).alias("n_rows")), "daily")
    path, steps = new_scratch(spark, "holt"), {}
    for ds in ("2024-01-20", "2024-01-21", "2024-01-21", "9999-12-31"):
        upto = series.filter(F.col("batch_date") <= F.lit(ds).cast("date"))
        state = tables.read_state(spark, path, ds, baselines.STATE)
        steps[ds] = materialize(baselines.holt_advance(state, upto, 0.3217, 0.2113), "steps")
        tables.write_state(baselines.next_state(state, steps[ds]), path, ds)
    return tidy(reduce(lambda a, b: a.unionByName(b), steps.values()))


@query(
    "static_source",
    """WITH b AS (SELECT CAST(ts AS DATE) AS batch_date,
  max(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-20' THEN ts - INTERVAL 2 DAY ELSE ts END) AS m FROM events GROUP BY 1),
p AS (SELECT *, max(m) OVER (ORDER BY batch_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b)
SELECT 'events' AS dataset, batch_date, strftime(m, '%Y-%m-%d %H:%M:%S') AS max_ts,
  strftime(p, '%Y-%m-%d %H:%M:%S') AS previous_max, coalesce(m <= p, FALSE) AS static
FROM p""",
)
def static_source(spark, sf):
    stale_day = F.col("batch_date") == F.lit("2024-01-20").cast("date")
    events = faults.make_stale(inputs.events(spark, sf), "ts", stale_day, 2)
    batches = events.groupBy("batch_date").agg(F.max("ts").alias("max_ts")).withColumn("dataset", F.lit("events"))
    return tidy(baselines.static_source(batches))


@query(
    "daily_checks",
    """WITH f AS (SELECT CAST(ts AS DATE) AS d, event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-20' THEN ts - INTERVAL 2 DAY ELSE ts END AS ts,
  CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' AND event_id % 3 = 0 THEN NULL ELSE event_id END AS k FROM events),
b AS (SELECT d, count(*) AS n, (count(*) - count(k)) * 1.0e0 / count(*) AS r, max(ts) AS m FROM f
  WHERE d <> DATE '2024-01-12' OR event_id % 5 = 0 GROUP BY d),
w AS (SELECT *, avg(r) OVER t AS u, quantile_cont(n, 0.5) OVER t AS q, max(m) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM b WINDOW t AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT d AS batch_date, 'null_spike' AS check_name, round(r, 6) AS metric, round(greatest(0.005e0, 3e0 * u), 6) AS upper,
  coalesce(NOT (r > 0.005e0 AND r > 3e0 * u), TRUE) AS passed FROM w
UNION ALL SELECT d, 'volume_median', CAST(n AS DOUBLE), round(CAST(q AS DOUBLE) * 1.3e0, 6), coalesce(abs(CAST(n AS DOUBLE) / q - 1) <= 0.3e0, TRUE) FROM w
UNION ALL SELECT d, 'static_source', round(date_diff('microsecond', p, m) / 3.6e9, 6), NULL, coalesce(m > p, TRUE) FROM w
UNION ALL SELECT d, 'landing_sla', round(date_diff('microsecond', CAST(d AS TIMESTAMP), max(m) + INTERVAL 125 MINUTE) / 3.6e9, 6), 26e0,
  date_diff('microsecond', CAST(d AS TIMESTAMP), max(m) + INTERVAL 125 MINUTE) / 3.6e9 <= 26 FROM w GROUP BY d""",
)
def daily_checks(spark, sf):
    """Events of a day cut short, one with blanked ids and one sent with old times, each day against the days before it."""

    def on(day):
        return F.col("batch_date") == F.lit(day).cast("date")

    events = inputs.events(spark, sf).withColumn("key", F.col("event_id"))
    events = faults.blank(events, "key", on("2024-01-15") & (F.col("event_id") % 3 == 0))
    events = events.filter(~on("2024-01-12") | (F.col("event_id") % 5 == 0))
    events = faults.make_stale(events, "ts", on("2024-01-20"), 2)
    profile = materialize(checks.batch_profile(events, "events", "batch_date", [], ["key"], ts="ts"), "profile")
    as_of = "2025-01-01 00:00:00"
    counted = profile.withColumns({"lower": F.lit(0.0), "upper": F.lit(None).cast("double")})
    rows = checks.rows_of(counted, checks.null_rate_row("key", 1.0), checks.row_count_row(), checks.freshness_row("ts", as_of, 1e6))
    log = rows.withColumn("as_of", F.lit(as_of).cast("timestamp"))
    landed = profile.select("dataset", "batch_date", (F.col("max_ts").cast("timestamp") + F.expr("interval 125 minutes")).alias("landed_at"))
    judged = watch.watched(log, watch.Watch(7, 3.0, 0.005, 0.3, 26), landed)
    return tidy(judged.select("batch_date", "check_name", "metric", "upper", "passed"))


@query(
    "daily_volume",
    """WITH c AS (
  SELECT 'events' AS d, CAST(date_trunc('month', ts) AS DATE) AS batch_date, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'orders', CAST(date_trunc('month', o_orderdate) AS DATE), count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'lineitem', CAST(date_trunc('month', l_shipdate) AS DATE), count(*) FROM lineitem GROUP BY 2)
SELECT batch_date, CAST(coalesce(sum(n) FILTER (WHERE d = 'orders'), 0) AS BIGINT) AS orders,
  CAST(coalesce(sum(n) FILTER (WHERE d = 'lineitem'), 0) AS BIGINT) AS lineitem,
  CAST(coalesce(sum(n) FILTER (WHERE d = 'events'), 0) AS BIGINT) AS events
FROM c GROUP BY batch_date""",
)
def daily_volume(spark, sf):
    events = inputs.table(spark, sf, "events").withColumn("batch_date", inputs.month("ts"))
    counts = checks.batch_counts(events, "events", "batch_date")
    counts = counts.unionByName(checks.batch_counts(inputs.orders(spark, sf), "orders", "batch_date"))
    counts = counts.unionByName(checks.batch_counts(inputs.items(spark, sf), "lineitem", "batch_date"))
    return monitoring.daily_volume(counts, ["orders", "lineitem", "events"])


@query(
    "daily_sales_summary",
    """WITH u AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(28, 2))) AS units FROM lineitem GROUP BY 1)
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_orders, coalesce(CAST(sum(units) AS DOUBLE), 0) AS units,
  CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS DOUBLE) AS revenue,
  coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE), 0)
    AS reversed_revenue
FROM orders LEFT JOIN u ON o_orderkey = l_orderkey GROUP BY 1""",
)
def daily_sales_summary(spark, sf):
    return monitoring.daily_sales_summary(
        inputs.table(spark, sf, "orders"), inputs.table(spark, sf, "lineitem"),
        "o_orderdate", "o_orderkey", "l_orderkey", "o_totalprice", "o_orderstatus", ["P"], "l_quantity",
    )


# --- run history: the event table stands in for task runs --------------------


def _runs(spark, sf):
    """task = user, date = day, order = event id, failed = error event; the log text comes from the payload."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    log = (
        F.when(k % 4 == 0, "Read timed out after 30 s")
        .when(k % 4 == 1, "could not obtain lock on staging")
        .when(k % 4 == 2, "API rate limit reached")
        .otherwise("row count outside bounds")
    )
    kind = F.col("event_type")
    state = F.when(kind == "error", "failed").when(kind == "signup", "running").otherwise("success")
    return inputs.events(spark, sf).select(
        F.col("user_id").alias("task_id"), F.col("batch_date").alias("execution_date"), F.col("event_id").alias("at"),
        F.col("ts"), state.alias("state"), (kind == "error").alias("failed"), log.alias("log_text"),
    )


RUNS_SQL = """runs AS (
  SELECT user_id AS task_id, CAST(ts AS DATE) AS execution_date, event_id AS run_no, ts,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS state,
    event_type = 'error' AS failed,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 <> 3 AS transient
  FROM events),
ends AS (
  SELECT task_id, execution_date, count(*) AS n_tries, count(*) FILTER (WHERE failed) AS n_failed,
    max(run_no) FILTER (WHERE NOT failed) AS ok FROM runs GROUP BY 1, 2),
after_ok AS (
  SELECT r.task_id, r.execution_date, count(*) AS n FROM runs r
  JOIN ends e ON r.task_id = e.task_id AND r.execution_date = e.execution_date
  WHERE failed AND (ok IS NULL OR run_no > ok) GROUP BY 1, 2),
outcomes AS (
  SELECT e.task_id, e.execution_date, n_tries, n_failed, coalesce(n, 0) AS trailing_failures,
    CASE WHEN coalesce(n, 0) = 0 AND n_failed > 0 THEN 'recovered' WHEN coalesce(n, 0) = 0 THEN 'clean'
         WHEN n > 2 THEN 'exhausted' ELSE 'retrying' END AS outcome
  FROM ends e LEFT JOIN after_ok t ON t.task_id = e.task_id AND t.execution_date = e.execution_date)"""


@query("retry_exhausted", "WITH " + RUNS_SQL + " SELECT * FROM outcomes")
def retry_exhausted(spark, sf):
    return monitoring.retry_outcome(_runs(spark, sf), 2)


@query(
    "failure_class",
    "WITH "
    + RUNS_SQL
    + """,
logs AS (SELECT task_id, execution_date, count(*) FILTER (WHERE transient) AS n_transient,
  count(*) FILTER (WHERE NOT transient) AS n_data_fault FROM runs WHERE failed GROUP BY 1, 2),
v AS (SELECT l.*, CASE WHEN n_data_fault > 0 THEN 'data_fault' WHEN outcome = 'exhausted' THEN 'exhausted_retries'
  ELSE 'transient' END AS verdict
  FROM logs l JOIN outcomes o ON l.task_id = o.task_id AND l.execution_date = o.execution_date)
SELECT task_id, execution_date, n_transient, n_data_fault, verdict, verdict <> 'transient' AS needs_incident FROM v""",
)
def failure_class(spark, sf):
    runs = _runs(spark, sf)
    return monitoring.failure_class(runs, monitoring.retry_outcome(runs, 2))


@query(
    "run_incidents",
    "WITH "
    + RUNS_SQL
    + """,
logs AS (SELECT task_id, execution_date, count(*) FILTER (WHERE transient) AS n_transient,
  count(*) FILTER (WHERE NOT transient) AS n_data_fault FROM runs WHERE failed GROUP BY 1, 2),
v AS (SELECT l.*, CASE WHEN n_data_fault > 0 THEN 'data_fault' WHEN outcome = 'exhausted' THEN 'exhausted_retries'
  ELSE 'transient' END AS verdict
  FROM logs l JOIN outcomes o ON l.task_id = o.task_id AND l.execution_date = o.execution_date)
SELECT 'INC-' || strftime(execution_date, '%Y%m%d') || '-' || substr(sha256(CAST(task_id AS VARCHAR) || '|task_runs|'), 1, 8) AS incident_id,
  CAST(task_id AS VARCHAR) AS dataset, CAST(execution_date AS DATE) AS execution_date, 'unclassified' AS failure_category,
  n_data_fault + n_transient AS n_bad, 'task_runs failed on ' || task_id || ' ' || verdict || ': data faults=' || n_data_fault
    || ' transient=' || n_transient AS error_message, 'escalate' AS decision
FROM v WHERE verdict <> 'transient'""",
)
def run_incidents(spark, sf):
    """The run history as decided incidents."""
    runs = _runs(spark, sf)
    rows = monitoring.run_checks(monitoring.failure_class(runs, monitoring.retry_outcome(runs, 2)))
    return incidents.triage(rows, policy_frame(spark, POLICY), "daily_batches").select(
        "incident_id", "dataset", "execution_date", "failure_category", "n_bad", "error_message", "decision"
    )


@query(
    "run_status",
    "WITH "
    + RUNS_SQL
    + """
SELECT CASE WHEN arg_max(state, run_no) FILTER (WHERE state <> 'running') = 'failed' THEN 'failed' ELSE 'healthy' END AS status,
  count(*) FILTER (WHERE state = 'running') AS active_runs,
  strftime(max(ts) FILTER (WHERE state <> 'running'), '%Y-%m-%d %H:%M:%S') AS last_completed_run,
  round(count(*) FILTER (WHERE state = 'success') * 1.0e0 / count(*) FILTER (WHERE state <> 'running'), 6) AS success_rate
FROM runs""",
)
def run_status(spark, sf):
    return tidy(monitoring.run_status(_runs(spark, sf).withColumn("at", F.col("ts"))))


# --- audit log: the event table stands in for incident steps -----------------

STATE_OF = {
    "click": "open",
    "view": "escalated",
    "signup": "remediation_pending",
    "purchase": "remediated",
    "error": "remediation_failed",
}
RANKS = {state: i for i, state in enumerate(STATE_OF.values())}

AUDIT_SQL = (
    "audit AS (SELECT user_id AS incident_id, event_id, ts AS seen_at, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in STATE_OF.items())
    + " END AS state, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN {RANKS[s]}" for e, s in STATE_OF.items())
    + " END AS rank FROM events)"
)


def _audit(spark, sf):
    state = F.create_map(*[F.lit(x) for pair in STATE_OF.items() for x in pair])
    return inputs.table(spark, sf, "events").select(
        F.col("user_id").alias("incident_id"), "event_id", F.col("ts").cast("timestamp").alias("at"),
        F.try_element_at(state, F.col("event_type")).alias("state"),
    )


@query(
    "incident_state",
    "WITH "
    + AUDIT_SQL
    + """,
x AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seen_at DESC, rank DESC) AS rn,
  count(*) OVER (PARTITION BY incident_id) AS n_steps FROM audit)
SELECT incident_id, state, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS last_at, n_steps FROM x WHERE rn = 1""",
)
def incident_state(spark, sf):
    return tidy(monitoring.current_state(_audit(spark, sf), RANKS)).withColumnRenamed("at", "last_at")


@query(
    "audit_valid",
    "WITH "
    + AUDIT_SQL
    + """,
x AS (SELECT *, lag(state) OVER (PARTITION BY incident_id ORDER BY seen_at, event_id) AS previous FROM audit)
SELECT incident_id, event_id, state, previous,
  CASE WHEN previous IS NULL THEN state = 'open'
       WHEN previous = 'open' THEN state IN ('escalated', 'pending_approval', 'remediation_pending')
       WHEN previous = 'escalated' THEN state IN ('pending_approval', 'remediation_pending', 'declined')
       WHEN previous = 'remediation_pending' THEN state IN ('remediated', 'remediation_failed')
       WHEN previous = 'remediation_failed' THEN state = 'escalated'
       ELSE FALSE END AS legal
FROM x""",
)
def audit_valid(spark, sf):
    steps = remediation.audit_transitions(_audit(spark, sf), tie_break=["event_id"])
    return steps.select("incident_id", "event_id", "state", "previous", "legal")


@query(
    "mttr",
    "WITH "
    + AUDIT_SQL
    + """,
i AS (SELECT incident_id, min(seen_at) FILTER (WHERE state = 'open') AS o, max(seen_at) FILTER (WHERE state = 'remediated') AS c
  FROM audit GROUP BY 1),
s AS (SELECT CAST(floor(date_diff('microsecond', o, c) / 1e6) AS BIGINT) AS s FROM i WHERE c > o)
SELECT count(*) AS n_resolved, round(CAST(sum(s) AS DOUBLE) / count(*), 6) AS mean_seconds,
  CAST(quantile_cont(s, 0.5) AS DOUBLE) AS p50_seconds, max(s) AS max_seconds FROM s""",
)
def mttr(spark, sf):
    return tidy(monitoring.time_to_resolution(_audit(spark, sf), "open", "remediated"))

"""The daily run: stage, validate, decide, load, repair, verify.

Datasets go through as independent branches, so one broken batch halts itself only.
Only check results and incident rows (a few per dataset) steer the run from the
driver; the data stays in tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.contract import Contract, DatasetContract
from batchkeeper.functions.casting import CAST_ERROR, MALFORMED, cast_failure_share, cast_to_contract, well_formed
from batchkeeper.operators import baselines, checks, incidents, joins, keys, offenders, predicates, remediation, watch
from batchkeeper.session import configure, literal_table, materialize
from batchkeeper.sources import files, tables
from batchkeeper.sources.storage import exists

HISTORY_DAYS = 14


@dataclass(frozen=True)
class Layout:
    """Where things lie: the landing folder, and the folder that holds all tables."""

    landing: str
    warehouse: str

    def table(self, name: str) -> str:
        return f"{self.warehouse.rstrip('/')}/{name}"


@dataclass
class DayResult:
    checks: DataFrame
    incidents: DataFrame
    loaded: list[str] = field(default_factory=list)
    halted: list[str] = field(default_factory=list)
    repaired: list[str] = field(default_factory=list)


def _table(contract: DatasetContract) -> str:
    return contract.table or contract.name


def _types(contract: DatasetContract) -> dict[str, str]:
    return {c: contract.spark_type(c) for c in contract.columns}


def stage(spark: SparkSession, contract: DatasetContract, layout: Layout, ds: str) -> DataFrame | None:
    """The raw batch in staging; None when nothing has landed."""
    path = contract.path(layout.landing, ds)
    if not exists(spark, path):
        return None
    raw = (
        files.read_batch(spark, contract, layout.landing, ds)
        if contract.is_fact
        else files.read_dimension(spark, contract, layout.landing)
    )
    return spark.read.parquet(tables.write_staging(raw, layout.table("staging"), contract.name, ds))


def observed_schema(spark: SparkSession, contract: DatasetContract, staged: DataFrame, path: str) -> DataFrame:
    """(column_name, type, ordinal) as the batch itself gives them; text columns count as their declared type."""
    names = [c for c in staged.columns if c != MALFORMED]
    if path.endswith((".jsonl", ".json")):
        found = [row["field"] for row in files.json_fields(spark, path).collect()]  # one row per field name
        names = [c for c in contract.columns if c in found] + sorted(set(found) - set(contract.columns))
    rows = [(c, contract.schema.get(c, "string"), i) for i, c in enumerate(names)]
    return literal_table(spark, rows, "column_name string, type string, ordinal int")


def schema_checks(spark: SparkSession, contract: DatasetContract, staged: DataFrame, path: str, ds: str) -> DataFrame:
    declared = [(c, t, i) for i, (c, t) in enumerate(contract.schema.items())]
    expected = literal_table(spark, declared, "column_name string, type string, ordinal int")
    diff = checks.schema_diff(
        observed_schema(spark, contract, staged, path), expected, cast_failure_share(staged, _types(contract))
    )
    return checks.schema_check(diff, contract.name, ds)


def volume_history(spark: SparkSession, contract: DatasetContract, counts: DataFrame, log: str, ds: str) -> DataFrame:
    """Today's row count against the days before it in the check log."""
    since = str(date.fromisoformat(ds) - timedelta(days=HISTORY_DAYS))
    series = counts.select("dataset", "batch_date", "n_rows")
    if exists(spark, log):
        logged = spark.read.parquet(log).filter(
            (F.col("check_name") == "row_count")
            & (F.col("dataset") == contract.name)
            & (F.col("batch_date") >= F.lit(since).cast("date"))
            & (F.col("batch_date") < F.lit(ds).cast("date"))
            # a day is logged under its own date: only these folders are read
            & (F.col("run_date") >= F.lit(since).cast("date"))
            & (F.col("run_date") < F.lit(ds).cast("date"))
            # a day whose count was out of bounds is no example of a usual day
            & F.col("passed")
        )
        # the same day may have been run more than once: its latest run counts
        last = logged.groupBy("dataset", "batch_date").agg(F.max_by("metric", "ended_at").cast("bigint").alias("n_rows"))
        series = series.unionByName(last)
    judged = baselines.three_sigma(series, HISTORY_DAYS).filter(F.col("batch_date") == F.lit(ds).cast("date"))
    return checks.history_rows(judged)


def quality_checks(
    spark: SparkSession,
    contract: DatasetContract,
    typed: DataFrame,
    references: dict[str, DataFrame],
    log: str,
    ds: str,
    as_of: str,
) -> DataFrame:
    """Row count, nulls, duplicates, freshness and references of one staged batch.

    Malformed lines are no rows: the schema check reports them, and they are neither NULLs nor repeated keys here.
    """
    typed = well_formed(typed)
    batch = typed.withColumn("batch_date", F.lit(ds).cast("date"))
    present = set(typed.columns)
    key = [c for c in contract.primary_key if c in present]
    tolerance = {c: t for c, t in contract.null_tolerance.items() if c in present}
    ts = contract.ts_column if contract.ts_column in present else None
    profile = checks.expected_batches(
        checks.batch_profile(batch, contract.name, "batch_date", key, list(tolerance), ts=ts), contract.name, ds, ds
    )
    rows = [checks.null_rate_row(c, t) for c, t in tolerance.items()]
    if key and len(key) == len(contract.primary_key):
        rows.append(checks.duplicate_row(key))
    if contract.row_bounds:
        profile = profile.withColumns(
            {"lower": F.lit(float(contract.row_bounds.lower)), "upper": F.lit(float(contract.row_bounds.upper))}
        )
        rows.append(checks.row_count_row())
    parts = [checks.rows_of(profile, *rows)] if rows else []
    if ts and contract.max_delay_hours is not None:
        parts.append(checks.rows_of(profile, checks.freshness_row(ts, as_of, contract.max_delay_hours)))
    if contract.is_fact:
        parts.append(volume_history(spark, contract, profile, log, ds))
    rules = declared_rules(contract, present, ts)
    if rules:
        parts.append(checks.custom_rules(batch, contract.name, "batch_date", rules))
    for reference in contract.foreign_keys:
        dim = references.get(reference.ref_dataset)
        if dim is not None and reference.column in present and reference.ref_column in dim.columns:
            report = joins.fk_report(batch, reference.column, dim, reference.ref_column, by=["batch_date"])
            parts.append(checks.fk_check(report.withColumn("dataset", F.lit(contract.name)), reference.column))
    return checks.union_checks(*parts)


def declared_rules(contract: DatasetContract, present: set[str], ts: str | None) -> list[checks.Rule]:
    """Rules of one aggregation: no rows of another day, and no value outside a declared domain."""
    rules = []
    if contract.is_fact and ts:
        rules.append(checks.Rule("stray_rows", "count(*)", upper=0, where=f"NOT (to_date(`{ts}`) <=> batch_date)", column=ts))
    for column, values in contract.accepted_values.items():
        if column in present:
            known = ", ".join(checks.quoted(v) for v in values)
            outside = f"`{column}` IS NOT NULL AND `{column}` NOT IN ({known})"
            rules.append(checks.Rule("accepted_values", "count(*)", upper=0, where=outside, column=column))
    return rules


def against_past(
    spark: SparkSession,
    contract: Contract,
    layout: Layout,
    found: DataFrame,
    limits: watch.Watch,
    ds: str,
    as_of: str,
    names: Sequence[str],
) -> DataFrame:
    """The day's facts against the days before it in the check log."""
    facts = [n for n in names if contract[n].is_fact]
    columns = ["dataset", "batch_date", "check_name", "column_name", "metric", "passed", "as_of"]
    today = found.filter(F.col("dataset").isin(facts)).withColumn("as_of", F.lit(as_of).cast("timestamp")).select(*columns)
    log, day = layout.table("executions"), F.lit(ds).cast("date")
    if exists(spark, log):
        since = F.lit(str(date.fromisoformat(ds) - timedelta(days=limits.days))).cast("date")
        past = spark.read.parquet(log).filter(
            F.col("dataset").isin(facts) & (F.col("run_date") >= since) & (F.col("run_date") < day)
            & (F.col("batch_date") >= since) & (F.col("batch_date") < day)
            # what failed is no example of a usual day, but a late row is the newest all the same
            & (F.col("passed") | (F.col("check_name") == "freshness"))
        )
        # the same day may have been run more than once: its latest run counts
        key = ["dataset", "batch_date", "check_name", "column_name"]
        last = past.groupBy(*key).agg(F.max_by(F.struct("metric", "passed", "ended_at"), "ended_at").alias("last"))
        today = today.unionByName(last.select(*key, "last.metric", "last.passed", F.col("last.ended_at").alias("as_of")))
    arrivals = None
    if limits.landing_hours is not None and facts:
        arrivals = reduce(lambda a, b: a.unionByName(b), [files.landings(spark, contract[n], layout.landing, ds, ds) for n in facts])
    return watch.watched(today, limits, arrivals).filter(F.col("batch_date") == day)


def missing_batch(spark: SparkSession, contract: DatasetContract, ds: str) -> DataFrame:
    """The check rows of a batch that never landed."""
    bounds = contract.row_bounds
    row = spark.range(1).select(
        F.lit(contract.name).alias("dataset"),
        F.lit(ds).cast("date").alias("batch_date"),
        F.lit(0).cast("bigint").alias("n_rows"),
        F.lit(float(bounds.lower) if bounds else 1.0).alias("lower"),
        F.lit(float(bounds.upper) if bounds else None).cast("double").alias("upper"),
    )
    return checks.row_count_check(row)


def _references(spark: SparkSession, contract: Contract, layout: Layout, typed: dict[str, DataFrame]) -> dict:
    """Dimensions to check against: this run's if among ``typed`` and usable, else the last published ones."""
    out = {}
    for name in {k.ref_dataset for d in contract.datasets.values() for k in d.foreign_keys}:
        wanted = {
            k.ref_column for d in contract.datasets.values() for k in d.foreign_keys if k.ref_dataset == name
        }
        if name in typed and wanted <= set(typed[name].columns):
            out[name] = typed[name]
            continue
        published = layout.table(_table(contract[name]))
        if exists(spark, published):
            out[name] = tables.read_dimension_table(spark, published)
    return out


def validate_day(
    spark: SparkSession, contract: Contract, layout: Layout, ds: str, as_of: str, names: Sequence[str]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Stage and check the named datasets of a day: (typed batches, check rows). Nothing is loaded."""
    staged = {name: stage(spark, contract[name], layout, ds) for name in names}
    typed = {n: cast_to_contract(df, _types(contract[n])) for n, df in staged.items() if df is not None}
    log = layout.table("executions")

    def judged(name: str, references: dict[str, DataFrame]) -> list[DataFrame]:
        d = contract[name]
        if staged[name] is None:
            return [missing_batch(spark, d, ds)]
        return [
            schema_checks(spark, d, staged[name], d.path(layout.landing, ds), ds),
            quality_checks(spark, d, typed[name], references, log, ds, as_of),
        ]

    # dimensions first: one that fails its own checks is no reference (repeated keys are the same keys)
    own = {n: typed[n] for n in typed if not contract[n].is_fact}
    found = [rows for n in names if not contract[n].is_fact for rows in judged(n, {})]
    if found:
        found = [materialize(checks.union_checks(*found), "dimension_checks")]
        bad = checks.failed(found[0]).filter("check_name <> 'duplicates'").select("dataset").distinct().collect()
        own = {n: df for n, df in own.items() if n not in {r["dataset"] for r in bad}}
    references = _references(spark, contract, layout, own)
    found += [rows for n in names if contract[n].is_fact for rows in judged(n, references)]
    return typed, checks.union_checks(*found)


def load_batch(
    spark: SparkSession, contract: DatasetContract, typed: DataFrame, layout: Layout, ds: str
) -> None:
    """Publish a dimension, or replace a fact's day.

    Rows of another day, and rows with a value that does not cast, are set aside and not loaded: they get
    here only after the check that found them was settled by a human.
    """
    path = layout.table(_table(contract))
    broken = F.size(CAST_ERROR) > 0 if CAST_ERROR in typed.columns else F.lit(False)
    rows = typed.withColumn("_broken", F.coalesce(broken, F.lit(False)))
    fits = ~F.col("_broken")
    if contract.is_fact:
        rows = tables.with_day(rows, contract.ts_column)
        fits = fits & (F.col("day") == F.lit(ds).cast("date"))
    own, aside = predicates.split_valid(rows, fits)
    why = F.when(F.col("_broken"), "a value does not cast").otherwise("event time outside the batch day")
    if MALFORMED in typed.columns:
        why = F.when(F.col(MALFORMED).isNotNull(), "malformed line").otherwise(why)
    tables.quarantine(aside, layout.warehouse, contract.name, ds, why)
    clean = own.drop("_broken", CAST_ERROR, MALFORMED)
    if contract.is_fact:
        tables.load_fact_partition(clean, path, "day", _cluster(contract), days=[ds])
    else:
        tables.publish_dimension(clean, path, ds)


def deduplicated(contract: DatasetContract, typed: DataFrame) -> DataFrame:
    """The batch with the newest row of each key, as a table. A malformed line replaces no row."""
    newest = [contract.ts_column] if contract.ts_column in typed.columns else []
    repaired = keys.dedupe_latest(well_formed(typed), list(contract.primary_key), newest)
    if MALFORMED in typed.columns:
        repaired = repaired.unionByName(typed.filter(F.col(MALFORMED).isNotNull()))
    return materialize(repaired, "repaired")


def _cluster(contract: DatasetContract) -> list[str]:
    return [k.column for k in contract.foreign_keys][:1]


def run_day(
    spark: SparkSession,
    contract: Contract,
    layout: Layout,
    ds: str,
    as_of: str | None = None,
    dag_id: str = "daily_batches",
    only: Iterable[str] | None = None,
    independent: DataFrame | None = None,
    limits: watch.Watch | None = None,
) -> DayResult:
    """Run one day end to end: check, repair the staged batch where that is approved, check again, load once.

    ``independent`` is a second opinion on checks of the day, as ``incidents.contradict`` takes it: a failure that it
    denies is not repaired but escalated. ``limits`` adds the checks of ``operators.watch`` against the logged days.

    Running it again leaves the same tables. Of the registry and the logs it replaces the day's rows of the
    datasets it ran; findings that are gone are closed, and what a human has decided stays decided.
    """
    names = [n for n in contract.datasets if only is None or n in set(only)]
    landed = [contract[n].path(layout.landing, ds) for n in names]
    configure(spark, *[path for path in landed if exists(spark, path)])
    as_of = as_of or f"{date.fromisoformat(ds) + timedelta(days=1)} 02:00:00"
    log, registry, audit = (layout.table(t) for t in ("executions", "incidents", "incident_audit_trail"))

    typed, found = validate_day(spark, contract, layout, ds, as_of, names)
    if limits:
        found = materialize(found, "found")
        found = found.unionByName(against_past(spark, contract, layout, found, limits, ds, as_of, names))
    tables.write_executions(found, log, f"validate-{ds}", ds, as_of, as_of, names)
    found = spark.read.parquet(log).filter(
        (F.col("run_date") == F.lit(ds).cast("date")) & F.col("dataset").isin(names)
    ).select(*checks.CHECK_COLUMNS)

    sampled = sampled_keys(spark, contract, layout, typed, found, ds)
    decided = incidents.triage(found, contract.policy_frame(spark), dag_id, sampled, independent)
    before = registered(spark, registry, ds, names, decided)
    decided = materialize(carry_decisions(decided, before), "decided")
    gone = before.join(decided.select("incident_id"), "incident_id", "left_anti").select(*decided.columns)
    gone = gone.filter(F.col("status") != incidents.CLOSED).withColumn("status", F.lit(incidents.CLOSED))
    gone = materialize(gone, "gone")
    run = f"{dag_id}-{ds}"
    # before anything is touched: what was found, and what is about to be done about it
    fresh = F.col("status").isin(incidents.PENDING, incidents.ESCALATED)
    log_steps(decided, [(fresh, incidents.OPEN), *_entered(incidents.PENDING, incidents.ESCALATED)], audit, as_of, run)
    log_steps(gone, _entered(incidents.CLOSED), audit, as_of, run)

    batches = literal_table(spark, [(n, ds) for n in typed], "dataset string, batch_date date")
    may_load = {row["dataset"] for row in incidents.halt_gate(batches, decided).collect()}
    to_repair: dict[str, list] = {}
    for row in decided.filter(F.col("status") == incidents.PENDING).collect():  # a few per dataset
        to_repair.setdefault(row["dataset"], []).append(row)
    result = DayResult(found, decided, halted=sorted(set(names) - may_load))
    outcome = []
    for name in [n for n in names if n in may_load]:
        d, batch = contract[name], typed[name]
        if name in to_repair:
            batch = deduplicated(d, batch)
            verdicts = recheck(spark, contract, layout, d, batch, ds, as_of, to_repair[name])
            outcome += verdicts
            if any(state != incidents.REMEDIATED for _, state in verdicts):
                result.halted = sorted([*result.halted, name])
                continue
            result.repaired.append(name)
        load_batch(spark, d, batch, layout, ds)
        result.loaded.append(name)

    result.incidents = close_incidents(spark, decided, gone, outcome, registry, audit, as_of, run, [(ds, n) for n in names])
    return result


def sampled_keys(
    spark: SparkSession, contract: Contract, layout: Layout, typed: dict[str, DataFrame], found: DataFrame, ds: str
) -> DataFrame:
    """Keys behind the day's failed checks. Only the datasets that failed are read again."""
    bad = {r["dataset"] for r in checks.failed(found).select("dataset").distinct().collect()}  # at most one per dataset
    sound = {n: df for n, df in typed.items() if not contract[n].is_fact and n not in bad}
    known = _references(spark, contract, layout, sound)
    parts = [literal_table(spark, [], offenders.SCHEMA)]
    for name in sorted(bad & set(typed)):
        d = contract[name]
        batch = well_formed(typed[name]).withColumn("batch_date", F.lit(ds).cast("date"))
        references = {
            k.column: (known[k.ref_dataset], k.ref_column) for k in d.foreign_keys
            if k.ref_dataset in known and k.ref_column in known[k.ref_dataset].columns
        }
        parts.append(offenders.offending_keys(found, batch, name, "batch_date", d.primary_key, references))
    return reduce(lambda a, b: a.unionByName(b), parts)


def registered(spark: SparkSession, registry: str, ds: str, names: Sequence[str], like: DataFrame) -> DataFrame:
    """The day's incidents of these datasets as an earlier run left them."""
    if not exists(spark, registry):
        return like.limit(0)
    day = (F.col("execution_date") == F.lit(ds).cast("date")) & F.col("dataset").isin(list(names))
    # a registry without any incident so far has no file that could tell its columns
    return materialize(spark.read.schema(like.schema).parquet(registry).filter(day).select(*like.columns), "before")


def carry_decisions(decided: DataFrame, before: DataFrame) -> DataFrame:
    """Findings a human has dismissed, accepted or been asked about keep that status."""
    settled = (incidents.DECLINED, incidents.ACCEPTED, incidents.PENDING_APPROVAL)
    earlier = before.filter(F.col("status").isin(*settled)).select("incident_id", F.col("status").alias("_was"))
    joined = decided.join(earlier, "incident_id", "left")
    return joined.withColumn("status", F.coalesce("_was", "status")).select(*decided.columns)


def _entered(*states: str) -> list:
    return [(F.col("status") == state, state) for state in states]


def log_steps(rows: DataFrame, steps: list, audit: str, as_of: str, run: str) -> None:
    """Append one audit row per incident and step; ``steps``: (which incidents, state they enter), in order.

    A step that the log already holds for this run is not logged again. Each closing starts the count anew,
    so that a finding which comes back is opened again. ``step`` numbers an incident's rows.
    """
    spark = rows.sparkSession
    entered = [
        remediation.audit_rows(rows.filter(which), state, as_of, run).withColumn("step", F.lit(i + 1).cast("bigint"))
        for i, (which, state) in enumerate(steps)
    ]
    new = reduce(lambda a, b: a.unionByName(b), entered)
    if exists(spark, audit):
        past = materialize(
            spark.read.schema(new.schema).parquet(audit).join(rows.select("incident_id").distinct(), "incident_id", "left_semi"), "past"
        )
        so_far = past.groupBy("incident_id").agg(
            F.max("step").alias("_last"), F.count_if(F.col("state") == incidents.CLOSED).alias("_closed")
        )
        turn = F.when(F.col("_closed") > 0, F.concat(F.lit(f"{run}#"), F.col("_closed"))).otherwise(F.lit(run))
        new = new.join(so_far, "incident_id", "left").withColumn("remediation_job_id", turn)
        new = new.withColumn("step", F.col("step") + F.coalesce("_last", F.lit(0))).drop("_last", "_closed")
        held = past.select("incident_id", "state", "remediation_job_id")
        new = new.join(held, ["incident_id", "state", "remediation_job_id"], "left_anti")
    tables.append_audit(materialize(new, "steps"), audit)


def close_incidents(
    spark: SparkSession,
    decided: DataFrame,
    gone: DataFrame,
    outcome: list[tuple[str, str]],
    registry: str,
    audit: str,
    as_of: str,
    run: str,
    pairs: list[tuple[str, str]],
) -> DataFrame:
    """Final states into the registry and the audit trail. A repair nobody performed has failed and escalates."""
    repaired = literal_table(spark, outcome, "incident_id string, outcome string")
    joined = decided.join(F.broadcast(repaired), "incident_id", "left")  # one row per repaired incident
    pending = F.col("status") == incidents.PENDING
    state = F.when(pending, F.coalesce("outcome", F.lit(incidents.FAILED))).otherwise(F.col("status"))
    final = materialize(joined.withColumn("status", state).drop("outcome").select(*decided.columns), "final")
    tables.write_incidents(final.unionByName(gone), registry, pairs)
    failed = (F.col("status") == incidents.FAILED, incidents.ESCALATED)
    log_steps(final, [*_entered(incidents.REMEDIATED, incidents.FAILED), failed], audit, as_of, run)
    return final


def offending(spark: SparkSession, contract: Contract, layout: Layout, typed: DataFrame, rows: list) -> DataFrame:
    """Mark (``_bad``) the rows of a batch that its approved incidents are about."""
    name = rows[0]["dataset"]
    bad = F.lit(False)
    references = {k.column: k for k in contract[name].foreign_keys}
    marked = typed
    for row in rows:
        column = row["column_name"]
        if row["check_name"] == "null_rate":
            bad = bad | F.col(column).isNull()
        elif row["check_name"] == "schema" and column in typed.columns:
            bad = bad | F.array_contains(CAST_ERROR, column)
        elif row["check_name"] == "foreign_key":
            reference = references[column]
            table = layout.table(_table(contract[reference.ref_dataset]))
            known = tables.read_dimension_table(spark, table).select(F.col(reference.ref_column).alias(f"_{column}"))
            marked = marked.join(known.distinct(), F.col(column) == F.col(f"_{column}"), "left")
            bad = bad | (F.col(column).isNotNull() & F.col(f"_{column}").isNull())
    return marked.withColumn("_bad", bad).select(*typed.columns, "_bad")


def apply_decisions(
    spark: SparkSession,
    contract: Contract,
    layout: Layout,
    ds: str,
    approvals: DataFrame,
    as_of: str,
    dag_id: str = "daily_batches",
) -> DataFrame:
    """Act on human decisions about a day's escalated incidents; returns the incidents afterwards.

    A dataset moves on once each of its incidents is approved or declined. Approved:
    the offending rows go to quarantine, the check that failed is run again on the others,
    and they are loaded if it passes. Declined: the finding is dismissed and the batch
    stands; values that do not cast are set aside, not loaded as NULL. Volume findings have
    no offending rows; approving one accepts the batch.
    """
    staged = [f"{layout.table('staging')}/{n}/{ds}" for n in contract.datasets]
    configure(spark, *[path for path in staged if exists(spark, path)])
    registry, audit = layout.table("incidents"), layout.table("incident_audit_trail")
    day = F.col("execution_date") == F.lit(ds).cast("date")
    known = materialize(spark.read.parquet(registry).filter(day), "registry")
    moved = materialize(incidents.apply_approvals(known, approvals), "moved").select(*known.columns)
    changed = moved.join(known.select("incident_id", F.col("status").alias("was")), "incident_id").filter("status <> was")
    run = f"{dag_id}-{ds}-approval"
    log_steps(changed, _entered(incidents.PENDING_APPROVAL, incidents.PENDING, incidents.DECLINED), audit, as_of, run)

    waiting = F.col("status").isin(incidents.ESCALATED, incidents.PENDING_APPROVAL, incidents.FAILED)
    held = {r["dataset"] for r in moved.filter(waiting).select("dataset").distinct().collect()}
    approved: dict[str, list] = {}
    for row in moved.filter(F.col("status") == incidents.PENDING).collect():  # a few per dataset and day
        approved.setdefault(row["dataset"], []).append(row)
    dismissed = {r["dataset"] for r in changed.filter(F.col("status") == incidents.DECLINED).collect()}

    verdicts = []
    for name in sorted((set(approved) | dismissed) - held):
        d, rows = contract[name], approved.get(name, [])
        staged = spark.read.parquet(f"{layout.table('staging')}/{name}/{ds}")
        if not set(d.columns) <= set(staged.columns):
            verdicts += [(r["incident_id"], incidents.FAILED) for r in rows]  # nothing to load it from
            continue
        typed = cast_to_contract(staged, _types(d))
        if rows:
            marked = offending(spark, contract, layout, typed, rows)
            kept, _ = tables.write_split(marked, ~F.col("_bad"), layout.table("approved"), name, ds, "approved repair")
            typed = spark.read.parquet(kept).select(*typed.columns)
        if any(r["check_name"] == "duplicates" for r in rows):
            typed = deduplicated(d, typed)
        found = recheck(spark, contract, layout, d, _loadable(d, typed, ds), ds, as_of, rows)
        verdicts += found
        if all(state != incidents.FAILED for _, state in found):
            load_batch(spark, d, typed, layout, ds)

    outcome = literal_table(spark, verdicts, "incident_id string, outcome string")
    settled = F.when(F.col("status") == incidents.PENDING, F.coalesce("outcome", F.col("status"))).otherwise(F.col("status"))
    final = materialize(
        moved.join(F.broadcast(outcome), "incident_id", "left").withColumn("status", settled).select(*known.columns),
        "final",
    )
    tables.write_incidents(final, registry)
    finished = final.join(F.broadcast(outcome), "incident_id", "left_semi")
    failed = (F.col("status") == incidents.FAILED, incidents.ESCALATED)
    states = (incidents.REMEDIATED, incidents.ACCEPTED, incidents.FAILED)
    log_steps(finished, [*_entered(*states), failed], audit, as_of, run)
    return final


def _loadable(d: DatasetContract, typed: DataFrame, ds: str) -> DataFrame:
    """The rows of a batch that a load would take."""
    fits = ~F.coalesce(F.size(CAST_ERROR) > 0, F.lit(False)) if CAST_ERROR in typed.columns else F.lit(True)
    if d.is_fact and d.ts_column in typed.columns:
        fits = fits & (F.to_date(d.ts_column) == F.lit(ds).cast("date"))
    return typed.filter(fits)


def recheck(
    spark: SparkSession,
    contract: Contract,
    layout: Layout,
    d: DatasetContract,
    batch: DataFrame,
    ds: str,
    as_of: str,
    rows: list,
) -> list[tuple[str, str]]:
    """Run the failed checks again on the batch as it is about to be loaded: [(incident id, outcome)]."""
    if not rows:
        return []
    references = _references(spark, contract, layout, {})
    again = quality_checks(spark, d, batch, references, layout.table("executions"), ds, as_of).collect()
    passed = {(r["check_name"], r["column_name"]): r["passed"] for r in again}
    # a volume, lateness or drift that a human took as it is leaves no rows to judge
    accepted = {"row_count", "volume_history", "freshness", "schema"}

    def verdict(r) -> str:
        if r["decision"] != "auto_fix" and r["check_name"] in accepted:
            return incidents.ACCEPTED
        return incidents.REMEDIATED if passed.get((r["check_name"], r["column_name"]), False) else incidents.FAILED

    return [(r["incident_id"], verdict(r)) for r in rows]

"""Contract checks. Every check yields rows of one schema, one row per judged fact:

``dataset, batch_date, check_name, column_name, metric, lower, upper, passed, n_bad, evidence``
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.functions.casting import MALFORMED
from batchkeeper.functions.scalars import rate
from batchkeeper.session import literal_table

CHECK_COLUMNS = (
    "dataset",
    "batch_date",
    "check_name",
    "column_name",
    "metric",
    "lower",
    "upper",
    "passed",
    "n_bad",
    "evidence",
)


def quoted(text: str) -> str:
    """A SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def check_row(
    check: str,
    column: str,
    metric: str,
    passed: str,
    n_bad: str,
    evidence: str,
    lower: str = "NULL",
    upper: str = "NULL",
    batch_date: str = "batch_date",
) -> str:
    """One check result as a SQL struct; ``dataset`` and ``batch_date`` come from the row it is built on.

    SQL text and not Column objects: a run builds hundreds of these, and each call on a
    Column costs the driver a round trip.
    """
    fields = {
        "dataset": "dataset",
        "batch_date": batch_date,
        "check_name": quoted(check),
        "column_name": f"CAST({column} AS STRING)",
        "metric": f"CAST({metric} AS DOUBLE)",
        "lower": f"CAST({lower} AS DOUBLE)",
        "upper": f"CAST({upper} AS DOUBLE)",
        "passed": passed,
        "n_bad": f"CAST({n_bad} AS BIGINT)",
        "evidence": evidence,
    }
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


# --- one pass over a dataset -------------------------------------------------


def batch_profile(
    df: DataFrame,
    dataset: str,
    batch: str,
    key: Sequence[str],
    nulls: Sequence[str] = (),
    zeros: Sequence[str] = (),
    ts: str | None = None,
) -> DataFrame:
    """Everything the row-count, null, zero, duplicate and freshness checks need, in one scan.

    Rows are first reduced per (batch, key), where duplicates show and where map-side
    aggregation absorbs hot keys, then per batch. Result: dataset, batch_date, n_rows,
    excess, n_null_key, null_<c>, zero_<c>, max_ts.
    """
    counters = {f"null_{c}": f"count_if(`{c}` IS NULL)" for c in nulls}
    counters |= {f"zero_{c}": f"count_if(`{c}` = 0)" for c in zeros}
    newest = [F.expr(f"max(CAST(`{ts}` AS TIMESTAMP)) AS max_ts")] if ts else []
    grouping = [F.col(batch).alias("batch_date"), *[F.col(c).alias(f"k_{c}") for c in key]]
    per_key = df.groupBy(*grouping).agg(
        F.expr("count(1) AS n"), *[F.expr(f"{count} AS `{name}`") for name, count in counters.items()], *newest
    )
    whole = " AND ".join(f"`k_{c}` IS NOT NULL" for c in key) or "true"
    sums = [
        "sum(n) AS n_rows",
        f"coalesce(sum(n - 1) FILTER (WHERE {whole}), 0) AS excess",
        f"coalesce(sum(n) FILTER (WHERE NOT ({whole})), 0) AS n_null_key",
        *[f"sum(`{name}`) AS `{name}`" for name in counters],
        *(["max(max_ts) AS max_ts"] if ts else []),
    ]
    per_batch = per_key.groupBy("batch_date").agg(*map(F.expr, sums))
    return per_batch.withColumn("dataset", F.lit(dataset))


def batch_counts(df: DataFrame, dataset: str, batch: str) -> DataFrame:
    """(dataset, batch_date, n_rows); nothing but the batch column is read."""
    return (
        df.groupBy(F.col(batch).alias("batch_date"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(dataset).alias("dataset"), "batch_date", "n_rows")
    )


def relative_bounds(counts: DataFrame, below: float, above: float) -> DataFrame:
    """Attach bounds around the nominal (mean) batch size. One row per batch enters the window."""
    nominal = F.avg("n_rows").over(Window.partitionBy("dataset"))
    return counts.withColumn("lower", nominal * (1 - below)).withColumn("upper", nominal * (1 + above))


def contract_bounds(counts: DataFrame, bounds: DataFrame, scope: str = "batch") -> DataFrame:
    """Attach the declared bounds; datasets without any keep NULLs."""
    declared = bounds.filter(F.col("scope") == scope).select("dataset", "lower", "upper")
    return counts.join(F.broadcast(declared), "dataset", "left")  # one row per contract entry


def fill_missing_batches(counts: DataFrame, step: str) -> DataFrame:
    """Add an empty row for every batch that never arrived between the first and the last one.

    A GROUP BY cannot show an absent batch. Each batch is stretched up to its successor,
    so no second read of the counts is needed.
    """
    following = F.lead("batch_date").over(Window.partitionBy("dataset").orderBy("batch_date"))
    until = F.coalesce(F.date_sub("_next", 1), F.col("batch_date"))
    span = F.sequence(F.col("batch_date"), until, F.expr(f"interval {step}"))
    stretched = counts.withColumn("_next", following).withColumn("_day", F.explode_outer(span)).drop("_next")
    arrived = F.col("_day").eqNullSafe(F.col("batch_date"))
    numbers = [f.name for f in counts.schema.fields if f.dataType.typeName() == "long"]
    kept = {c: F.when(arrived, F.col(c)).otherwise(F.lit(0)) for c in numbers}
    if "max_ts" in counts.columns:
        kept["max_ts"] = F.when(arrived, F.col("max_ts"))
    return stretched.withColumns(kept).withColumn("batch_date", F.col("_day")).drop("_day")


def expected_batches(counts: DataFrame, dataset: str, date_from: str, date_to: str) -> DataFrame:
    """Counts over an explicit calendar: days without a batch appear with zero rows, also at the ends."""
    spark = counts.sparkSession
    day = F.sequence(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    calendar = spark.range(1).select(F.lit(dataset).alias("dataset"), F.explode(day).alias("batch_date"))
    numbers = [f.name for f in counts.schema.fields if f.dataType.typeName() == "long"]
    return calendar.join(counts, ["dataset", "batch_date"], "left").fillna(0, numbers)


# --- single checks as SQL structs over a profile row --------------------------


def _beyond(n: str = "n_rows") -> str:
    """Rows past the violated bound."""
    return f"CASE WHEN {n} > upper THEN {n} - floor(upper) WHEN {n} < lower THEN ceil(lower) - {n} ELSE 0 END"


def row_count_row() -> str:
    passed = "coalesce(n_rows BETWEEN lower AND upper, false)"
    return check_row("row_count", "NULL", "n_rows", passed, _beyond(), "concat('rows=', n_rows)", "lower", "upper")


def history_rows(judged: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """``three_sigma`` verdicts as check rows; too little history is recorded, not failed."""
    bounded = judged.selectExpr("*", f"mean - {sigmas}D * sd AS lower", f"mean + {sigmas}D * sd AS upper")
    evidence = "concat('rows=', n_rows, ' ', status)"
    passed = "status NOT IN ('spike', 'drop')"
    return rows_of(
        bounded, check_row("volume_history", "NULL", "n_rows", passed, _beyond(), evidence, "lower", "upper")
    )


def _rate_row(check: str, label: str, counter: str, column: str, tolerance: float) -> str:
    share = f"(CASE WHEN n_rows > 0 THEN `{counter}` / n_rows END)"
    limit = f"{float(tolerance)!r}D"
    evidence = f"concat('{label}=', `{counter}`, ' of ', n_rows)"
    passed = f"coalesce({share} <= {limit}, true)"
    return check_row(check, quoted(column), share, passed, f"`{counter}`", evidence, upper=limit)


def null_rate_row(column: str, tolerance: float) -> str:
    """Fails strictly above the tolerance; an empty batch is the row count's business."""
    return _rate_row("null_rate", "nulls", f"null_{column}", column, tolerance)


def zero_rate_row(column: str, tolerance: float) -> str:
    return _rate_row("zero_rate", "zeros", f"zero_{column}", column, tolerance)


def duplicate_row(key: Sequence[str]) -> str:
    evidence = "concat('excess=', excess, ' null_keys=', n_null_key, ' of ', n_rows)"
    return check_row("duplicates", quoted(",".join(key)), "excess", "excess = 0", "excess", evidence, upper="0")


def fk_row(column: str) -> str:
    evidence = "concat('orphans=', n_orphan, ' keys=', n_orphan_keys, ' of ', n_rows)"
    return check_row("foreign_key", quoted(column), "n_orphan", "n_orphan = 0", "n_orphan", evidence, upper="0")


def freshness_row(
    column: str, as_of: str, max_delay_hours: float, max_ts: str = "max_ts", batch_date: str = "batch_date"
) -> str:
    """Lag of the newest row behind an explicit clock; no rows at all is not fresh."""
    lag = f"(timestampdiff(MICROSECOND, {max_ts}, TIMESTAMP {quoted(as_of)}) / 3.6e9D)"
    limit = f"{float(max_delay_hours)!r}D"
    passed = f"coalesce({lag} <= {limit}, false)"
    evidence = f"concat('max=', coalesce(date_format({max_ts}, 'yyyy-MM-dd HH:mm:ss'), 'none'))"
    bad = f"if({passed}, 0, 1)"
    return check_row("freshness", quoted(column), lag, passed, bad, evidence, upper=limit, batch_date=batch_date)


def with_newest(profile: DataFrame) -> DataFrame:
    """Mark each dataset's last batch and put its newest timestamp beside every batch."""
    whole = Window.partitionBy("dataset")
    return profile.withColumns(
        {
            "newest_ts": F.max("max_ts").over(whole),
            "is_last": F.col("batch_date").eqNullSafe(F.max("batch_date").over(whole)),
        }
    )


def newest_row(column: str, as_of: str, max_delay_hours: float) -> str:
    """One freshness row per dataset, out of the profile that serves the other checks too."""
    row = freshness_row(column, as_of, max_delay_hours, "newest_ts", "to_date(newest_ts)")
    return f"if(is_last, {row}, NULL)"


def landing_row(max_delay_hours: float) -> str:
    delay = "(timestampdiff(MICROSECOND, CAST(batch_date AS TIMESTAMP), landed_at) / 3.6e9D)"
    limit = f"{float(max_delay_hours)!r}D"
    passed = f"coalesce({delay} <= {limit}, false)"
    evidence = "concat('landed=', coalesce(date_format(landed_at, 'yyyy-MM-dd HH:mm:ss'), 'never'))"
    return check_row("landing_sla", "NULL", delay, passed, f"if({passed}, 0, 1)", evidence, upper=limit)


def rows_of(df: DataFrame, *checks: str) -> DataFrame:
    """Turn check structs into check rows, without another pass over ``df``. A NULL struct gives no row."""
    return df.selectExpr(f"inline(filter(array({', '.join(checks)}), r -> r IS NOT NULL))")


@dataclass(frozen=True)
class Rule:
    """A rule a team adds itself, as SQL: an aggregate per batch and the range it must stay in.

    ``where`` narrows the judged rows; an aggregate that is NULL fails.
    """

    name: str
    aggregate: str
    lower: float | None = None
    upper: float | None = None
    where: str = "true"
    column: str | None = None


def custom_rules(df: DataFrame, dataset: str, batch: str, rules: Sequence[Rule]) -> DataFrame:
    """All rules of a dataset in one aggregation; they share the scan and the shuffle."""
    values = [F.expr(f"{r.aggregate} FILTER (WHERE {r.where})").alias(f"rule_{i}") for i, r in enumerate(rules)]
    per_batch = df.groupBy(F.col(batch).alias("batch_date")).agg(*values).withColumn("dataset", F.lit(dataset))
    rows = []
    for i, r in enumerate(rules):
        value = f"CAST(rule_{i} AS DOUBLE)"
        low, high = (("NULL" if b is None else f"{float(b)!r}D") for b in (r.lower, r.upper))
        inside = " AND ".join(
            [f"{value} IS NOT NULL"]
            + ([f"{value} >= {low}"] if r.lower is not None else [])
            + ([f"{value} <= {high}"] if r.upper is not None else [])
        )
        passed = f"coalesce({inside}, false)"
        column = "NULL" if r.column is None else quoted(r.column)
        evidence = f"concat('value=', coalesce(CAST(round({value}, 6) AS DECIMAL(28, 6)), 'none'))"
        rows.append(check_row(r.name, column, value, passed, f"if({passed}, 0, 1)", evidence, low, high))
    return rows_of(per_batch, *rows)


# --- the checks as DataFrames ------------------------------------------------


def row_count_check(counts: DataFrame) -> DataFrame:
    """``counts`` carries n_rows, lower and upper per dataset and batch."""
    return rows_of(counts, row_count_row())


def null_rate(profile: DataFrame, tolerance: Mapping[str, float]) -> DataFrame:
    return rows_of(profile, *[null_rate_row(c, t) for c, t in tolerance.items()])


def zero_rate(profile: DataFrame, tolerance: Mapping[str, float]) -> DataFrame:
    return rows_of(profile, *[zero_rate_row(c, t) for c, t in tolerance.items()])


def duplicate_check(profile: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows_of(profile, duplicate_row(key))


def fk_check(report: DataFrame, column: str) -> DataFrame:
    """``report``: ``fk_report`` by batch, with ``dataset`` and ``batch_date``."""
    return rows_of(report, fk_row(column))


def freshness(profile: DataFrame, column: str, as_of: str, max_delay_hours: float) -> DataFrame:
    """One row per dataset."""
    return rows_of(with_newest(profile), newest_row(column, as_of, max_delay_hours))


def landing_sla(arrivals: DataFrame, max_delay_hours: float) -> DataFrame:
    """``arrivals(dataset, batch_date, landed_at)``: day D must land within the delay from its start.

    Landing exactly at the limit passes; a batch that has not landed fails.
    """
    return rows_of(arrivals, landing_row(max_delay_hours))


def schema_check(diff: DataFrame, dataset: str, batch_date: str) -> DataFrame:
    """Every line of a ``schema_diff`` that is drift, as a failed check."""
    keyed = diff.withColumn("dataset", F.lit(dataset)).withColumn("batch_date", F.lit(batch_date).cast("date"))
    evidence = "concat(kind, ': expected ', coalesce(expected, '-'), ', observed ', coalesce(observed, '-'))"
    return rows_of(
        keyed, check_row("schema", "column_name", "coalesce(bad_share, 1)", "false", "1", evidence, upper="0")
    )


def union_checks(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [c.select(*CHECK_COLUMNS) for c in checks])


def failed(checks: DataFrame) -> DataFrame:
    """An undecided check is a failed one."""
    return checks.filter(~F.coalesce(F.col("passed"), F.lit(False)))


# --- structure ---------------------------------------------------------------


def schema_diff(observed: DataFrame, expected: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Differences between two column lists, one row each.

    ``observed``/``expected``: (column_name, type, ordinal); ``failures``: (column_name,
    n_rows, n_bad) of the cast to the declared type. Kinds: missing, unexpected,
    type_changed, reordered, malformed. A rename shows as a missing and an unexpected column. Malformed are lines
    that ``failures`` counts under ``_malformed``: they fit no column. All inputs hold one row per column.
    """
    o = observed.select("column_name", F.col("type").alias("o_type"), F.col("ordinal").alias("o_pos"))
    e = expected.select("column_name", F.col("type").alias("e_type"), F.col("ordinal").alias("e_pos"))
    both = e.join(o, "column_name", "full")
    if failures is None:
        both = both.withColumn("bad_share", F.lit(None).cast("double"))
    else:
        shares = failures.select("column_name", rate(F.col("n_bad"), F.col("n_rows")).alias("bad_share"))
        both = both.join(shares, "column_name", "left")
    # position among the columns that both sides have
    shared = F.col("o_pos").isNotNull() & F.col("e_pos").isNotNull()
    one = Window.partitionBy(shared)
    o_rank, e_rank = (F.row_number().over(one.orderBy(c, "column_name")) for c in ("o_pos", "e_pos"))
    ranked = both.withColumn("o_rank", o_rank).withColumn("e_rank", e_rank)
    kind = (
        F.when(F.col("o_pos").isNull(), "missing")
        .when(F.col("e_pos").isNull(), "unexpected")
        .when((F.col("o_type") != F.col("e_type")) | (F.col("bad_share") > 0), "type_changed")
        .when(F.col("o_rank") != F.col("e_rank"), "reordered")
    )
    found = (
        ranked.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            "column_name", "kind", F.col("e_type").alias("expected"), F.col("o_type").alias("observed"), "bad_share"
        )
    )
    if failures is None:
        return found
    none = F.lit(None).cast("string")
    lines = failures.filter((F.col("column_name") == MALFORMED) & (F.col("n_bad") > 0)).select(
        "column_name", F.lit("malformed").alias("kind"), none.alias("expected"), none.alias("observed"),
        rate(F.col("n_bad"), F.col("n_rows")).alias("bad_share"),
    )
    return found.unionByName(lines)


def columns_frame(df: DataFrame) -> DataFrame:
    """(column_name, type, ordinal) of a DataFrame."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return literal_table(df.sparkSession, rows, "column_name string, type string, ordinal int")


def profile_text(kind: str) -> str:
    """How a profile shows a value of a type, as SQL with a place for the value."""
    if kind in ("double", "float"):
        return "CAST(CAST({0} AS DECIMAL(28, 6)) AS STRING)"
    return "date_format({0}, 'yyyy-MM-dd HH:mm:ss')" if kind.startswith("timestamp") else "CAST({0} AS STRING)"


def profile(df: DataFrame, dataset: str, approximate: bool = False) -> DataFrame:
    """Rows, NULLs, distinct values and range of every column.

    One narrow aggregation per column: each reads only its column, so together they
    read a columnar table once, and values are merged per task before the shuffle.
    Several exact distinct counts in one aggregate would instead send every row once
    per column. ``approximate`` swaps the per-value shuffle for sketches in one pass.
    """
    columns = [(f.name, profile_text(f.dataType.typeName())) for f in df.schema.fields]
    if approximate:
        totals = df.selectExpr("count(1) AS n", *[
            f"{fn.format(f'`{c}`')} AS {label}_{i}"
            for i, (c, _) in enumerate(columns)
            for label, fn in (("nulls", "count_if({} IS NULL)"), ("distinct", "approx_count_distinct({})"),
                              ("low", "min({})"), ("high", "max({})"))
        ])
        rows = [
            f"named_struct('dataset', {quoted(dataset)}, 'column_name', {quoted(c)}, 'n_rows', n, 'n_null', nulls_{i}, "
            f"'n_distinct', distinct_{i}, 'min_value', {t.format(f'low_{i}')}, 'max_value', {t.format(f'high_{i}')})"
            for i, (c, t) in enumerate(columns)
        ]
        return totals.selectExpr(f"inline(array({', '.join(rows)}))")
    parts = []
    for c, t in columns:
        values = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(values.selectExpr(
            f"{quoted(dataset)} AS dataset", f"{quoted(c)} AS column_name", "coalesce(sum(n), 0) AS n_rows",
            "coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS n_null", "count(v) AS n_distinct",
            f"{t.format('min(v)')} AS min_value", f"{t.format('max(v)')} AS max_value",
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)

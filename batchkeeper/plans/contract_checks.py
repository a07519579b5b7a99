"""The full set of contract checks over the given tables, in as few scans as they allow.

Per dataset one pass serves row counts, NULL and zero rates, duplicates and freshness;
each foreign key adds one pass over its single column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.operators import checks, joins
from batchkeeper.plans import inputs
from batchkeeper.plans.inputs import AS_OF

ORDERS_MAX_DELAY, EVENTS_MAX_DELAY = 26, 6
TOTAL_TOLERANCE, DISCOUNT_TOLERANCE = 0.02, 0.08


def dataset_checks(
    df: DataFrame,
    dataset: str,
    key: list[str],
    step: str,
    tolerance: tuple[float, float],
    null: dict[str, float] | None = None,
    zero: dict[str, float] | None = None,
    fresh: tuple[str, float] | None = None,
    references: tuple[tuple[str, DataFrame, str], ...] = (),
) -> DataFrame:
    null, zero = null or {}, zero or {}
    profile = checks.batch_profile(
        df, dataset, "batch_date", key, list(null), list(zero), fresh[0] if fresh else None
    )
    bounded = checks.fill_missing_batches(checks.relative_bounds(profile, *tolerance), step)
    rows = [
        checks.row_count_row(),
        checks.duplicate_row(key),
        *[checks.null_rate_row(c, t) for c, t in null.items()],
        *[checks.zero_rate_row(c, t) for c, t in zero.items()],
    ]
    if fresh:
        bounded = checks.with_newest(bounded)
        rows.append(checks.newest_row(fresh[0], AS_OF, fresh[1]))
    parts = [checks.rows_of(bounded, *rows)]
    for column, dim, ref in references:
        report = joins.fk_report(df, column, dim, ref, by=["batch_date"]).withColumn("dataset", F.lit(dataset))
        parts.append(checks.fk_check(report, column))
    return checks.union_checks(*parts)


def all_checks(spark: SparkSession, sf: str, faulty: bool = False) -> DataFrame:
    customer, part = inputs.table(spark, sf, "customer"), inputs.table(spark, sf, "part")
    orders = inputs.faulty_orders(spark, sf) if faulty else inputs.orders(spark, sf)
    events = inputs.faulty_events(spark, sf) if faulty else inputs.events(spark, sf)
    return checks.union_checks(
        dataset_checks(
            orders, "orders", ["o_orderkey"], "1 month", (0.2, 0.2),
            null={"o_custkey": 0.0, "o_totalprice": TOTAL_TOLERANCE},
            fresh=("o_orderdate", ORDERS_MAX_DELAY),
            references=(("o_custkey", customer, "c_custkey"),),
        ),
        dataset_checks(
            inputs.items(spark, sf), "lineitem", ["l_orderkey", "l_linenumber"], "1 month", (0.2, 0.2),
            zero={"l_discount": DISCOUNT_TOLERANCE},
            references=(
                ("l_orderkey", inputs.table(spark, sf, "orders"), "o_orderkey"),
                ("l_partkey", part, "p_partkey"),
            ),
        ),
        dataset_checks(
            events, "events", ["event_id"], "1 day", (0.25, 0.25),
            null={"user_id": 0.0},
            fresh=("ts", EVENTS_MAX_DELAY),
            references=(("user_id", customer, "c_custkey"),),
        ),
    )


def _profile_sql(name, dataset, source, batch, step, key, counters, ts, below, above) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in key)
    row = f"({', '.join(key)})"
    extra = "".join(f",\n    count(*) FILTER (WHERE {p}) AS {c}" for c, p in counters.items())
    filled = "".join(f", coalesce({c}, 0) AS {c}" for c in counters)
    return f"""
{name}_b AS (
  SELECT {batch} AS batch_date, count(*) AS n_rows,
    count(*) FILTER (WHERE {whole}) - count(DISTINCT {row}) FILTER (WHERE {whole}) AS excess,
    count(*) FILTER (WHERE NOT ({whole})) AS n_null_key,
    max({ts}) AS max_ts{extra}
  FROM {source} GROUP BY 1),
{name}_cal AS (
  SELECT CAST(unnest(generate_series(
    (SELECT min(batch_date) FROM {name}_b), (SELECT max(batch_date) FROM {name}_b), INTERVAL {step})) AS DATE) AS day),
{name}_p AS (
  SELECT '{dataset}' AS dataset, day AS batch_date, coalesce(n_rows, 0) AS n_rows, coalesce(excess, 0) AS excess,
    coalesce(n_null_key, 0) AS n_null_key{filled},
    (SELECT avg(n_rows) FROM {name}_b) * {below} AS lower, (SELECT avg(n_rows) FROM {name}_b) * {above} AS upper
  FROM {name}_cal LEFT JOIN {name}_b ON day = batch_date)"""


def _row_count_sql(name) -> str:
    return f"""
  SELECT dataset, batch_date, 'row_count' AS check_name, CAST(NULL AS VARCHAR) AS column_name,
    CAST(n_rows AS DOUBLE) AS metric, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper,
    n_rows BETWEEN lower AND upper AS passed,
    CAST(CASE WHEN n_rows > upper THEN n_rows - floor(upper) WHEN n_rows < lower THEN ceil(lower) - n_rows ELSE 0 END
      AS BIGINT) AS n_bad,
    'rows=' || n_rows AS evidence
  FROM {name}_p"""


def _rate_sql(name, check, label, column, counter, tolerance) -> str:
    return f"""
  SELECT dataset, batch_date, '{check}', '{column}', CASE WHEN n_rows > 0 THEN {counter} * 1.0e0 / n_rows END,
    NULL, CAST({tolerance} AS DOUBLE),
    coalesce(CASE WHEN n_rows > 0 THEN {counter} * 1.0e0 / n_rows END <= CAST({tolerance} AS DOUBLE), TRUE),
    {counter}, '{label}=' || {counter} || ' of ' || n_rows
  FROM {name}_p"""


def _duplicates_sql(name, key) -> str:
    return f"""
  SELECT dataset, batch_date, 'duplicates', '{",".join(key)}', CAST(excess AS DOUBLE), NULL, 0.0,
    excess = 0, excess, 'excess=' || excess || ' null_keys=' || n_null_key || ' of ' || n_rows
  FROM {name}_p"""


def _freshness_sql(name, dataset, column, hours) -> str:
    lag = f"date_diff('microsecond', max_ts, TIMESTAMP '{AS_OF}') / 3.6e9"
    return f"""
  SELECT '{dataset}', CAST(max_ts AS DATE), 'freshness', '{column}', {lag}, NULL, CAST({hours} AS DOUBLE),
    {lag} <= {hours}, CASE WHEN {lag} <= {hours} THEN 0 ELSE 1 END,
    'max=' || strftime(max_ts, '%Y-%m-%d %H:%M:%S')
  FROM (SELECT max(max_ts) AS max_ts FROM {name}_b)"""


def _fk_sql(dataset, source, batch, column, dim, ref) -> str:
    return f"""
  SELECT '{dataset}', batch_date, 'foreign_key', '{column}', CAST(n AS DOUBLE), NULL, 0.0, n = 0, n,
    'orphans=' || n || ' keys=' || k || ' of ' || n_rows
  FROM (
    SELECT {batch} AS batch_date, count(*) AS n_rows,
      count(*) FILTER (WHERE {column} IS NOT NULL AND {ref} IS NULL) AS n,
      count(DISTINCT {column}) FILTER (WHERE {ref} IS NULL) AS k
    FROM {source} LEFT JOIN {dim} ON {column} = {ref} GROUP BY 1)"""


def checks_ctes(faulty: bool = False) -> str:
    """CTEs that end in ``checks``: the same rows as :func:`all_checks`."""
    orders, events = ("f_orders", "f_events") if faulty else ("orders", "events")
    o_month = "CAST(date_trunc('month', o_orderdate) AS DATE)"
    l_month = "CAST(date_trunc('month', l_shipdate) AS DATE)"
    e_day = "CAST(ts AS DATE)"
    profiles = [
        _profile_sql("o", "orders", orders, o_month, "1 MONTH", ["o_orderkey"],
                     {"null_c": "o_custkey IS NULL", "null_t": "o_totalprice IS NULL"}, "o_orderdate", 0.8, 1.2),
        _profile_sql("l", "lineitem", "lineitem", l_month, "1 MONTH", ["l_orderkey", "l_linenumber"],
                     {"zero_d": "l_discount = 0"}, "l_shipdate", 0.8, 1.2),
        _profile_sql("e", "events", events, e_day, "1 DAY", ["event_id"],
                     {"null_u": "user_id IS NULL"}, "ts", 0.75, 1.25),
    ]
    rows = [
        _row_count_sql("o"), _row_count_sql("l"), _row_count_sql("e"),
        _duplicates_sql("o", ["o_orderkey"]), _duplicates_sql("l", ["l_orderkey", "l_linenumber"]),
        _duplicates_sql("e", ["event_id"]),
        _rate_sql("o", "null_rate", "nulls", "o_custkey", "null_c", 0.0),
        _rate_sql("o", "null_rate", "nulls", "o_totalprice", "null_t", TOTAL_TOLERANCE),
        _rate_sql("e", "null_rate", "nulls", "user_id", "null_u", 0.0),
        _rate_sql("l", "zero_rate", "zeros", "l_discount", "zero_d", DISCOUNT_TOLERANCE),
        _freshness_sql("o", "orders", "o_orderdate", ORDERS_MAX_DELAY),
        _freshness_sql("e", "events", "ts", EVENTS_MAX_DELAY),
        _fk_sql("orders", orders, o_month, "o_custkey", "customer", "c_custkey"),
        _fk_sql("lineitem", "lineitem", l_month, "l_orderkey", "orders", "o_orderkey"),
        _fk_sql("lineitem", "lineitem", l_month, "l_partkey", "part", "p_partkey"),
        _fk_sql("events", events, e_day, "user_id", "customer", "c_custkey"),
    ]
    head = [inputs.FAULTY_SQL] if faulty else []
    return ",".join([*head, *profiles]) + ",\nchecks AS (" + "\n  UNION ALL".join(rows) + ")"

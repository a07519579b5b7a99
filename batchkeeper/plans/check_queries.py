"""Registered queries: filters, keys, references and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchkeeper.functions.casting import CAST_ERROR, as_raw_text, cast_failure_share, cast_to_contract, standardize
from batchkeeper.operators import baselines, checks, faults, fingerprints, joins, keys, predicates
from batchkeeper.plans import contract_checks, inputs
from batchkeeper.plans.inputs import AS_OF, FAULTY_SQL, NO_KEY, tidy
from batchkeeper.plans.registry import query
from batchkeeper.session import materialize, new_scratch

CHECK_SELECT = """
SELECT dataset, batch_date, check_name, column_name, round(metric, 6) AS metric, round(lower, 6) AS lower,
  round(upper, 6) AS upper, passed, CAST(n_bad AS BIGINT) AS n_bad, evidence
FROM checks"""


@query("all_checks", "WITH " + contract_checks.checks_ctes() + CHECK_SELECT)
def all_checks(spark, sf):
    return tidy(contract_checks.all_checks(spark, sf))


@query(
    "row_count_check",
    "WITH "
    + FAULTY_SQL
    + """,
days AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM f_events GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM days), (SELECT max(day) FROM days),
  INTERVAL 1 DAY)) AS DATE) AS batch_date)
SELECT batch_date, coalesce(n, 0) AS n_rows, round((SELECT avg(n) FROM days) * 0.75, 6) AS lower,
  round((SELECT avg(n) FROM days) * 1.25, 6) AS upper,
  coalesce(n, 0) BETWEEN (SELECT avg(n) FROM days) * 0.75 AND (SELECT avg(n) FROM days) * 1.25 AS passed
FROM cal LEFT JOIN days ON day = batch_date""",
)
def row_count_check(spark, sf):
    counts = checks.batch_counts(inputs.faulty_events(spark, sf), "events", "batch_date")
    filled = checks.fill_missing_batches(checks.relative_bounds(counts, 0.25, 0.25), "1 day")
    judged = checks.row_count_check(filled)
    return tidy(judged.select("batch_date", F.col("metric").cast("bigint").alias("n_rows"), "lower", "upper", "passed"))


@query(
    "day_slice",
    "SELECT event_id, user_id, event_type, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
)
def day_slice(spark, sf):
    rows = predicates.day_slice(inputs.table(spark, sf, "events"), "ts", "2024-01-15")
    return rows.select("event_id", "user_id", "event_type", "value")


@query(
    "cast_contract",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice, p_size,
  CASE WHEN p_partkey % 2 = 0 THEN 'p_retailprice' ELSE '' END AS cast_errors
FROM part""",
)
def cast_contract(spark, sf):
    part = inputs.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    raw = as_raw_text(faults.currency_text(part, "p_retailprice", F.col("p_partkey") % 2 == 0))
    typed = cast_to_contract(raw, {"p_partkey": "bigint", "p_retailprice": "double", "p_size": "int"})
    return typed.withColumn("cast_errors", F.array_join(CAST_ERROR, ",")).drop(CAST_ERROR)


@query(
    "standardize_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, lower(o_orderstatus) AS status,
  replace(o_orderpriority, '  ', ' ') AS priority
FROM orders""",
)
def standardize_dates(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy"]
    shown = F.when(k == 0, F.date_format("o_orderdate", formats[0]))
    shown = shown.when(k == 1, F.date_format("o_orderdate", formats[1]))
    raw = orders.select(
        "o_orderkey",
        shown.otherwise(F.date_format("o_orderdate", formats[2])).alias("order_date"),
        F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("status"),
        F.concat(F.lit(" "), F.regexp_replace("o_orderpriority", " ", "   ")).alias("priority"),
    )
    return standardize(raw, dates={"order_date": formats}, text={"status": "lower", "priority": None})


@query(
    "business_key_dups",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date, count(*) AS n_rows
FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def business_key_dups(spark, sf):
    items = inputs.table(spark, sf, "lineitem").withColumn("ship_date", F.to_date("l_shipdate"))
    key = predicates.business_key(["l_orderkey", "l_linenumber", "ship_date"])
    repeated = keys.duplicate_keys(items.select(key), ["business_key"])
    return repeated.select("business_key.*", "n_rows")


@query(
    "null_records",
    """SELECT o_orderkey,
  concat_ws(',', CASE WHEN o_orderkey % 100 = 1 THEN 'o_custkey' END,
                 CASE WHEN o_orderkey % 4 = 0 THEN 'o_totalprice' END) AS null_columns
FROM orders WHERE o_orderkey % 100 = 1 OR o_orderkey % 4 = 0""",
)
def null_records(spark, sf):
    df = inputs.table(spark, sf, "orders")
    df = faults.blank(df, "o_custkey", F.col("o_orderkey") % 100 == 1)
    df = faults.blank(df, "o_totalprice", F.col("o_orderkey") % 4 == 0)
    return predicates.null_rows(df, ["o_orderkey"], ["o_custkey", "o_totalprice"])


@query(
    "accepted_values",
    """SELECT 'event_type' AS column_name, event_type AS value, count(*) AS n_rows,
  event_type IN ('click', 'view', 'signup', 'purchase') AS accepted FROM events GROUP BY event_type
UNION ALL
SELECT 'o_orderstatus', o_orderstatus, count(*), o_orderstatus IN ('F', 'O', 'P') FROM orders GROUP BY o_orderstatus""",
)
def accepted_values(spark, sf):
    types = predicates.accepted_values(
        inputs.table(spark, sf, "events"), "event_type", ["click", "view", "signup", "purchase"]
    )
    states = predicates.accepted_values(inputs.table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"])
    named = "column_name"
    return types.withColumn(named, F.lit("event_type")).unionByName(states.withColumn(named, F.lit("o_orderstatus")))


@query(
    "events_json_extract",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def events_json_extract(spark, sf):
    events = inputs.table(spark, sf, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- references --------------------------------------------------------------


@query(
    "fk_orders_customer",
    f"""SELECT o_orderkey, o_custkey FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN {NO_KEY} WHEN o_orderkey % 100 = 1 THEN NULL ELSE o_custkey END
    AS o_custkey FROM orders) o
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def fk_orders_customer(spark, sf):
    return joins.fk_orphans(
        _orders_with_bad_keys(spark, sf), "o_custkey", inputs.table(spark, sf, "customer"), "c_custkey"
    )


def _orders_with_bad_keys(spark, sf):
    df = inputs.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    df = faults.blank(df, "o_custkey", F.col("o_orderkey") % 100 == 1)
    return faults.break_reference(df, "o_custkey", F.col("o_orderkey") < 100, NO_KEY)


@query(
    "fk_lineitem_part",
    f"""SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey < 100 THEN {NO_KEY} - l_linenumber ELSE l_partkey END
    AS l_partkey FROM lineitem) l
WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
)
def fk_lineitem_part(spark, sf):
    items = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    missing = F.lit(NO_KEY).cast("bigint") - F.col("l_linenumber")
    items = items.withColumn("l_partkey", F.when(F.col("l_orderkey") < 100, missing).otherwise(F.col("l_partkey")))
    return joins.fk_orphans(items, "l_partkey", inputs.table(spark, sf, "part"), "p_partkey")


@query(
    "fk_events_customer",
    f"""SELECT event_id, user_id FROM (
  SELECT event_id, CASE WHEN event_id < 100 THEN {NO_KEY} ELSE user_id END AS user_id FROM events) e
WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
)
def fk_events_customer(spark, sf):
    events = inputs.table(spark, sf, "events").select("event_id", "user_id")
    events = faults.break_reference(events, "user_id", F.col("event_id") < 100, NO_KEY)
    return joins.fk_orphans(events, "user_id", inputs.table(spark, sf, "customer"), "c_custkey")


def _fk_report_sql(dataset, column, source, dim, ref):
    return f"""SELECT '{dataset}' AS dataset, '{column}' AS column_name, count(*) AS n_rows,
  count(*) - count({column}) AS n_null, count({ref}) AS n_matched,
  count(*) FILTER (WHERE {column} IS NOT NULL AND {ref} IS NULL) AS n_orphan,
  count(DISTINCT {column}) FILTER (WHERE {ref} IS NULL) AS n_orphan_keys
FROM {source} LEFT JOIN {dim} ON {column} = {ref}"""


@query(
    "fk_report",
    "\nUNION ALL\n".join(
        [
            _fk_report_sql(
                "orders", "o_custkey",
                f"""(SELECT CASE WHEN o_orderkey < 100 THEN {NO_KEY} WHEN o_orderkey % 100 = 1 THEN NULL
  ELSE o_custkey END AS o_custkey FROM orders) o""",
                "customer", "c_custkey",
            ),
            _fk_report_sql("lineitem", "l_orderkey", "lineitem", "orders", "o_orderkey"),
            _fk_report_sql("lineitem", "l_partkey", "lineitem", "part", "p_partkey"),
            _fk_report_sql("events", "user_id", "events", "customer", "c_custkey"),
        ]
    ),
)
def fk_report(spark, sf):
    def t(name):
        return inputs.table(spark, sf, name)

    references = [
        ("orders", _orders_with_bad_keys(spark, sf), "o_custkey", t("customer"), "c_custkey"),
        ("lineitem", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        ("lineitem", t("lineitem"), "l_partkey", t("part"), "p_partkey"),
        ("events", t("events"), "user_id", t("customer"), "c_custkey"),
    ]
    out = None
    for dataset, fact, column, dim, ref in references:
        report = joins.fk_report(fact, column, dim, ref).select(
            F.lit(dataset).alias("dataset"), F.lit(column).alias("column_name"), "*"
        )
        out = report if out is None else out.unionByName(report)
    return out


@query(
    "orphan_sample",
    f"""SELECT l_partkey AS fk, count(*) AS n FROM (
  SELECT CASE WHEN l_orderkey < 100 THEN {NO_KEY} - l_orderkey ELSE l_partkey END AS l_partkey FROM lineitem) l
WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1 ORDER BY 1 LIMIT 10""",
)
def orphan_sample(spark, sf):
    return joins.orphan_sample(_item_orphans(spark, sf), 10)


def _item_orphans(spark, sf):
    items = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    missing = F.lit(NO_KEY).cast("bigint") - F.col("l_orderkey")
    items = items.withColumn("l_partkey", F.when(F.col("l_orderkey") < 100, missing).otherwise(F.col("l_partkey")))
    return joins.orphan_keys(items, "l_partkey", inputs.table(spark, sf, "part"), "p_partkey")


@query(
    "orphan_summary",
    f"""WITH o AS (SELECT l_partkey AS fk, count(*) AS n FROM (
  SELECT CASE WHEN l_orderkey < 100 THEN {NO_KEY} - l_orderkey ELSE l_partkey END AS l_partkey FROM lineitem) l
WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_orphan, count(*) AS n_orphan_keys,
  (SELECT string_agg(CAST(fk AS VARCHAR), ',' ORDER BY fk) FROM (SELECT fk FROM o ORDER BY fk LIMIT 5)) AS sample
FROM o""",
)
def orphan_summary(spark, sf):
    return joins.orphan_summary(_item_orphans(spark, sf), 5)


@query(
    "enrich_orders",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus,
  c_mktsegment, p_brand, p_type
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN part ON l_partkey = p_partkey""",
)
def enrich_orders(spark, sf):
    def t(name):
        return inputs.table(spark, sf, name)

    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rich = joins.enrich(
        items,
        [
            (t("orders"), "l_orderkey", "o_orderkey", ["o_orderdate", "o_orderstatus", "o_custkey"]),
            (t("customer"), "o_custkey", "c_custkey", ["c_mktsegment"]),
            (t("part"), "l_partkey", "p_partkey", ["p_brand", "p_type"]),
        ],
    )
    return rich.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.to_date("o_orderdate").alias("order_date"),
        "o_orderstatus", "c_mktsegment", "p_brand", "p_type",
    )


@query(
    "amount_consistency",
    """SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (WHERE d > 0) AS n_bad,
  count(*) FILTER (WHERE d IS NULL) AS n_unpriced, CAST(sum(d) AS DOUBLE) AS total_diff,
  CAST(max(d) AS DOUBLE) AS max_diff
FROM (SELECT l_returnflag, abs(CAST(l_extendedprice AS DECIMAL(28, 2))
        - CAST(round(p_retailprice * l_quantity, 2) AS DECIMAL(28, 2))) AS d
      FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) x
GROUP BY l_returnflag""",
)
def amount_consistency(spark, sf):
    return joins.amount_consistency(
        inputs.table(spark, sf, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice",
        inputs.table(spark, sf, "part"), "p_partkey", "p_retailprice", ["l_returnflag"],
    )


@query(
    "touched_days",
    """SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_rows FROM orders
WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem
  GROUP BY l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) HAVING count(*) > 1) GROUP BY 1""",
)
def touched_days(spark, sf):
    orders = inputs.table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    items = inputs.table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return joins.touched_partitions(orders, keys.duplicate_keys(items, ["l_orderkey", "l_linenumber", "day"]), "day")


@query(
    "blast_radius",
    """WITH RECURSIVE edges AS (
  SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey FROM orders
  UNION ALL SELECT 'orders/' || l_orderkey, 'item/' || l_orderkey || '-' || l_linenumber FROM lineitem),
reach(node, depth) AS (
  SELECT 'region/' || r_regionkey, 0 FROM region WHERE r_name = 'AMERICA'
  UNION SELECT dst, depth + 1 FROM reach JOIN edges ON node = src)
SELECT node, min(depth) AS depth FROM reach GROUP BY node""",
)
def blast_radius(spark, sf):
    """Everything downstream of one region, row by row: nations, customers, orders, items."""

    def edge(name, parent, src, child, *dst):
        to = F.concat(F.lit(f"{child}/"), F.concat_ws("-", *[F.col(c).cast("string") for c in dst]))
        source = F.concat(F.lit(f"{parent}/"), F.col(src).cast("string"))
        return inputs.table(spark, sf, name).select(source.alias("src"), to.alias("dst"))

    edges = (
        edge("nation", "region", "n_regionkey", "nation", "n_nationkey")
        .unionByName(edge("customer", "nation", "c_nationkey", "customer", "c_custkey"))
        .unionByName(edge("orders", "customer", "o_custkey", "orders", "o_orderkey"))
        .unionByName(edge("lineitem", "orders", "l_orderkey", "item", "l_orderkey", "l_linenumber"))
    )
    region = inputs.table(spark, sf, "region").filter(F.col("r_name") == "AMERICA")
    start = region.select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("node"))
    return joins.blast_radius(edges, start)


@query(
    "deep_reach",
    """WITH runs AS (SELECT p_partkey, p_partkey - row_number() OVER (ORDER BY p_partkey) AS run FROM part)
SELECT p_partkey AS node, (p_partkey - min(p_partkey) OVER (PARTITION BY run))::INTEGER AS depth FROM runs""",
)
def deep_reach(spark, sf):
    """A lineage as long as the part table: each part follows the one numbered before it, if there is one."""
    parts = inputs.table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    before = parts.select((F.col("node") + 1).alias("node"), F.col("node").alias("src")).join(parts, "node")
    edges = before.select("src", F.col("node").alias("dst"))
    return joins.deep_reach(edges, parts.join(edges.select(F.col("dst").alias("node")), "node", "left_anti"))


# --- aggregates --------------------------------------------------------------


def _order_profile(spark, sf):
    return checks.batch_profile(
        inputs.faulty_orders(spark, sf), "orders", "batch_date", ["o_orderkey"], ["o_custkey", "o_totalprice"]
    )


@query(
    "null_rate",
    "WITH "
    + FAULTY_SQL
    + """,
b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date, count(*) AS n,
  count(*) - count(o_custkey) AS nc, count(*) - count(o_totalprice) AS nt FROM f_orders GROUP BY 1)
SELECT batch_date, 'o_custkey' AS column_name, round(nc * 1.0e0 / n, 6) AS rate, 0.0e0 AS tolerance,
  nc * 1.0e0 / n <= 0.0e0 AS passed, nc AS n_null FROM b
UNION ALL
SELECT batch_date, 'o_totalprice', round(nt * 1.0e0 / n, 6), 0.02e0, nt * 1.0e0 / n <= 0.02e0, nt FROM b""",
)
def null_rate(spark, sf):
    rows = checks.null_rate(_order_profile(spark, sf), {"o_custkey": 0.0, "o_totalprice": 0.02})
    return tidy(
        rows.select(
            "batch_date", "column_name", F.col("metric").alias("rate"), F.col("upper").alias("tolerance"),
            "passed", F.col("n_bad").alias("n_null"),
        )
    )


@query(
    "zero_rate",
    """WITH b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS batch_date, count(*) AS n,
  count(*) FILTER (WHERE l_discount = 0) AS zd, count(*) FILTER (WHERE l_tax = 0) AS zt FROM lineitem GROUP BY 1)
SELECT batch_date, 'l_discount' AS column_name, round(zd * 1.0e0 / n, 6) AS rate, zd * 1.0e0 / n <= 0.08e0 AS passed,
  zd AS n_zero FROM b
UNION ALL
SELECT batch_date, 'l_tax', round(zt * 1.0e0 / n, 6), zt * 1.0e0 / n <= 0.06e0, zt FROM b""",
)
def zero_rate(spark, sf):
    profile = checks.batch_profile(inputs.items(spark, sf), "lineitem", "batch_date", [], zeros=["l_discount", "l_tax"])
    rows = checks.zero_rate(profile, {"l_discount": 0.08, "l_tax": 0.06})
    return tidy(
        rows.select("batch_date", "column_name", F.col("metric").alias("rate"), "passed", F.col("n_bad").alias("n_zero"))
    )


@query(
    "null_spike",
    "WITH "
    + FAULTY_SQL
    + """,
r AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date,
  (count(*) - count(o_totalprice)) * 1.0e0 / count(*) AS rate FROM f_orders GROUP BY 1),
u AS (SELECT *, avg(rate) OVER (ORDER BY batch_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS usual FROM r)
SELECT 'orders' AS dataset, batch_date, round(rate, 6) AS rate, round(usual, 6) AS usual_rate,
  coalesce(rate > 0.005e0 AND rate > 3.0 * usual, FALSE) AS spike
FROM u""",
)
def null_spike(spark, sf):
    rates = _order_profile(spark, sf).select(
        "dataset", "batch_date", (F.col("null_o_totalprice") / F.col("n_rows")).alias("rate")
    )
    return tidy(baselines.null_spike(rates, 6, 3.0, 0.005))


@query(
    "duplicate_excess",
    """SELECT count(*) AS n_rows, count(DISTINCT (k, l_linenumber)) FILTER (WHERE k IS NOT NULL) AS n_keys,
  count(*) FILTER (WHERE k IS NULL) AS n_null_key,
  count(*) - count(DISTINCT (k, l_linenumber)) FILTER (WHERE k IS NOT NULL) AS excess_raw,
  count(k) - count(DISTINCT (k, l_linenumber)) FILTER (WHERE k IS NOT NULL) AS excess
FROM (SELECT CASE WHEN l_orderkey % 100 = 1 THEN NULL ELSE l_orderkey END AS k, l_linenumber FROM lineitem) l""",
)
def duplicate_excess(spark, sf):
    items = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    items = faults.blank(items, "l_orderkey", F.col("l_orderkey") % 100 == 1)
    return keys.duplicate_excess(items, ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return keys.duplicate_keys(inputs.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dedupe_latest",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS ship_date
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
    l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) x
WHERE rn = 1""",
)
def dedupe_latest(spark, sf):
    newest = keys.dedupe_latest(inputs.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return newest.withColumn("ship_date", F.to_date("l_shipdate")).drop("l_shipdate")


@query(
    "replayed_keys",
    """WITH seen AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate) AS DATE) AS b
  FROM lineitem),
f AS (SELECT b, min(b) OVER (PARTITION BY l_orderkey, l_linenumber) AS first_batch FROM seen),
t AS (SELECT b, count(*) AS n FROM seen GROUP BY b)
SELECT first_batch, f.b AS replay_batch, count(*) AS n_keys, round(count(*) * 1.0e0 / any_value(t.n), 6) AS share
FROM f JOIN t ON f.b = t.b WHERE f.b > first_batch GROUP BY first_batch, f.b""",
)
def replayed_keys(spark, sf):
    return tidy(keys.replayed_keys(inputs.items(spark, sf), ["l_orderkey", "l_linenumber"], "batch_date"))


@query(
    "freshness",
    "\nUNION ALL\n".join(
        f"""SELECT '{d}' AS dataset, '{c}' AS column_name, strftime(m, '%Y-%m-%d %H:%M:%S') AS max_ts,
  round(date_diff('microsecond', m, TIMESTAMP '{AS_OF}') / 3.6e9, 6) AS lag_hours, {h}.0e0 AS max_delay_hours,
  date_diff('microsecond', m, TIMESTAMP '{AS_OF}') / 3.6e9 <= {h} AS passed
FROM (SELECT max({c}) AS m FROM {d}) x"""
        for d, c, h in (("events", "ts", 6), ("events", "ts", 26), ("orders", "o_orderdate", 26))
    ),
)
def freshness(spark, sf):
    out = None
    for dataset, column, limits in (("events", "ts", (6, 26)), ("orders", "o_orderdate", (26,))):
        newest = inputs.table(spark, sf, dataset).agg(F.max(F.col(column).cast("timestamp")).alias("max_ts"))
        newest = newest.select(F.lit(dataset).alias("dataset"), F.to_date("max_ts").alias("batch_date"), "max_ts")
        rows = checks.rows_of(newest, *[checks.freshness_row(column, AS_OF, h) for h in limits])
        out = rows if out is None else out.unionByName(rows)
    return tidy(
        out.select(
            "dataset", "column_name", F.substring("evidence", 5, 19).alias("max_ts"),
            F.col("metric").alias("lag_hours"), F.col("upper").alias("max_delay_hours"), "passed",
        )
    )


@query(
    "landing_sla",
    """SELECT CAST(ts AS DATE) AS batch_date, strftime(max(ts) + INTERVAL 125 MINUTE, '%Y-%m-%d %H:%M:%S') AS landed_at,
  round(date_diff('microsecond', CAST(CAST(ts AS DATE) AS TIMESTAMP), max(ts) + INTERVAL 125 MINUTE) / 3.6e9, 6)
    AS delay_hours,
  date_diff('microsecond', CAST(CAST(ts AS DATE) AS TIMESTAMP), max(ts) + INTERVAL 125 MINUTE) / 3.6e9 <= 26 AS passed
FROM events GROUP BY CAST(ts AS DATE)""",
)
def landing_sla(spark, sf):
    """A day's batch lands 125 minutes after its last event, which some days is past the limit."""
    last = inputs.events(spark, sf).groupBy("batch_date").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    arrivals = last.select(
        F.lit("events").alias("dataset"), "batch_date", (F.col("last") + F.expr("interval 125 minutes")).alias("landed_at")
    )
    rows = checks.landing_sla(arrivals, 26)
    landed = F.substring("evidence", 8, 19).alias("landed_at")
    return tidy(rows.select("batch_date", landed, F.col("metric").alias("delay_hours"), "passed"))


@query(
    "custom_rules",
    """WITH b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS batch_date,
  max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS q, min(l_extendedprice) AS p,
  count(*) FILTER (WHERE l_discount > 0.05) AS d FROM lineitem GROUP BY 1)
SELECT batch_date, 'returned_quantity' AS check_name, CAST(q AS DOUBLE) AS metric, coalesce(q <= 49, FALSE) AS passed FROM b
UNION ALL SELECT batch_date, 'least_price', CAST(p AS DOUBLE), coalesce(p BETWEEN 950 AND 1000000, FALSE) FROM b
UNION ALL SELECT batch_date, 'discounted_rows', CAST(d AS DOUBLE), d >= 10 FROM b""",
)
def custom_rules(spark, sf):
    rules = [
        checks.Rule("returned_quantity", "max(l_quantity)", upper=49, where="l_returnflag = 'R'", column="l_quantity"),
        checks.Rule("least_price", "min(l_extendedprice)", 950, 1_000_000, column="l_extendedprice"),
        checks.Rule("discounted_rows", "count(1)", lower=10, where="l_discount > 0.05"),
    ]
    judged = checks.custom_rules(inputs.items(spark, sf), "lineitem", "batch_date", rules)
    return judged.select("batch_date", "check_name", "metric", "passed")


PROFILE_COLUMNS = {
    "orders": {
        "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "n", "o_totalprice": "d", "o_orderdate": "t",
        "o_orderpriority": "n",
    },
    "customer": {"c_custkey": "n", "c_name": "n", "c_nationkey": "n", "c_acctbal": "d", "c_mktsegment": "n"},
}
_TEXT = {
    "n": "CAST({0}({1}) AS VARCHAR)",
    "d": "CAST(CAST({0}({1}) AS DECIMAL(28, 6)) AS VARCHAR)",
    "t": "strftime({0}({1}), '%Y-%m-%d %H:%M:%S')",
}


@query(
    "profile",
    "\nUNION ALL\n".join(
        f"""SELECT '{d}' AS dataset, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(DISTINCT {c}) AS n_distinct, {_TEXT[k].format("min", c)} AS min_value, {_TEXT[k].format("max", c)} AS max_value
FROM {d}"""
        for d, columns in PROFILE_COLUMNS.items()
        for c, k in columns.items()
    ),
)
def profile(spark, sf):
    return checks.profile(inputs.table(spark, sf, "orders"), "orders").unionByName(
        checks.profile(inputs.table(spark, sf, "customer"), "customer")
    )


@query(
    "schema_diff",
    """SELECT * FROM (VALUES
  ('c_custkey', 'missing', 'bigint', CAST(NULL AS VARCHAR)), ('cust_id', 'unexpected', NULL, 'bigint')
) v(column_name, kind, expected, observed), (SELECT 'customer' AS dataset, CAST(NULL AS DOUBLE) AS bad_share) d
UNION ALL
SELECT 'p_retailprice', 'type_changed', 'double', 'string', 'part',
  round(count(*) FILTER (WHERE p_partkey % 2 = 0) * 1.0e0 / count(*), 6) FROM part""",
)
def schema_diff(spark, sf):
    customer, part = inputs.table(spark, sf, "customer"), inputs.table(spark, sf, "part")
    renamed = faults.rename_column(customer, "c_custkey", "cust_id")
    drifted = faults.currency_text(part, "p_retailprice", F.col("p_partkey") % 2 == 0)
    declared = {f.name: f.dataType.simpleString() for f in part.schema.fields}
    failures = cast_failure_share(as_raw_text(drifted), declared)
    landed = new_scratch(spark, "customer")  # what the file holds, not what was declared, is the observed side
    renamed.write.parquet(landed)
    a = checks.schema_diff(checks.columns_frame(spark.read.parquet(landed)), checks.columns_frame(customer))
    b = checks.schema_diff(checks.columns_frame(drifted), checks.columns_frame(part), failures)
    return tidy(a.withColumn("dataset", F.lit("customer")).unionByName(b.withColumn("dataset", F.lit("part"))))


def _common_sql(a, b, source):
    """Values two columns share, among all values of both."""
    return (
        f"(SELECT count(*) FROM (SELECT CAST({a} AS VARCHAR) FROM {source} INTERSECT SELECT CAST({b} AS VARCHAR) FROM landed_{source})) * 1.0e0 / "
        f"(SELECT count(*) FROM (SELECT CAST({a} AS VARCHAR) FROM {source} UNION SELECT CAST({b} AS VARCHAR) FROM landed_{source}))"
    )


@query(
    "rename_hints",
    f"""WITH landed_customer AS (SELECT c_custkey AS cust_id, c_mktsegment AS c_name, c_name AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
landed_orders AS (SELECT o_custkey AS buyer FROM orders WHERE o_orderkey % 10 <> 0),
pairs AS (
  SELECT 'customer' AS dataset, 'c_custkey' AS expected_name, 'cust_id' AS observed_name, 'renamed' AS kind,
    {_common_sql("c_custkey", "cust_id", "customer")} AS share
  UNION ALL SELECT 'customer', 'c_name', 'c_mktsegment', 'swapped', {_common_sql("c_name", "c_mktsegment", "customer")}
  UNION ALL SELECT 'customer', 'c_mktsegment', 'c_name', 'swapped', {_common_sql("c_mktsegment", "c_name", "customer")}
  UNION ALL SELECT 'orders', 'o_custkey', 'buyer', 'renamed', {_common_sql("o_custkey", "buyer", "orders")})
SELECT dataset, expected_name, observed_name, kind, share >= 0.5e0 AS alike FROM pairs
UNION ALL
SELECT * FROM (VALUES ('customer', 'c_acctbal', CAST(NULL AS VARCHAR), 'gone', CAST(NULL AS BOOLEAN)),
  ('customer', NULL, 'loyalty', 'new', NULL), ('orders', NULL, 'channel', 'new', NULL)) v(a, b, c, d, e)""",
)
def rename_hints(spark, sf):
    """Columns renamed, swapped, dropped and added in files that also lack a tenth of the rows."""
    customer, orders = inputs.table(spark, sf, "customer"), inputs.table(spark, sf, "orders")
    landed = customer.filter("c_custkey % 10 <> 0").selectExpr(
        "c_custkey AS cust_id", "c_mktsegment AS c_name", "c_name AS c_mktsegment", "c_nationkey",
        "-1e9D - c_acctbal AS loyalty",
    )
    shipped = orders.filter("o_orderkey % 10 <> 0").withColumnRenamed("o_custkey", "buyer").withColumn(
        "channel", F.concat(F.lit("channel "), F.col("o_orderkey") % 7)
    )
    out = []
    for name, observed, expected in (("customer", landed, customer), ("orders", shipped, orders)):
        told = [materialize(fingerprints.column_fingerprints(df), "fingerprints") for df in (observed, expected)]
        out.append(fingerprints.rename_hints(*told).withColumn("dataset", F.lit(name)))
    both = out[0].unionByName(out[1])
    return both.select("dataset", "expected_name", "observed_name", "kind", (F.col("overlap") >= 0.5).alias("alike"))


EVENT_COLUMNS = {"event_id": "n", "user_id": "n", "event_type": "n", "value": "d", "ts": "t"}


@query(
    "profile_days",
    "\nUNION ALL\n".join(
        f"""SELECT 'events' AS dataset, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, TRUE AS close,
  {_TEXT[k].format("min", c)} AS min_value, {_TEXT[k].format("max", c)} AS max_value FROM events"""
        for c, k in EVENT_COLUMNS.items()
    ),
)
def profile_days(spark, sf):
    """The profile of all days from their stored sketches; ``close``: distinct values within 3 % of the exact count."""
    events, columns = inputs.events(spark, sf), list(EVENT_COLUMNS)
    daily = materialize(fingerprints.daily_profile(events, "batch_date", columns), "daily_profile")
    merged = fingerprints.merged_profile(daily, "events", columns)
    exact = checks.profile(events.select(*columns), "events").select("column_name", F.col("n_distinct").alias("n_exact"))
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.03 * F.col("n_exact")
    return merged.join(exact, "column_name").select(
        "dataset", "column_name", "n_rows", "n_null", close.alias("close"), "min_value", "max_value"
    )

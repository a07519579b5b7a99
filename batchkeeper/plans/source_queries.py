"""Registered queries of the readers and writers: the given tables are landed as raw files first."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchkeeper.contract import DatasetContract
from batchkeeper.functions.casting import CAST_ERROR, MALFORMED, cast_to_contract
from batchkeeper.plans import inputs
from batchkeeper.plans.registry import query
from batchkeeper.session import new_scratch
from batchkeeper.sources import files, generate, tables

ORDERS = DatasetContract(
    "orders",
    {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string"},
    path_pattern="orders/orders_{date}.csv",
)
EVENTS = DatasetContract(
    "events", {"event_id": "long", "user_id": "long", "event_type": "string"}, path_pattern="events/events_{date}.jsonl"
)
CUSTOMERS = DatasetContract(
    "customers", {"c_custkey": "long", "c_name": "string", "c_nationkey": "integer"}, path_pattern="customers.csv"
)
YEARS = range(1995, 2002)
REORDERED, RENAMED = 1996, 1997


def _land_orders(spark, sf):
    """One CSV batch a year; one with its columns in another order, one with a renamed column."""
    root = new_scratch(spark, "landing")
    orders = inputs.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    for year in YEARS:
        columns = list(ORDERS.columns)
        if year == REORDERED:
            columns = columns[::-1]
        batch = orders.filter(F.col("year") == year).select(*columns)
        if year == RENAMED:
            batch = batch.withColumnRenamed("o_custkey", "cust_id")
        batch.write.option("header", True).csv(ORDERS.path(root, f"{year}-01-01"))
    return root


@query(
    "read_batches_orders",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
  CASE WHEN year(o_orderdate) <> {RENAMED} THEN CAST(o_custkey AS VARCHAR) END AS o_custkey,
  CASE WHEN year(o_orderdate) = {RENAMED} THEN CAST(o_custkey AS VARCHAR) END AS cust_id,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS batch_date
FROM orders""",
)
def read_batches_orders(spark, sf):
    """All batches by name: nothing moves into another column, the renamed one stays apart."""
    found = files.read_batches(spark, ORDERS, _land_orders(spark, sf), "1995-01-01", "2001-12-31")
    return found.select("o_orderkey", "o_orderstatus", "o_custkey", "cust_id", "batch_date")


def _land_lines(lines, header: str, path: str) -> None:
    """A CSV batch of given lines: a single column whose name is the whole header, parted and quoted by nothing."""
    writer = lines.select(lines[0].alias(header)).write.option("header", True)
    writer.option("sep", "\u0001").option("quote", "\u0002").csv(path)


SURPLUS, SHORT = 1, 2  # of 50
_LINE = "CAST(o_orderkey AS {t}) || ',' || CAST(o_custkey AS {t}) || ',' || o_orderstatus"


@query(
    "malformed_orders",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> {SHORT} THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 50 <> {SHORT} THEN o_orderstatus END AS o_orderstatus,
  CASE o_orderkey % 50 WHEN {SURPLUS} THEN {_LINE.format(t="VARCHAR")} || ',"a, b",MORE'
    WHEN {SHORT} THEN CAST(o_orderkey AS VARCHAR) END AS malformed,
  CASE WHEN o_orderkey % 50 IN ({SURPLUS}, {SHORT}) THEN 'rejected' ELSE 'clean' END AS route,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS batch_date
FROM orders""",
)
def malformed_orders(spark, sf):
    """Lines with surplus fields and lines cut short stay whole and go aside; clean and rejected are all lines."""
    root = new_scratch(spark, "landing")
    orders = inputs.table(spark, sf, "orders")
    whole = F.expr(_LINE.format(t="STRING"))
    line = (
        F.when(F.col("o_orderkey") % 50 == SURPLUS, F.concat(whole, F.lit(',"a, b",MORE')))
        .when(F.col("o_orderkey") % 50 == SHORT, F.col("o_orderkey").cast("string"))
        .otherwise(whole)
    )
    for year in YEARS:
        batch = orders.filter(F.year("o_orderdate") == year).select(line.alias("line"))
        _land_lines(batch, ",".join(ORDERS.columns), ORDERS.path(root, f"{year}-01-01"))
    raw = files.read_batches(spark, ORDERS, root, "1995-01-01", "2001-12-31")
    typed = cast_to_contract(raw, {c: ORDERS.spark_type(c) for c in ORDERS.columns})
    return _routed(spark, typed, "orders", [*ORDERS.columns, "batch_date"])


def _routed(spark, typed, name, columns):
    """The batch split into clean and rejected rows by its cast errors, and read again from both tables."""
    kept, aside = tables.write_split(
        typed.withColumnRenamed(MALFORMED, "malformed"), F.size(CAST_ERROR) == 0, new_scratch(spark, "split"), name, "all", "malformed"
    )
    routes = (spark.read.parquet(kept), spark.read.parquet(aside))
    parts = [p.select(*columns, "malformed", F.lit(r).alias("route")) for p, r in zip(routes, ("clean", "rejected"), strict=True)]
    return parts[0].unionByName(parts[1])


CUT, NO_OBJECT = 3, 4  # of 40


@query(
    "malformed_events",
    f"""SELECT CASE WHEN event_id % 40 IN ({CUT}, {NO_OBJECT}) THEN NULL ELSE event_id END AS event_id,
  CASE WHEN event_id % 40 IN ({CUT}, {NO_OBJECT}) THEN NULL ELSE user_id END AS user_id,
  CASE event_id % 40
    WHEN {CUT} THEN '{{"event_id":' || CAST(event_id AS VARCHAR) || ',"user_id":' || CAST(user_id AS VARCHAR)
    WHEN {NO_OBJECT} THEN 'event ' || CAST(event_id AS VARCHAR) END AS malformed,
  CASE WHEN event_id % 40 IN ({CUT}, {NO_OBJECT}) THEN 'rejected' ELSE 'clean' END AS route
FROM events""",
)
def malformed_events(spark, sf):
    """Lines that are cut off, or hold no JSON object, stay whole and go aside; no line is lost."""
    path = EVENTS.path(new_scratch(spark, "landing"), "2024-01-01")
    events = inputs.table(spark, sf, "events")
    line = (
        F.when(F.col("event_id") % 40 == CUT, F.format_string('{"event_id":%d,"user_id":%d', "event_id", "user_id"))
        .when(F.col("event_id") % 40 == NO_OBJECT, F.format_string("event %d", "event_id"))
        .otherwise(F.to_json(F.struct("event_id", "user_id", "event_type")))
    )
    events.select(line.alias("value")).write.text(path)
    raw = files.read_events(spark, EVENTS, path)
    typed = cast_to_contract(raw, {c: EVENTS.spark_type(c) for c in EVENTS.columns})
    whole = F.col(MALFORMED).isNull()
    typed = typed.withColumns({c: F.when(whole, F.col(c)) for c in ("event_id", "user_id")})
    return _routed(spark, typed, "events", ["event_id", "user_id"])


@query(
    "observed_columns",
    f"""WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders),
c AS (SELECT * FROM (VALUES ('o_orderkey', 0, 2), ('o_custkey', 1, 1), ('o_orderstatus', 2, 0)) v(name, place, back))
SELECT CAST(make_date(CAST(year AS INTEGER), 1, 1) AS DATE) AS batch_date,
  CASE WHEN year = {RENAMED} AND name = 'o_custkey' THEN 'cust_id' ELSE name END AS column_name,
  CAST(CASE WHEN year = {REORDERED} THEN back ELSE place END AS INTEGER) AS ordinal
FROM y, c""",
)
def observed_columns(spark, sf):
    root = _land_orders(spark, sf)
    landed = files.batch_files(spark, ORDERS, root, "1995-01-01", "2001-12-31")
    seen = files.observed_columns(spark, list(landed.values()))
    day = F.to_date(F.regexp_extract("file", r"orders_(\d{4}-\d{2}-\d{2})", 1))
    return seen.select(day.alias("batch_date"), "column_name", "ordinal").distinct()


@query(
    "read_events",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events""",
)
def read_events(spark, sf):
    """JSON lines with an undeclared field: the declared ones arrive, as text."""
    path = EVENTS.path(new_scratch(spark, "landing"), "2024-01-01")
    inputs.table(spark, sf, "events").select("props", "event_type", "user_id", "event_id").write.json(path)
    return files.read_events(spark, EVENTS, path).select(*EVENTS.columns)


@query("read_dimension", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def read_dimension(spark, sf):
    root = new_scratch(spark, "landing")
    inputs.table(spark, sf, "customer").select(*CUSTOMERS.columns).write.option("header", True).csv(CUSTOMERS.path(root))
    return files.read_dimension(spark, CUSTOMERS, root).select(*CUSTOMERS.columns)


@query("staging_roundtrip", "SELECT c_custkey, c_name, c_nationkey, CAST(0 AS BIGINT) AS n_errors FROM customer")
def staging_roundtrip(spark, sf):
    """Stage a half batch, then the whole one again: the rerun replaces it, and every value casts back."""
    root, staging = new_scratch(spark, "landing"), new_scratch(spark, "staging")
    inputs.table(spark, sf, "customer").select(*CUSTOMERS.columns).write.option("header", True).csv(CUSTOMERS.path(root))
    raw = files.read_dimension(spark, CUSTOMERS, root)
    tables.write_staging(raw.filter(F.col("c_custkey").cast("bigint") % 2 == 0), staging, "customers", "2024-01-01")
    staged = spark.read.parquet(tables.write_staging(raw, staging, "customers", "2024-01-01"))
    typed = cast_to_contract(staged, {c: CUSTOMERS.spark_type(c) for c in CUSTOMERS.columns})
    return typed.select(*CUSTOMERS.columns, F.size(CAST_ERROR).cast("bigint").alias("n_errors"))


@query("dimension_refresh", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 5")
def dimension_refresh(spark, sf):
    """Versions 9 and 10, of which 9 sorts last as text, then 10 once more: the last refresh is what readers get."""
    path = new_scratch(spark, "dim_customers")
    customer = inputs.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    tables.publish_dimension(customer.filter("c_nationkey < 5"), path, "9")
    tables.publish_dimension(customer, path, "10")
    tables.publish_dimension(customer.filter("c_nationkey >= 5"), path, "10")
    return tables.read_dimension_table(spark, path).select("c_custkey", "c_name")


@query(
    "read_task_runs",
    """SELECT CAST(ts AS DATE) AS execution_date, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state,
  count(*) AS n_runs, count(DISTINCT user_id) AS n_tasks, min(ts) AS first_start FROM events GROUP BY 1, 2""",
)
def read_task_runs(spark, sf):
    """Run history as JSON lines: the events stand in for task runs."""
    path = new_scratch(spark, "task_runs")
    events = inputs.table(spark, sf, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events.select(
        F.lit("daily_batches").alias("dag_id"), F.col("user_id").cast("string").alias("task_id"),
        F.to_date("ts").alias("execution_date"), F.lit(1).alias("try_number"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("state"),
        stamp.alias("started_at"), stamp.alias("ended_at"), F.lit("").alias("log_text"),
    ).write.json(path)
    runs = files.read_task_runs(spark, path)
    return runs.groupBy("execution_date", "state").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("task_id").alias("n_tasks"),
        F.min("started_at").cast("timestamp_ntz").alias("first_start"),
    )


@query(
    "generated_invariants",
    """SELECT 'customers' AS feed, count(*) AS n_rows, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_orphans FROM customer
UNION ALL SELECT 'products', count(*), count(*), 0 FROM part
UNION ALL SELECT 'orders', 3 * (count(*) // 50), 3 * (count(*) // 50), 0 FROM orders
UNION ALL SELECT 'events', 3 * (count(*) // 50), 3 * (count(*) // 50), 0 FROM events""",
)
def generated_invariants(spark, sf):
    """Feeds as large as the given tables: sizes as asked, keys unique, no orphans."""
    n = {t: inputs.table(spark, sf, t).count() for t in ("customer", "part", "orders", "events")}
    feeds = generate.generate_dataset(spark, 3, n["customer"], n["part"], n["orders"] // 50, n["events"] // 50)
    key = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "events": "event_id"}
    out = None
    for feed, df in feeds.items():
        orphans = F.lit(0)
        if "customer_id" in df.columns and feed != "customers":
            known = feeds["customers"].select("customer_id", F.lit(1).alias("known"))
            df, orphans = df.join(known, "customer_id", "left"), F.count_if(F.col("known").isNull())
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key[feed]).alias("n_keys"), orphans.cast("bigint").alias("n_orphans")).select(
            F.lit(feed).alias("feed"), "n_rows", "n_keys", "n_orphans"
        )
        out = row if out is None else out.unionByName(row)
    return out

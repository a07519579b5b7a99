"""Registered queries that write tables and read them back.

Tables go to a fresh folder under the shared scratch root. Orders and items are
partitioned by month here, events by day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from batchkeeper.functions.scalars import money
from batchkeeper.operators import faults, keys, merge, remediation
from batchkeeper.plans import inputs
from batchkeeper.plans.inputs import FAULTY_SQL, tidy
from batchkeeper.plans.registry import query
from batchkeeper.session import materialize, new_scratch
from batchkeeper.sources import committed, tables

DAY_TOTALS_SQL = """SELECT CAST(ts AS DATE) AS batch_date, count(*) AS n_rows, count(DISTINCT event_id) AS n_keys,
  CAST(sum(CAST(value AS DECIMAL(28, 2))) AS DOUBLE) AS total_value
FROM events GROUP BY 1"""


def _day_totals(df):
    return df.groupBy("batch_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("event_id").alias("n_keys"),
        F.sum(money(F.col("value"))).cast("double").alias("total_value"),
    )


@query("load_partition_idempotent", DAY_TOTALS_SQL)
def load_partition_idempotent(spark, sf):
    """Load every day, then load the later half again: the table stays the same."""
    path, events = new_scratch(spark, "fct_events"), inputs.events(spark, sf)
    tables.load_fact_partition(events, path, "batch_date", ["user_id"])
    rerun = events.filter(F.col("batch_date") >= F.lit("2024-01-16").cast("date"))
    tables.load_fact_partition(rerun, path, "batch_date", ["user_id"])
    return _day_totals(tables.read_fact(spark, path, "batch_date"))


@query("rollback_partition", DAY_TOTALS_SQL)
def rollback_partition(spark, sf):
    """Back two days up, load faulty versions of them, restore: the table is as before."""
    path, backup = new_scratch(spark, "fct_events"), new_scratch(spark, "bak_events")
    days = [inputs.SHORT_DAY, inputs.LONG_DAY]
    tables.load_fact_partition(inputs.events(spark, sf), path, "batch_date", ["user_id"])
    tables.backup_partition(spark, path, backup, "batch_date", days)
    broken = inputs.faulty_events(spark, sf).filter(F.col("batch_date").isin([F.lit(d).cast("date") for d in days]))
    tables.load_fact_partition(broken, path, "batch_date", ["user_id"])
    tables.restore_partition(spark, path, backup, "batch_date", days)
    return _day_totals(tables.read_fact(spark, path, "batch_date"))


@query(
    "upsert_orders",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date, o_custkey, o_orderstatus,
  CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice + 2, 2)
    WHEN o_orderstatus = 'O' THEN round(o_totalprice + 1, 2) ELSE round(o_totalprice, 2) END AS o_totalprice
FROM orders""",
)
def upsert_orders(spark, sf):
    """The table holds finished and open orders; open and pending ones arrive with new totals, the latter twice.

    The merge refuses a source with two rows for a key, and takes it once the newer of each is chosen.
    """
    path = new_scratch(spark, "fct_orders")
    orders = inputs.orders(spark, sf).select("o_orderkey", "batch_date", "o_custkey", "o_orderstatus", "o_totalprice")
    committed.commit_days(orders.filter(F.col("o_orderstatus").isin("F", "O")), path, "batch_date", ["o_custkey"])
    source = orders.filter(F.col("o_orderstatus").isin("O", "P")).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    again = source.filter(F.col("o_orderstatus") == "P").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    source = source.withColumn("sent", F.lit(1)).unionByName(again.withColumn("sent", F.lit(2)))
    committed.merge_committed(
        source, path, "batch_date", ["o_orderkey", "batch_date"], ["o_totalprice", "o_custkey"], orders.columns, ["o_custkey"], ["sent"]
    )
    return tidy(committed.read_committed(spark, path, "batch_date").select(*orders.columns), 2)


@query(
    "broken_load",
    """WITH d AS (SELECT CAST(ts AS DATE) AS batch_date, count(*) AS n_rows,
    CAST(sum(CAST(value AS DECIMAL(28, 2))) AS DOUBLE) AS total_value FROM events GROUP BY 1)
SELECT phase, batch_date, CASE WHEN phase = 'repeated' AND batch_date >= DATE '2024-01-16' THEN 2 * n_rows ELSE n_rows END AS n_rows,
  CASE WHEN phase = 'repeated' AND batch_date >= DATE '2024-01-16' THEN 2 * total_value ELSE total_value END AS total_value
FROM d, (VALUES ('broken'), ('repeated')) p(phase)""",
)
def broken_load(spark, sf):
    """A load of the later days, each row twice, stops halfway: the table is as before. Repeated twice, it holds once."""
    path, events = new_scratch(spark, "fct_events"), inputs.events(spark, sf)
    committed.commit_days(events, path, "batch_date", ["user_id"])
    later = events.filter(F.col("batch_date") >= F.lit("2024-01-16").cast("date"))
    twice = later.unionByName(later)
    last = F.col("batch_date") == F.lit("2024-01-20").cast("date")
    failing = twice.withColumn("value", F.when(last, F.raise_error(F.lit("writer lost")).cast("double")).otherwise(F.col("value")))
    try:
        committed.commit_days(failing, path, "batch_date", ["user_id"])
    except Exception as error:
        if "writer lost" not in str(error):
            raise

    def seen(phase):
        rows = committed.read_committed(spark, path, "batch_date").groupBy("batch_date").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(money(F.col("value"))).cast("double").alias("total_value")
        )
        return materialize(rows.withColumn("phase", F.lit(phase)), "seen")

    broken = seen("broken")
    for _ in range(2):
        committed.commit_days(twice, path, "batch_date", ["user_id"])
    return broken.unionByName(seen("repeated"))


@query(
    "reconcile_versions",
    f"""WITH m AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date FROM orders),
c AS (SELECT * FROM m WHERE batch_date = DATE '{inputs.NULL_MONTH}' AND o_orderkey % 4 = 0)
SELECT o_orderkey, o_totalprice, batch_date, CAST(-1 AS BIGINT) AS n_diff FROM c
UNION ALL SELECT o_orderkey, NULL, batch_date, CAST(1 AS BIGINT) FROM c""",
)
def reconcile_versions(spark, sf):
    """All months are loaded again, one of them with totals gone: only that month is compared row by row."""
    path = new_scratch(spark, "fct_orders")
    orders = inputs.orders(spark, sf).select("o_orderkey", "o_totalprice", "batch_date")
    first = committed.commit_days(orders, path, "batch_date")
    gone = (F.col("batch_date") == F.lit(inputs.NULL_MONTH).cast("date")) & (F.col("o_orderkey") % 4 == 0)
    second = committed.commit_days(faults.blank(orders, "o_totalprice", gone), path, "batch_date")
    return tidy(committed.reconcile_versions(spark, path, "batch_date", first.turn, second.turn), 2)


@query(
    "delete_reload",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_date, o_custkey, o_orderstatus,
  CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
    THEN round(o_totalprice * 2, 2) ELSE round(o_totalprice, 2) END AS o_totalprice
FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
  AND (o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '1999-12-01'))""",
)
def delete_reload(spark, sf):
    """Reload the months of 1999 without finished orders and with no December at all; read the table back."""
    path = new_scratch(spark, "fct_orders")
    orders = inputs.orders(spark, sf).select("o_orderkey", "batch_date", "o_custkey", "o_orderstatus", "o_totalprice")
    tables.load_fact_partition(orders, path, "batch_date", ["o_custkey"])
    months = [f"1999-{m:02d}-01" for m in range(1, 13)]
    held = F.col("batch_date").isin([F.lit(m).cast("date") for m in months[:-1]]) & (F.col("o_orderstatus") != "F")
    source = orders.filter(held).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    tables.reload_batch(source, path, "batch_date", months, ["o_custkey"])
    return tidy(tables.read_fact(spark, path, "batch_date").select(*orders.columns), 2)


@query(
    "reconcile",
    "WITH "
    + FAULTY_SQL
    + """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(sum(s) AS BIGINT) AS n_diff FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, -1 AS s FROM orders
  UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1 FROM f_orders) x
GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice HAVING sum(s) <> 0""",
)
def reconcile(spark, sf):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    before, after = inputs.table(spark, sf, "orders"), inputs.faulty_orders(spark, sf)
    return merge.reconcile(before.select(*columns), after.select(*columns))


@query(
    "quarantine_split",
    "WITH "
    + FAULTY_SQL
    + """,
r AS (SELECT f.*, CASE WHEN c_custkey IS NOT NULL AND o_totalprice IS NOT NULL THEN 'clean' ELSE 'rejected' END AS route
  FROM f_orders f LEFT JOIN customer ON o_custkey = c_custkey)
SELECT route, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, min(o_orderkey) AS first_key,
  max(o_orderkey) AS last_key,
  CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS DOUBLE) AS total
FROM r GROUP BY route""",
)
def quarantine_split(spark, sf):
    """Rows without a known customer or a total go to quarantine, the others to staging; none is lost."""
    customer = inputs.table(spark, sf, "customer").select("c_custkey")
    orders = inputs.faulty_orders(spark, sf)
    flagged = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    valid = F.col("c_custkey").isNotNull() & F.col("o_totalprice").isNotNull()
    kept, aside = tables.write_split(
        flagged, valid, new_scratch(spark, "split"), "orders", "all", "unknown customer or no total"
    )
    both = spark.read.parquet(kept).withColumn("route", F.lit("clean")).unionByName(
        spark.read.parquet(aside).withColumn("route", F.lit("rejected"))
    )
    return both.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("o_orderkey").alias("n_keys"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
        F.sum(money(F.col("o_totalprice"))).cast("double").alias("total"),
    )


ITEM_KEY = ["l_orderkey", "l_linenumber"]


@query(
    "remediate_duplicates",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS batch_date, count(*) AS rows_before,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS excess_before,
  count(DISTINCT (l_orderkey, l_linenumber)) AS rows_after, CAST(0 AS BIGINT) AS excess_after
FROM lineitem GROUP BY 1""",
)
def remediate_duplicates(spark, sf):
    """Find the months with duplicate keys, back them up, rewrite them, recheck."""
    path, backup = new_scratch(spark, "fct_items"), new_scratch(spark, "bak_items")
    items = inputs.items(spark, sf)
    tables.load_fact_partition(items, path, "batch_date", ["l_partkey"])
    days = remediation.duplicate_days(spark, path, "batch_date", ITEM_KEY)
    outcome = remediation.repair_and_verify(
        spark, path, backup, "batch_date", ITEM_KEY, ["l_shipdate"], days, ["l_partkey"]
    )
    if any(state != "remediated" for _, state in outcome):
        raise RuntimeError(f"rolled back: {outcome}")
    before = keys.duplicate_excess(items, ITEM_KEY, by=["batch_date"])
    after = keys.duplicate_excess(tables.read_fact(spark, path, "batch_date"), ITEM_KEY, by=["batch_date"])
    return before.select("batch_date", F.col("n_rows").alias("rows_before"), F.col("excess").alias("excess_before")).join(
        after.select("batch_date", F.col("n_rows").alias("rows_after"), F.col("excess").alias("excess_after")),
        "batch_date",
    )

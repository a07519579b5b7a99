"""The given tables in the roles the checks know: customers, products, orders, items, events.

Orders and items come in monthly batches, events in daily ones. The faulty variants
carry every fault category at once, by fixed predicates that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.operators import faults
from batchkeeper.session import size_by

AS_OF = "2024-01-31 06:00:00"
NO_KEY = -99999  # a key no table holds, whatever its size

DUPLICATE_MONTH = "1999-03-01"
NULL_MONTH = "2000-06-01"
SHORT_DAY = "2024-01-15"
LONG_DAY = "2024-01-20"
LONG_TIMES = 5

# Declared schemas: nothing is inferred, so opening a table costs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    size_by(spark, path)
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def month(ts: str):
    return F.trunc(F.to_date(ts), "month")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("batch_date", month("o_orderdate"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("batch_date", month("l_shipdate"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("batch_date", F.to_date("ts"))


def faulty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans, appended duplicates, one month sent twice, one month with a quarter of its totals gone."""
    df = orders(spark, sf)
    df = faults.break_reference(df, "o_custkey", F.col("o_orderkey") < 100, NO_KEY)
    in_month = F.col("batch_date") == F.lit(NULL_MONTH).cast("date")
    df = faults.blank(df, "o_totalprice", in_month & (F.col("o_orderkey") % 4 == 0))
    df = faults.append_duplicates(df, F.col("o_orderkey") < 500)
    return faults.repeat_batch(df, "batch_date", DUPLICATE_MONTH, 2)


def faulty_events(spark: SparkSession, sf: str) -> DataFrame:
    """One day cut to 12 rows, another sent five times."""
    df = faults.truncate_batch(events(spark, sf), "batch_date", SHORT_DAY, ["event_id"], 12)
    return faults.repeat_batch(df, "batch_date", LONG_DAY, LONG_TIMES)


FAULTY_SQL = f"""
f_orders_1 AS (
  SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN {NO_KEY} ELSE o_custkey END AS o_custkey,
         o_orderstatus,
         CASE WHEN CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '{NULL_MONTH}' AND o_orderkey % 4 = 0
              THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders),
f_orders_2 AS (SELECT * FROM f_orders_1 UNION ALL SELECT * FROM f_orders_1 WHERE o_orderkey < 500),
f_orders AS (
  SELECT * FROM f_orders_2
  UNION ALL
  SELECT * FROM f_orders_2 WHERE CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '{DUPLICATE_MONTH}'),
f_events AS (
  SELECT * FROM events WHERE CAST(ts AS DATE) <> DATE '{SHORT_DAY}'
  UNION ALL
  SELECT * FROM (SELECT * FROM events WHERE CAST(ts AS DATE) = DATE '{SHORT_DAY}' ORDER BY event_id LIMIT 12) s
  UNION ALL
  SELECT e.* FROM events e, (SELECT unnest(generate_series(2, {LONG_TIMES}))) c
  WHERE CAST(ts AS DATE) = DATE '{LONG_DAY}')"""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and timestamps as text, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), f"`{f.name}`"
        if kind in ("double", "float"):
            out.append(f"round(CAST({c} AS DOUBLE), {digits}) + 0D AS {c}")
        elif kind.startswith("timestamp"):
            out.append(f"date_format({c}, 'yyyy-MM-dd HH:mm:ss') AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)

"""Synthetic retail feeds, generated in parallel and identical for a given seed.

Every value is a hash of (seed, row number), so any task can be recomputed and any
size generated without a driver loop; foreign keys hold by construction, because
customers and products are chosen by index.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchkeeper.contract import Contract
from batchkeeper.functions.scalars import padded_id, pick, pick_index, uniform
from batchkeeper.retail import (
    CATEGORIES,
    EVENT_TYPES,
    EVENT_WEIGHTS,
    ORDER_STATUSES,
    ORDER_WEIGHTS,
    REGIONS,
)

# Ranges of the generated columns.
SIGNUP_START, SIGNUP_DAYS = "2024-01-01", 600
PRICE_LOW, PRICE_HIGH = 5.0, 500.0
MAX_QUANTITY = 5
SECONDS_PER_DAY = 86_400


def _customer_id(index: Column) -> Column:
    return padded_id("CUST", 6, index)


def _product_id(index: Column) -> Column:
    return padded_id("PROD", 5, index)


def _price(seed: int, index: Column) -> Column:
    return F.round(F.lit(PRICE_LOW) + uniform(seed, "price", index) * (PRICE_HIGH - PRICE_LOW), 2)


def generate_customers(spark: SparkSession, customers: int, seed: int) -> DataFrame:
    i = F.col("id")
    days = (pick_index(uniform(seed, "signup", i), SIGNUP_DAYS + 1) - 1).cast("int")
    return spark.range(1, customers + 1).select(
        _customer_id(i).alias("customer_id"),
        F.concat(F.lit("Customer "), i.cast("string")).alias("name"),
        F.concat(F.lit("customer"), i.cast("string"), F.lit("@example.com")).alias("email"),
        pick(uniform(seed, "region", i), REGIONS).alias("region"),
        F.date_add(F.lit(SIGNUP_START).cast("date"), days).alias("signup_date"),
    )


def generate_products(spark: SparkSession, products: int, seed: int) -> DataFrame:
    i = F.col("id")
    return spark.range(1, products + 1).select(
        _product_id(i).alias("product_id"),
        F.concat(F.lit("Product "), i.cast("string")).alias("name"),
        pick(uniform(seed, "category", i), CATEGORIES).alias("category"),
        _price(seed, i).alias("price"),
    )


def _day_rows(spark: SparkSession, days: range, per_day: int, start: str, seed: int, ts: str) -> DataFrame:
    """``per_day`` rows for each day offset, with the batch date and a second drawn within that day."""
    rows = spark.range(days.start * per_day, days.stop * per_day).withColumn("n", F.col("id") + 1)
    offset = (F.floor(F.col("id") / F.lit(per_day))).cast("int")
    second = pick_index(uniform(seed, ts, F.col("id")), SECONDS_PER_DAY) - 1
    return rows.withColumn("batch_date", F.date_add(F.lit(start).cast("date"), offset)).withColumn(
        ts, F.timestamp_seconds(F.unix_seconds(F.col("batch_date").cast("timestamp")) + second)
    )


def generate_orders(
    spark: SparkSession, days: range, customers: int, products: int, per_day: int, start: str, seed: int
) -> DataFrame:
    n = F.col("n")
    product = pick_index(uniform(seed, "order_product", n), products)
    quantity = pick_index(uniform(seed, "quantity", n), MAX_QUANTITY).cast("int")
    return _day_rows(spark, days, per_day, start, seed, "order_ts").select(
        padded_id("ORD", 8, n).alias("order_id"),
        _customer_id(pick_index(uniform(seed, "order_customer", n), customers)).alias("customer_id"),
        _product_id(product).alias("product_id"),
        "order_ts",
        quantity.alias("quantity"),
        F.round(_price(seed, product) * quantity, 2).alias("order_total"),
        pick(uniform(seed, "status", n), ORDER_STATUSES, ORDER_WEIGHTS).alias("status"),
        "batch_date",
    )


def generate_events(
    spark: SparkSession, days: range, customers: int, per_day: int, start: str, seed: int
) -> DataFrame:
    n = F.col("n")
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("event"), n.cast("string")), 256)
    event_id = F.concat_ws(
        "-", *[F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    return _day_rows(spark, days, per_day, start, seed, "event_ts").select(
        event_id.alias("event_id"),
        _customer_id(pick_index(uniform(seed, "event_customer", n), customers)).alias("customer_id"),
        pick(uniform(seed, "event_type", n), EVENT_TYPES, EVENT_WEIGHTS).alias("event_type"),
        F.substring(digest, 33, 8).alias("session_id"),
        "event_ts",
        "batch_date",
    )


def generate_dataset(
    spark: SparkSession,
    days: int = 14,
    customers: int = 500,
    products: int = 60,
    orders_per_day: int = 300,
    events_per_day: int = 1200,
    start: str = "2026-06-01",
    seed: int = 42,
) -> dict[str, DataFrame]:
    """The four feeds as DataFrames; facts carry ``batch_date``."""
    return {
        "customers": generate_customers(spark, customers, seed),
        "products": generate_products(spark, products, seed),
        "orders": generate_orders(spark, range(days), customers, products, orders_per_day, start, seed),
        "events": generate_events(spark, range(days), customers, events_per_day, start, seed),
    }


def write_landing(
    spark: SparkSession,
    root: str,
    contract: Contract,
    days: int = 14,
    customers: int = 500,
    products: int = 60,
    orders_per_day: int = 300,
    events_per_day: int = 1200,
    start: str = "2026-06-01",
    seed: int = 42,
) -> None:
    """Write the feeds where the contract expects them: CSV dimensions, one batch per day for facts."""

    def text(df: DataFrame) -> DataFrame:
        stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
        return df.drop("batch_date").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in stamps})

    def write_csv(df: DataFrame, path: str) -> None:
        text(df).write.mode("overwrite").option("header", True).csv(path)

    write_csv(generate_customers(spark, customers, seed), contract["customers"].path(root))
    write_csv(generate_products(spark, products, seed), contract["products"].path(root))
    for offset in range(days):
        day, only = str(date.fromisoformat(start) + timedelta(days=offset)), range(offset, offset + 1)
        orders = generate_orders(spark, only, customers, products, orders_per_day, start, seed)
        write_csv(orders, contract["orders"].path(root, day))
        events = generate_events(spark, only, customers, events_per_day, start, seed)
        text(events).write.mode("overwrite").json(contract["events"].path(root, day))

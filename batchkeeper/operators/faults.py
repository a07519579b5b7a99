"""Faults to test against, each determined by keys and never by chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_column(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumnRenamed(column, to)


def currency_text(df: DataFrame, column: str, where: Column) -> DataFrame:
    """A number sent as ``$14.99`` text; the column as a whole becomes text."""
    money = F.concat(F.lit("$"), F.col(column).cast("decimal(28,2)").cast("string"))
    return df.withColumn(column, F.when(where, money).otherwise(F.col(column).cast("string")))


def truncate_batch(df: DataFrame, batch: str, day: str, order: Sequence[str], keep: int = 12) -> DataFrame:
    """Only the first rows (by key) of one batch arrive."""
    hit = F.col(batch).eqNullSafe(F.lit(day).cast("date"))
    return df.filter(~hit).unionByName(df.filter(hit).orderBy(*order).limit(keep))


def blank(df: DataFrame, column: str, where: Column) -> DataFrame:
    return df.withColumn(column, F.when(where, F.lit(None)).otherwise(F.col(column)))


def append_duplicates(df: DataFrame, where: Column) -> DataFrame:
    return df.unionByName(df.filter(where))


def break_reference(df: DataFrame, column: str, where: Column, missing) -> DataFrame:
    """Point some rows at a key that does not exist."""
    return df.withColumn(column, F.when(where, F.lit(missing)).otherwise(F.col(column)))


def make_stale(df: DataFrame, ts: str, where: Column, days: int) -> DataFrame:
    moved = F.col(ts) - F.make_dt_interval(F.lit(days))
    return df.withColumn(ts, F.when(where, moved).otherwise(F.col(ts)))


def repeat_batch(df: DataFrame, batch: str, day: str, times: int) -> DataFrame:
    """One batch arrives several times over."""
    copies = F.when(F.col(batch) == F.lit(day).cast("date"), F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")

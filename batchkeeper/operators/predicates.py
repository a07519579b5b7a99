"""Row-level filters and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_slice(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows whose event time falls on one day; pushed to the scan as a time range."""
    return df.filter(F.to_date(F.col(ts)) == F.lit(day).cast("date"))


def business_key(columns: Sequence[str], alias: str = "business_key") -> Column:
    """Composite key compared by value. Hashes are for bucketing only, never for equality."""
    return F.struct(*columns).alias(alias)


def null_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Key of every record with a NULL in one of ``columns``, and which columns those are."""
    named = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.filter(missing).select(*key, F.array_join(named, ",").alias("null_columns"))


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected). An undecided predicate rejects, so every row lands in exactly one side."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def split_null_keys(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a complete key, rows with a NULL in the key). NULL keys match nothing."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return df.filter(whole), df.filter(~whole)


def accepted_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Every value of a column with its row count and whether the contract knows it.

    NULL is left to the null-rate check and counts as accepted here.
    """
    value = F.col("value")
    return (
        df.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("accepted", value.isNull() | value.isin(*allowed))
    )

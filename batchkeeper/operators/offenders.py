"""Which keys a failed check is about: bounded samples per incident, for the batches that failed only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.operators.checks import CHECK_COLUMNS, failed
from batchkeeper.session import literal_table, materialize

SAMPLE = 5
SCHEMA = "dataset string, batch_date date, check_name string, column_name string, key_sample string, heavy_keys string"


def key_sample(counts: DataFrame, by: Sequence[str], key: Sequence[str], k: int = SAMPLE) -> DataFrame:
    """Per group the ``k`` lowest keys (``key_sample``) and the ``k`` keys with most rows (``heavy_keys``, as key x rows).

    ``counts``: the columns of ``by`` and ``key``, one row per key with its rows ``n``. Both lists are exact. Spark cuts each
    task's rows to ``k`` a group before it shuffles them, so a group of any size sends ``k`` rows a task.
    ``counts`` is read twice: hand in a written table.
    """
    label = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in key])

    def first(order: Sequence[Column], kind: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return counts.withColumn("_at", place).filter(F.col("_at") <= k).select(
            *by, F.lit(kind).alias("_kind"), F.struct("_at", label.alias("_key"), "n").alias("_found")
        )

    lowest, heaviest = first([F.col(c) for c in key], "lowest"), first([F.desc("n"), *[F.col(c) for c in key]], "heaviest")

    def joined(kind: str, text) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.col("_found"))))
        return F.array_join(F.transform(found, text), ",")

    return lowest.unionByName(heaviest).groupBy(*by).agg(
        joined("lowest", lambda x: x["_key"]).alias("key_sample"),
        joined("heaviest", lambda x: F.concat(x["_key"], F.lit(" x"), x["n"])).alias("heavy_keys"),
    )


def offending_keys(
    checks: DataFrame,
    df: DataFrame,
    dataset: str,
    batch: str,
    key: Sequence[str],
    references: Mapping[str, tuple[DataFrame, str]] | None = None,
    k: int = SAMPLE,
) -> DataFrame:
    """Samples of the keys behind each failed check of one dataset, under the dataset, batch, check and column.

    ``checks`` should be a stored table. Repeated keys, orphaned keys (``references``: column to table and its key) and the keys
    of rows whose value is NULL or zero. Checks that judge a batch as a whole (row counts, freshness, schema) have no
    keys. Batches that passed are not read again. Runs jobs: the checks that failed are listed (at most one
    per declared check), and each one's offending keys are written out.
    """
    bad = failed(checks.select(*CHECK_COLUMNS)).filter(F.col("dataset") == dataset)
    columns, references = set(df.columns), references or {}
    parts = []
    for check, column in sorted(
        (r["check_name"], r["column_name"] or "") for r in bad.select("check_name", "column_name").distinct().collect()
    ):
        days = bad.filter((F.col("check_name") == check) & F.col("column_name").eqNullSafe(F.lit(column))).select(F.col("batch_date").alias("_day"))
        rows = df.join(days.distinct(), F.col(batch).eqNullSafe(F.col("_day")), "left_semi")
        if check == "duplicates" and set(key) <= columns:
            own = list(key)
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own])
            counts = _counts(rows.filter(whole), batch, own).filter("n > 1")
        elif check == "foreign_key" and column in references and column in columns:
            own = [column]
            table, ref = references[column]
            known = table.select(F.col(ref).alias(column))
            counts = _counts(rows.filter(F.col(column).isNotNull()), batch, own).join(known, column, "left_anti")
        elif check in ("null_rate", "zero_rate") and column in columns and key and set(key) <= columns:
            own = list(key)
            counts = _counts(rows.filter(F.col(column).isNull() if check == "null_rate" else F.col(column) == 0), batch, own)
        else:
            continue
        sample = key_sample(materialize(counts, "offenders"), ["batch_date"], own, k)
        parts.append(
            sample.select(
                F.lit(dataset).alias("dataset"), "batch_date", F.lit(check).alias("check_name"),
                F.lit(column).alias("column_name"), "key_sample", "heavy_keys",
            )
        )
    if not parts:
        return literal_table(checks.sparkSession, [], SCHEMA)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counts(rows: DataFrame, batch: str, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(F.col(batch).alias("batch_date"), *key).agg(F.count(F.lit(1)).alias("n"))

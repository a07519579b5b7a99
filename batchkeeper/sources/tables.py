"""Parquet tables by path: staging, dimensions, day-partitioned facts and logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchkeeper.session import literal_table, materialize
from batchkeeper.sources.storage import drop_directory, exists, matching


def write_staging(df: DataFrame, root: str, dataset: str, date: str) -> str:
    """Write-truncate: a rerun resets the staged batch."""
    path = f"{root.rstrip('/')}/{dataset}/{date}"
    df.write.mode("overwrite").parquet(path)
    return path


POINTERS = "turn bigint, version string, folder string"


def publish_dimension(df: DataFrame, path: str, version: str) -> str:
    """Full refresh into a folder of its own, then a pointer to it: readers see the old or the new, never half.

    Publishing a version again writes another folder, so the one in use stays until the pointer moves.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    folder = f"version={version}/write={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    turn = 1
    if exists(spark, f"{root}/current"):
        turn += spark.read.schema(POINTERS).parquet(f"{root}/current").agg(F.max("turn")).first()[0] or 0
    literal_table(spark, [(turn, str(version), folder)], POINTERS).write.mode("append").parquet(f"{root}/current")
    return f"{root}/{folder}"


def read_dimension_table(spark: SparkSession, path: str) -> DataFrame:
    """What was published last, whatever its version is called."""
    root = path.rstrip("/")
    if not exists(spark, f"{root}/current"):
        raise FileNotFoundError(f"no published version under {path}")
    pointers = spark.read.schema(POINTERS).parquet(f"{root}/current")  # one row per refresh
    folder = pointers.agg(F.max_by("folder", "turn")).first()[0]
    return spark.read.parquet(f"{root}/{folder}")


def with_day(df: DataFrame, ts: str, day: str = "day") -> DataFrame:
    """Derive the partition column from the event time."""
    return df.withColumn(day, F.to_date(F.col(ts)))


def load_fact_partition(
    df: DataFrame,
    path: str,
    day: str,
    cluster_by: Sequence[str] = (),
    days: Iterable[str] = (),
) -> None:
    """Replace exactly the day partitions that ``df`` holds; loading twice changes nothing.

    The rebalance hint lets adaptive execution pack small days together and split a
    day that holds most of the rows, so neither tiny files nor one giant task results.
    """
    _replace_days(df, path, day, days, lambda d: d.hint("rebalance", day).sortWithinPartitions(day, *cluster_by))


def _replace_days(
    df: DataFrame, path: str, day: str, days: Iterable[str], arrange: Callable[[DataFrame], DataFrame]
) -> None:
    """Dynamic overwrite never clears a day that became empty: days named but without rows are dropped after it."""
    spark = df.sparkSession
    expected = {str(d) for d in days}
    seen = Observation()
    if expected:
        df = df.observe(seen, F.collect_set(F.col(day).cast("string")).alias("days"))  # one string per day
    writer = arrange(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day).parquet(path)
    if expected:
        for empty in expected - set(seen.get["days"] or []):
            drop_directory(spark, f"{path.rstrip('/')}/{day}={empty}")


def read_fact(
    spark: SparkSession, path: str, day: str, days: Sequence[str] | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """A fact table, pruned to the given day directories when there are any.

    A load without rows leaves a folder without a file, which names no columns: with a ``schema`` it reads as empty.
    """
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if days is None:
        return df
    return df.filter(F.col(day).isin([F.lit(str(d)).cast("date") for d in days]))


def backup_partition(
    spark: SparkSession, path: str, backup: str, day: str, days: Sequence[str], cluster_by: Sequence[str] = ()
) -> None:
    """Copy day slices aside before anything rewrites them. The slices are laid out already: no shuffle."""
    rows = read_fact(spark, path, day, days)
    _replace_days(rows, backup, day, days, lambda d: d.sortWithinPartitions(day, *cluster_by))


def restore_partition(
    spark: SparkSession, path: str, backup: str, day: str, days: Sequence[str], cluster_by: Sequence[str] = ()
) -> None:
    """Put the backed-up day slices back in place; a day that was absent then is dropped again."""
    backup_partition(spark, backup, path, day, days, cluster_by)


def merge_into_fact(
    source: DataFrame,
    path: str,
    day: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    insert_cols: Sequence[str],
    cluster_by: Sequence[str] = (),
) -> None:
    """MERGE into a day-partitioned table, reading and rewriting only the days the source touches.

    The source is written out once and read from there. Rows that share a key are refused, as
    either of them could win: see :func:`batchkeeper.operators.keys.dedupe_latest`.
    """
    from batchkeeper.operators.merge import require_unique, upsert

    spark = source.sparkSession
    source = materialize(source, "merge_source")
    require_unique(source, keys)
    touched = [str(r[0]) for r in source.select(day).distinct().collect()]  # one row per day
    merged = upsert(read_fact(spark, path, day, touched), source, keys, update_cols, insert_cols)
    # a table cannot be overwritten while it is read: write the result aside first
    load_fact_partition(materialize(merged, "merge"), path, day, cluster_by)


def reload_batch(
    source: DataFrame, path: str, day: str, batch_days: Sequence[str], cluster_by: Sequence[str] = ()
) -> None:
    """Delete the days of a batch and load the batch anew: rows it no longer holds are gone as well.

    ``batch_days`` are the days the batch stands for, also those it now has no rows for. Rows of any
    other day would replace days the batch has no say in, and are refused.
    """
    days = [F.lit(str(d)).cast("date") for d in batch_days]
    foreign = source.filter(~F.coalesce(F.col(day).isin(days), F.lit(False)))
    if not foreign.isEmpty():
        raise ValueError(f"the batch holds rows outside its days: {[tuple(r) for r in foreign.limit(3).collect()]}")
    load_fact_partition(source, path, day, cluster_by, days=batch_days)


def append_log(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append-only tables: audit trail, execution metrics."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_executions(
    checks: DataFrame, path: str, run_id: str, run_date: str, started_at, ended_at, datasets: Sequence[str] = ()
) -> None:
    """One row per executed check: run times, outcome, rows seen.

    A run replaces the rows of the date and datasets it holds, and of the ``datasets`` it named; all others stay.
    """
    rows = checks.select(
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(ended_at).cast("timestamp").alias("ended_at"),
        "*",
        F.lit(run_date).cast("date").alias("run_date"),
        F.lit(run_id).alias("run_id"),
    )
    _replace_pairs(rows, path, "run_date", [(run_date, d) for d in datasets])


def _replace_pairs(rows: DataFrame, path: str, date: str, pairs: Iterable[tuple[str, str]]) -> None:
    """Replace the (date, dataset) folders that ``rows`` holds, and drop the named ones it has nothing for."""
    rows = materialize(rows, "log_rows")  # they may stem from what is about to be replaced
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(date, "dataset").parquet(path)
    named = {(str(d), n) for d, n in pairs}
    if named:  # a handful of datasets
        held = {(str(r[0]), r[1]) for r in rows.select(date, "dataset").distinct().collect()}
        for day, dataset in named - held:
            drop_directory(rows.sparkSession, f"{path.rstrip('/')}/{date}={day}/dataset={dataset}")


def append_audit(df: DataFrame, path: str) -> None:
    append_log(df, path)


def write_incidents(
    incidents: DataFrame, path: str, pairs: Iterable[tuple[str, str]] = (), day: str = "execution_date"
) -> None:
    """Incident registry: one row per incident id, rewritten per execution date and dataset.

    ``pairs`` are the (date, dataset) that were judged, also those without an incident now.
    """
    _replace_pairs(incidents, path, day, pairs)


def quarantine(rejected: DataFrame, root: str, dataset: str, date: str, reason: str | Column) -> str:
    """Side output for rows kept out of a load; a rerun replaces its own batch."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return write_staging(rejected.withColumn("_reason", why), f"{root.rstrip('/')}/quarantine", dataset, date)


def write_split(df: DataFrame, valid: Column, root: str, dataset: str, date: str, reason: str) -> tuple[str, str]:
    """Write a batch once, clean rows to staging and all others to quarantine: (clean path, rejected path).

    One pass and no shuffle, whatever it took to decide which rows are valid.
    """
    path = f"{root.rstrip('/')}/split/{dataset}/{date}"
    ok = F.coalesce(valid, F.lit(False))
    routed = df.withColumns(
        {"_reason": F.when(~ok, F.lit(reason)), "route": F.when(ok, "clean").otherwise("rejected")}
    )
    routed.write.mode("overwrite").partitionBy("route").parquet(path)
    return f"{path}/route=clean", f"{path}/route=rejected"


def table_exists(spark: SparkSession, path: str) -> bool:
    return exists(spark, path)


def write_state(rows: DataFrame, path: str, ds: str) -> None:
    """What a day leaves for the next one (a row per series), in the day's own folder: a rerun replaces it."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/as_of={ds}")


def read_state(spark: SparkSession, path: str, ds: str, schema: str) -> DataFrame:
    """The newest state from before a day, empty if there is none. Only the names of folders and one folder are read."""
    done = matching(spark, f"{path}/as_of=*/_SUCCESS")  # a write that broke off counts for nothing
    days = [d for d in (p.split("/")[-2] for p in done) if d < f"as_of={ds}"]
    return spark.read.schema(schema).parquet(f"{path}/{max(days)}") if days else literal_table(spark, [], schema)

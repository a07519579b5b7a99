"""Business keys: duplicates, de-duplication, replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.operators.predicates import split_null_keys
from batchkeeper.session import materialize


def dedupe_latest(df: DataFrame, key: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """One row per key: the newest by ``newest_by``, ties broken by all other columns.

    Keys that occur more than once are found by a count over the key columns alone and
    written out (this runs a job), so their true size is known. Only their rows go through
    an aggregate, which first reduces each task's rows to one per key: a key that holds a
    third of the table never has to fit, or be sorted, in one task. All other rows pass as
    they are. Rows whose key has a NULL cannot be told apart and are all kept.
    """
    keyed, unkeyed = split_null_keys(df, key)
    lead = [c for c in newest_by if c not in key]
    ordered = lead + [c for c in df.columns if c not in key and c not in lead]
    if not ordered:
        return keyed.dropDuplicates(list(key)).select(*df.columns).unionByName(unkeyed)
    repeated = materialize(duplicate_keys(df, key).select(*key), "repeated_keys")
    several = keyed.join(repeated, list(key), "left_semi")
    newest = several.groupBy(*key).agg(F.max(F.struct(*ordered)).alias("_newest")).select(*key, "_newest.*")
    single = keyed.join(repeated, list(key), "left_anti")
    return single.select(*df.columns).unionByName(newest.select(*df.columns)).unionByName(unkeyed)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    keyed, _ = split_null_keys(df, key)
    return keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def duplicate_excess(df: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond one per key, overall or per batch.

    ``excess_raw`` is COUNT(*) - COUNT(DISTINCT key), which also counts rows whose key
    has a NULL; ``excess`` leaves those out (they are in ``n_null_key``). Two steps, so
    that rows are merged per key before anything is shuffled.
    """
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    columns = [*by, *[c for c in key if c not in by]]
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    n_rows = F.coalesce(F.sum("n"), F.lit(0))
    n_keys = F.count_if(whole)
    n_null = F.coalesce(F.sum(F.when(~whole, F.col("n"))), F.lit(0))
    return per_key.groupBy(*by).agg(
        n_rows.alias("n_rows"),
        n_keys.alias("n_keys"),
        n_null.alias("n_null_key"),
        (n_rows - n_keys).alias("excess_raw"),
        (n_rows - n_keys - n_null).alias("excess"),
    )


def replayed_keys(df: DataFrame, key: Sequence[str], batch: str) -> DataFrame:
    """Keys seen again in a later batch: per (first batch, replaying batch) how many, and what share.

    Each occurrence is paired with the key's first batch only, so the output per key
    grows with its batches and not with their square. The batches of a key are merged
    as a set before the one shuffle of the keys; a set is no longer than the calendar.
    """
    keyed, _ = split_null_keys(df.filter(F.col(batch).isNotNull()), key)
    seen = keyed.groupBy(*key).agg(F.collect_set(batch).alias("batches"))
    paired = seen.select(F.array_min("batches").alias("first_batch"), F.explode("batches").alias("replay_batch"))
    per_pair = paired.groupBy("first_batch", "replay_batch").agg(F.count(F.lit(1)).alias("n"))
    # one row per pair of batches from here on
    total = F.sum("n").over(Window.partitionBy("replay_batch"))
    return (
        per_pair.withColumn("n_batch_keys", total)
        .filter(F.col("replay_batch") > F.col("first_batch"))
        .select(
            "first_batch",
            "replay_batch",
            F.col("n").alias("n_keys"),
            (F.col("n") / F.col("n_batch_keys")).alias("share"),
        )
    )


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, bucket: Column, alias: str = "previous"
) -> DataFrame:
    """LAG(value) per key, without ever sorting a whole key in one task.

    Rows are ordered within (key, time bucket) only. Each bucket's last value is carried
    to the first row of the key's next bucket over one row per bucket. ``bucket`` must
    not decrease along ``order``; ``order`` must be total within a key.
    """
    within = Window.partitionBy(*key, "_bucket").orderBy(*order)
    local = df.withColumn("_bucket", bucket).withColumns(
        {"_near": F.lag(value).over(within), "_at": F.row_number().over(within)}
    )
    last = local.groupBy(*key, "_bucket").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*key).orderBy("_bucket")
    carried = last.withColumn("_carried", F.lag("_last").over(across)).drop("_last")
    previous = F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_near"))
    return local.join(carried, [*key, "_bucket"], "left").select(*df.columns, previous.alias(alias))

"""Upsert and replace, as joins whose result is written back by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.operators.keys import duplicate_keys
from batchkeeper.operators.predicates import split_null_keys


def require_unique(source: DataFrame, keys: Sequence[str], listed: int = 5) -> None:
    """Raise with some of the keys that occur more than once. Runs a job."""
    repeated = duplicate_keys(source, keys).orderBy(*keys).limit(listed).collect()
    if repeated:
        raise ValueError(f"source rows share a key {tuple(keys)}: {[tuple(r) for r in repeated]} (key, rows)")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    insert_cols: Sequence[str],
) -> DataFrame:
    """Matched rows take ``update_cols`` from the source, unmatched source rows are inserted.

    ``source`` must be unique by key (see ``require_unique``, ``dedupe_latest``). A left join for the rows
    that are there and an anti join, against distinct target keys, for those that are
    not: unlike one full outer join, both can broadcast a small source and split a key
    that fills much of the target. Rows with a NULL in the key match nothing: they stay,
    or are inserted, outside the joins.
    """
    kept, kept_unkeyed = split_null_keys(target, keys)
    given, given_unkeyed = split_null_keys(source, keys)
    types = {f.name: f.dataType for f in target.schema.fields}

    taken = [c for c in update_cols if c in source.columns and c not in keys]
    changes = given.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in taken], F.lit(True).alias("_matched"))
    joined = kept.join(changes, list(keys), "left")
    updated = joined.select(
        *[
            F.when(F.col("_matched"), F.col(f"_new_{c}").cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in taken
            else F.col(c)
            for c in target.columns
        ]
    )

    absent = given.join(kept.select(*keys).distinct(), list(keys), "left_anti").unionByName(given_unkeyed)
    inserted = absent.select(
        *[
            (F.col(c) if c in source.columns and (c in keys or c in insert_cols) else F.lit(None))
            .cast(types[c])
            .alias(c)
            for c in target.columns
        ]
    )
    return updated.unionByName(kept_unkeyed).unionByName(inserted)


def delete_and_reload(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove the target rows with a key of the batch, then append the batch.

    For batches that stand for whole days see :func:`batchkeeper.sources.tables.reload_batch`, which
    also removes the rows that the batch no longer holds.
    """
    return target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(
        source.select(*target.columns)
    )


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with the signed difference; empty when both hold the same rows.

    EXCEPT ALL in both directions, in one aggregation: rows count -1 on the one side
    and +1 on the other, and equal rows cancel before and after the shuffle.
    """
    columns = before.columns
    marked = before.select(*columns, F.lit(-1).alias("_sign")).unionByName(
        after.select(*columns, F.lit(1).alias("_sign"))
    )
    return marked.groupBy(*columns).agg(F.sum("_sign").alias("n_diff")).filter(F.col("n_diff") != 0)

"""What a column holds, in a few kilobytes: mergeable sketches, for hints about renamed columns and for profiles over days."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.functions.scalars import rate
from batchkeeper.operators.checks import profile_text, quoted

#: 2 ** 14 registers a column and day: a relative error of 0.8 %
DISTINCT_BITS = 14


def column_fingerprints(df: DataFrame) -> DataFrame:
    """(column_name, type, null_share, sketch): one aggregation over all columns, one row per column.

    The sketch keeps the few thousand smallest hashes of a column's values as text, so two of them tell how much two
    columns share; up to that many distinct values they are exact. Empty texts are no values.
    """
    names = df.columns
    whole = df.selectExpr(
        "count(1) AS n",
        *[f"count_if(`{c}` IS NULL) AS nulls_{i}" for i, c in enumerate(names)],
        *[f"theta_sketch_agg(CAST(`{c}` AS STRING)) AS sketch_{i}" for i, c in enumerate(names)],
    )
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    rows = [
        f"named_struct('column_name', {quoted(c)}, 'type', {quoted(kinds[i])}, 'n', n, 'nulls', nulls_{i}, 'sketch', sketch_{i})"
        for i, c in enumerate(names)
    ]
    return whole.selectExpr(f"inline(array({', '.join(rows)}))").select(
        "column_name", "type", rate(F.col("nulls"), F.col("n")).alias("null_share"), "sketch"
    )


def rename_hints(observed: DataFrame, expected: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """Missing and unexpected columns matched by what they hold: (expected_name, observed_name, kind, overlap).

    Both are :func:`column_fingerprints`, of the batch in hand and of one that was right; hand in written tables. ``overlap`` is
    the share of common values among all values of both columns. Only columns of one type are compared.

    * renamed: a missing and an unexpected column that are each other's best match, of at least ``min_overlap``;
    * swapped: two expected columns that hold each other's values and not their own (one row for each of them);
    * gone, new: a missing or an unexpected column without such a match; ``overlap`` is null.

    Ties go to the closer NULL share, then to the names. Values that are new in every batch (order numbers) give no
    hint. A column without values matches nothing. The pairs are those of one table's columns.
    """
    e = expected.selectExpr("column_name AS e_name", "type", "null_share AS e_null", "sketch AS e_sketch")
    o = observed.selectExpr("column_name AS o_name", "type", "null_share AS o_null", "sketch AS o_sketch")
    names_e, names_o = e.select(F.col("e_name").alias("name")), o.select(F.col("o_name").alias("name"))
    shared = names_e.join(names_o, "name", "left_semi")
    e = e.join(shared.selectExpr("name AS e_name", "true AS e_stays"), "e_name", "left")
    o = o.join(shared.selectExpr("name AS o_name", "true AS o_stays"), "o_name", "left")
    both = "theta_sketch_estimate({}(e_sketch, o_sketch))"
    pairs = e.join(o, "type").selectExpr(
        "e_name", "o_name", "e_stays", "o_stays", "abs(e_null - o_null) AS apart",
        f"coalesce({both.format('theta_intersection')} / nullif({both.format('theta_union')}, 0), 0D) AS overlap",
    )

    order = [F.desc("overlap"), "apart", "e_name", "o_name"]
    moved = pairs.filter("e_stays IS NULL AND o_stays IS NULL").filter(F.col("overlap") >= min_overlap)
    best = moved.withColumns(
        {
            "_e": F.row_number().over(Window.partitionBy("e_name").orderBy(*order)),
            "_o": F.row_number().over(Window.partitionBy("o_name").orderBy(*order)),
        }
    )
    renamed = best.filter("_e = 1 AND _o = 1").select("e_name", "o_name", F.lit("renamed").alias("kind"), "overlap")

    staying = pairs.filter("e_stays AND o_stays")
    own = staying.filter((F.col("e_name") == F.col("o_name")) & (F.col("overlap") < min_overlap)).select("e_name")
    crossed = staying.filter((F.col("e_name") != F.col("o_name")) & (F.col("overlap") >= min_overlap))
    crossed = crossed.join(own, "e_name", "left_semi")
    back = crossed.select(F.col("e_name").alias("o_name"), F.col("o_name").alias("e_name"))
    swapped = crossed.join(back, ["e_name", "o_name"], "left_semi").select("e_name", "o_name", F.lit("swapped").alias("kind"), "overlap")

    none = F.lit(None).cast("string")
    gone = e.filter("e_stays IS NULL").join(renamed, "e_name", "left_anti").select("e_name", none.alias("o_name"), F.lit("gone").alias("kind"))
    new = o.filter("o_stays IS NULL").join(renamed, "o_name", "left_anti").select(none.alias("e_name"), "o_name", F.lit("new").alias("kind"))
    unmatched = gone.unionByName(new).withColumn("overlap", F.lit(None).cast("double"))
    found = reduce(lambda a, b: a.unionByName(b), [renamed, swapped, unmatched])
    return found.select(F.col("e_name").alias("expected_name"), F.col("o_name").alias("observed_name"), "kind", "overlap")


def daily_profile(df: DataFrame, batch: str, columns: Sequence[str]) -> DataFrame:
    """One row per batch: rows, and of each column its NULLs, range and a sketch of its distinct values.

    Meant to be stored beside the table, partitioned by batch, and merged by :func:`merged_profile`: a closed day is read once.
    One aggregation, reduced to one row per task and batch before the shuffle.
    """
    parts = [
        text
        for i, c in enumerate(columns)
        for text in (
            f"count_if(`{c}` IS NULL) AS nulls_{i}", f"min(`{c}`) AS low_{i}", f"max(`{c}`) AS high_{i}",
            f"hll_sketch_agg(CAST(`{c}` AS STRING), {DISTINCT_BITS}) AS values_{i}",
        )
    ]
    return df.groupBy(F.col(batch).alias("batch_date")).agg(F.expr("count(1) AS n_rows"), *map(F.expr, parts))


def merged_profile(daily: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``checks.profile`` for any set of stored days; ``n_distinct`` is an estimate.

    ``columns`` in the order of :func:`daily_profile`. No row of the table itself is read again. Without days the counts are 0.
    """
    sums = [
        text
        for i in range(len(columns))
        for text in (
            f"coalesce(sum(nulls_{i}), 0) AS nulls_{i}", f"min(low_{i}) AS low_{i}", f"max(high_{i}) AS high_{i}",
            f"coalesce(hll_sketch_estimate(hll_union_agg(values_{i})), 0) AS distinct_{i}",
        )
    ]
    kinds = {f.name: f.dataType.typeName() for f in daily.schema.fields}
    rows = [
        f"named_struct('dataset', {quoted(dataset)}, 'column_name', {quoted(c)}, 'n_rows', n, 'n_null', nulls_{i}, 'n_distinct', "
        f"distinct_{i}, 'min_value', {profile_text(kinds[f'low_{i}']).format(f'low_{i}')}, "
        f"'max_value', {profile_text(kinds[f'high_{i}']).format(f'high_{i}')})"
        for i, c in enumerate(columns)
    ]
    return daily.selectExpr("coalesce(sum(n_rows), 0) AS n", *sums).selectExpr(f"inline(array({', '.join(rows)}))")

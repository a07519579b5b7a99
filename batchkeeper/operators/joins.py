"""References between datasets.

Foreign-key columns are reduced to their distinct values (with row counts) before
they meet the dimension: map-side aggregation flattens hot keys, only one narrow
column is read, and the fact table itself is never shuffled for a check. No side is
broadcast by hint; Spark does so where its own size check allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.functions.scalars import money
from batchkeeper.session import materialize, new_scratch


def _key_counts(fact: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return fact.groupBy(*by, F.col(column).alias("fk")).agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(fact: DataFrame, column: str, dim: DataFrame, ref: str) -> DataFrame:
    """(fk, n): non-NULL key values without a match. A NULL key is a null-rate matter, not an orphan."""
    used = _key_counts(fact.filter(F.col(column).isNotNull()), column)
    return used.join(dim.select(F.col(ref).alias("fk")), "fk", "left_anti")


def fk_orphans(fact: DataFrame, column: str, dim: DataFrame, ref: str) -> DataFrame:
    """The offending rows themselves. Runs a job that writes the orphan keys.

    Their true size is then known when the fact is joined: few keys are broadcast and
    the fact is not shuffled; many are joined by key with skew handling.
    """
    bad = materialize(orphan_keys(fact, column, dim, ref).select(F.col("fk").alias(column)), "orphans")
    return fact.join(bad, column, "left_semi").select(*fact.columns)


def fk_report(fact: DataFrame, column: str, dim: DataFrame, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, NULLs, matches and orphans of one reference, overall or per batch. No row is dropped."""
    known = dim.selectExpr(f"`{ref}` AS fk").distinct().selectExpr("fk", "true AS known")
    flagged = _key_counts(fact, column, by).join(known, "fk", "left")
    orphan = "fk IS NOT NULL AND known IS NULL"
    totals = [
        "coalesce(sum(n), 0) AS n_rows",
        "coalesce(sum(n) FILTER (WHERE fk IS NULL), 0) AS n_null",
        "coalesce(sum(n) FILTER (WHERE known), 0) AS n_matched",
        f"coalesce(sum(n) FILTER (WHERE {orphan}), 0) AS n_orphan",
        f"count_if({orphan}) AS n_orphan_keys",
    ]
    return flagged.groupBy(*by).agg(*map(F.expr, totals))


def orphan_sample(orphans: DataFrame, k: int) -> DataFrame:
    """The k lowest orphan keys, the same ones in every run."""
    return orphans.orderBy("fk").limit(k)


def orphan_summary(orphans: DataFrame, k: int) -> DataFrame:
    """Orphaned rows and keys, with a sample of the k lowest keys. Only those k keys are ever collected."""
    none = F.lit(None).cast("bigint")
    totals = orphans.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphan"), F.count(F.lit(1)).alias("n_orphan_keys")
    )
    lowest = F.transform(F.sort_array(F.collect_list("fk")), lambda x: x.cast("string"))
    sample = orphan_sample(orphans, k).agg(F.array_join(lowest, ",").alias("sample"))
    # one row each; put side by side without a join
    both = totals.withColumn("sample", F.lit(None).cast("string")).unionByName(
        sample.select(none.alias("n_orphan"), none.alias("n_orphan_keys"), "sample")
    )
    return both.agg(*[F.max(c).alias(c) for c in ("n_orphan", "n_orphan_keys", "sample")])


def enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str, Sequence[str]]]) -> DataFrame:
    """Left-join attributes from other tables: (table, fact column, key column, wanted columns) each.

    Unmatched rows stay, with NULL attributes. Keys of the joined tables must be unique.
    """
    out = fact
    for table, column, ref, wanted in dims:
        side = table.select(F.col(ref).alias(f"_{ref}"), *wanted)
        out = out.join(side, F.col(column) == F.col(f"_{ref}"), "left").drop(f"_{ref}")
    return out


def touched_partitions(target: DataFrame, source: DataFrame, day: str) -> DataFrame:
    """Days of the target that a source touches, with the target's row count there."""
    days = target.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"))
    return days.join(source.select(day).distinct(), day, "left_semi")


def amount_consistency(
    items: DataFrame,
    product_key: str,
    quantity: str,
    amount: str,
    products: DataFrame,
    ref: str,
    price: str,
    by: Sequence[str],
) -> DataFrame:
    """Where the stored amount is not price times quantity, in exact cents, per group."""
    priced = enrich(items, [(products, product_key, ref, [price])])
    diff = F.abs(money(F.col(amount)) - money(F.round(F.col(price) * F.col(quantity), 2)))
    return priced.withColumn("_diff", diff).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_diff") > 0).alias("n_bad"),
        F.count_if(F.col("_diff").isNull()).alias("n_unpriced"),
        F.sum("_diff").cast("double").alias("total_diff"),
        F.max("_diff").cast("double").alias("max_diff"),
    )


def blast_radius(
    edges: DataFrame, start: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """(node, depth): everything downstream of ``start``, at its smallest distance. Runs jobs.

    ``edges(src, dst)``, ``start(node)``; columns named in ``by`` are carried from the
    start nodes and keep several starts apart. A breadth-first join to the fixpoint:
    every round joins only the nodes found last against the edges and keeps what is new,
    so cycles end and each node is expanded once. Each round adds a folder to one table,
    which keeps plans as short in the last round as in the first and survives lost executors.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst")
    root = new_scratch(spark, "reach")
    first = start.select(*by, "node").distinct().withColumn("depth", F.lit(0))
    first.write.parquet(f"{root}/round=0")
    depth = 0
    while True:
        frontier = spark.read.schema(first.schema).parquet(f"{root}/round={depth}")
        found = spark.read.schema(first.schema).parquet(root)
        if frontier.isEmpty():
            return found.select(*first.columns)
        depth += 1
        step = frontier.select(*by, F.col("node").alias("src")).join(edges, "src")
        reached = step.select(*by, F.col("dst").alias("node")).distinct()
        new = reached.join(found.select(*by, "node"), [*by, "node"], "left_anti")
        new.withColumn("depth", F.lit(depth)).write.parquet(f"{root}/round={depth}")


def deep_reach(edges: DataFrame, start: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What :func:`blast_radius` gives, in rounds that grow with the logarithm of the depth. Runs jobs.

    Round k joins all found so far, up to 2^k - 1 levels deep, with the walks of exactly 2^k edges, and the walks
    with themselves. A shortest path is a path found earlier and one such walk, so depths are exact; cycles end
    as nothing new is found. On chains and trees the walks are never more than the nodes. Where many tables meet
    in one node and leave it again, walks multiply: for graphs of rows with such nodes take ``blast_radius``.
    """
    walks = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    found = materialize(start.select(*by, "node").distinct().withColumn("depth", F.lit(0)), "reach")
    parts, length = [found], 1
    while True:
        walks = materialize(walks, "walks")
        step = found.withColumnRenamed("node", "src").join(walks, "src")
        reached = step.groupBy(*by, F.col("dst").alias("node")).agg(F.min(F.col("depth") + length).cast("int").alias("depth"))
        new = materialize(reached.join(found.select(*by, "node"), [*by, "node"], "left_anti"), "reach")
        if new.isEmpty():
            return found.select(*by, "node", "depth")
        parts.append(new)
        found = reduce(lambda a, b: a.unionByName(b), parts)
        onward = walks.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        walks = walks.withColumnRenamed("dst", "mid").join(onward, "mid").select("src", F.col("to").alias("dst")).distinct()
        length *= 2

import datetime
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from batchkeeper.sources import tables
from batchkeeper.operators import joins, keys, merge, predicates
from batchkeeper.session import materialize


def test_dedupe_keeps_the_newest_and_every_unkeyed_row(spark):
    df = spark.createDataFrame(
        [(1, 5, "old"), (1, 9, "new"), (1, 9, "mew"), (2, None, "x"), (2, 1, "y"), (None, 1, "a"), (None, 1, "a")],
        "k int, at int, v string",
    )
    got = rows(keys.dedupe_latest(df, ["k"], ["at"]))
    assert got == [(None, 1, "a"), (None, 1, "a"), (1, 9, "new"), (2, 1, "y")]


def test_dedupe_of_a_hot_key_leaves_one_row_per_task_to_shuffle(spark):
    df = spark.range(10000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("at")
    )
    out = keys.dedupe_latest(df, ["k"], ["at"])
    assert out.count() == 3335
    assert out.filter("k = -1").first()["at"] == 9998
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_duplicate_counts_with_null_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (1,)], "k int")
    row = keys.duplicate_excess(df, ["k"]).first()
    assert (row["n_rows"], row["n_keys"], row["n_null_key"], row["excess_raw"], row["excess"]) == (4, 1, 1, 3, 2)
    assert rows(keys.duplicate_keys(df, ["k"])) == [(1, 3)]
    empty = keys.duplicate_excess(df.limit(0), ["k"]).first()
    assert (empty["n_rows"], empty["excess"]) == (0, 0)


def test_replayed_keys_pair_with_the_first_batch_only(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 2), ("c", 3)], "k string, b int")
    assert rows(keys.replayed_keys(df, ["k"], "b")) == [(1, 2, 1, 0.5), (1, 3, 1, 0.5)]


def test_previous_value_equals_a_plain_lag(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 500).alias("at"), (F.col("id") % 7).alias("v")
    )
    from pyspark.sql import Window

    plain = df.withColumn("previous", F.lag("v").over(Window.partitionBy("k").orderBy("at")))
    bucketed = keys.with_previous(df, ["k"], ["at"], "v", F.floor(F.col("at") / 20))
    assert rows(plain) == rows(bucketed)


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 99), (5, 99), (6, 98)], "o int, c int")


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([(10,), (11,), (12,), (11,)], "id int")


def test_orphans_are_not_nulls(spark, orders, customers):
    assert rows(joins.fk_orphans(orders, "c", customers, "id")) == [(4, 99), (5, 99), (6, 98)]
    report = joins.fk_report(orders, "c", customers, "id").first()
    assert tuple(report) == (6, 1, 2, 3, 2)
    empty = joins.fk_report(orders.limit(0), "c", customers, "id").first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_orphan_summary(spark, orders, customers):
    orphans = joins.orphan_keys(orders, "c", customers, "id")
    assert tuple(joins.orphan_summary(orphans, 1).first()) == (3, 2, "98")
    assert tuple(joins.orphan_summary(orphans.limit(0), 5).first()) == (0, 0, "")


def test_enrich_keeps_unmatched_rows(spark, orders):
    names = spark.createDataFrame([(10, "x"), (11, "y")], "id int, name string")
    assert joins.enrich(orders, [(names, "c", "id", ["name"])]).count() == 6


def test_blast_radius_ends_on_cycles(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, dst string"
    )
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(joins.blast_radius(edges, start)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(joins.deep_reach(edges, start)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_split_loses_no_row(spark, orders):
    clean, rejected = predicates.split_valid(orders, F.col("c") < 50)
    assert (clean.count(), rejected.count()) == (2, 4)


def test_null_rows_and_accepted_values(spark, orders):
    assert rows(predicates.null_rows(orders, ["o"], ["c"])) == [(3, "c")]
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "v string")
    assert rows(predicates.accepted_values(df, "v", ["a"])) == [(None, 1, True), ("a", 2, True), ("b", 1, False)]


def test_upsert(spark):
    schema = "k int, day string, total int, created string"
    target = spark.createDataFrame([(1, "d", 10, "t"), (2, "d", 20, "t"), (None, "d", 5, "t")], schema)
    source = spark.createDataFrame([(2, "d", 21, "s"), (3, "d", 30, "s"), (2, "e", 7, "s"), (None, "d", 6, "s")], schema)
    got = rows(merge.upsert(target, source, ["k", "day"], ["total"], ["k", "day", "total"]))
    assert got == [
        (None, "d", 5, "t"), (None, "d", 6, None), (1, "d", 10, "t"), (2, "d", 21, "t"), (2, "e", 7, None),
        (3, "d", 30, None),
    ]


def test_delete_reload_and_reconcile(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c")], "k int, v string")
    after = merge.delete_and_reload(target, batch, ["k"])
    assert rows(after) == [(1, "a"), (2, "c")]
    assert rows(merge.reconcile(target, after)) == [(2, "b", -2), (2, "c", 1)]
    assert merge.reconcile(after, after).count() == 0


def test_touched_partitions(spark):
    d = datetime.date
    target = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 1),), (d(2024, 1, 2),)], "day date")
    source = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 9),)], "day date")
    assert rows(joins.touched_partitions(target, source, "day")) == [(d(2024, 1, 1), 2)]


def test_upsert_refuses_sources_that_share_a_key(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    with pytest.raises(ValueError, match=r"\(1, 2\)"):
        merge.require_unique(source, ["k"])
    merge.require_unique(source.filter("v <> 'b'"), ["k"])


def test_reload_clears_what_the_batch_no_longer_holds(spark, tmp_path):
    path = str(tmp_path / "fct")
    rows_ = [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-02"), (4, "2024-01-03")]
    df = spark.createDataFrame(rows_, "k int, d string").selectExpr("k", "cast(d as date) as day")
    tables.load_fact_partition(df, path, "day")
    tables.reload_batch(df.filter("k = 2"), path, "day", ["2024-01-01", "2024-01-02"])
    assert rows(tables.read_fact(spark, path, "day").select("k")) == [(2,), (4,)]
    with pytest.raises(ValueError, match="outside"):
        tables.reload_batch(df, path, "day", ["2024-01-01"])


def test_lineage_of_any_depth_resolves(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "src string, dst string")
    reached = joins.blast_radius(edges, spark.createDataFrame([("n0",)], "node string"))
    assert sorted(r["depth"] for r in reached.collect()) == list(range(71))


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(joins, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    edges = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    reached = joins.deep_reach(edges, spark.range(1).select(F.col("id").alias("node")))
    assert sorted((r["node"], r["depth"]) for r in reached.collect()) == [(i, i) for i in range(1001)]
    assert rounds.count("walks") <= 12


def test_deep_reach_equals_a_plain_walk(spark):
    rng = random.Random(2)
    for n, m in ((12, 18), (30, 36), (25, 60)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        starts = [("p", 0), ("p", 1), ("q", 2)]
        want = {}
        for tag in ("p", "q"):
            depth = {s: 0 for t, s in starts if t == tag}
            queue = list(depth)
            for u in queue:
                for a, b in pairs:
                    if a == u and b not in depth:
                        depth[b] = depth[u] + 1
                        queue.append(b)
            want |= {(tag, v): d for v, d in depth.items()}
        edges = spark.createDataFrame(pairs + pairs[:2] + [(None, 1)], "src int, dst int")
        got = joins.deep_reach(edges, spark.createDataFrame(starts, "tag string, node int"), by=["tag"])
        assert {(r["tag"], r["node"]): r["depth"] for r in got.collect()} == want
    assert joins.deep_reach(edges.limit(0), spark.createDataFrame([(1,)], "node int")).count() == 1

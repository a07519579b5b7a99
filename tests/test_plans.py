"""Plan shapes that must hold at any size."""

import datetime
import os

import pytest

from batchkeeper.operators import checks, joins, keys, predicates
from batchkeeper.plans import inputs
from batchkeeper.plans.catalog import QUERIES
from batchkeeper.sources import tables

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

# these run jobs while they are built, and hand back a table they wrote
RUNS_JOBS = {
    "load_partition_idempotent", "rollback_partition", "upsert_orders", "delete_reload", "dedupe_latest", "remediate_duplicates", "quarantine_split",
    "incident_registry", "audit_trail", "executions", "blast_radius",
    "stream_dedupe", "stream_volume", "stream_freshness", "stream_load", "stream_late", "stream_dedupe_late",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS))
def test_no_pair_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert node not in text


def test_day_slice_reaches_the_scan(spark):
    text = plan(predicates.day_slice(inputs.table(spark, SF, "events"), "ts", "2024-01-15"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_reference_check_reads_one_column_and_combines_before_the_shuffle(spark):
    items, part = inputs.table(spark, SF, "lineitem"), inputs.table(spark, SF, "part")
    text = plan(joins.fk_report(items, "l_partkey", part, "p_partkey"))
    assert "ReadSchema: struct<l_partkey:bigint>" in text and "partial_count(1)" in text


def test_day_directories_are_pruned(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([(1, datetime.date(2024, 1, d)) for d in (1, 2, 3)], "k int, day date")
    tables.load_fact_partition(df, path, "day")
    pruned = tables.read_fact(spark, path, "day", ["2024-01-02"])
    assert "PartitionFilters: [isnotnull(day" in plan(pruned) and len(pruned.inputFiles()) == 3
    assert pruned.count() == 1


def test_one_scan_serves_all_checks_of_a_dataset(spark):
    orders = inputs.orders(spark, SF)
    profile = checks.batch_profile(orders, "orders", "batch_date", ["o_orderkey"], ["o_custkey"], ts="o_orderdate")
    bounded = checks.with_newest(checks.fill_missing_batches(checks.relative_bounds(profile, 0.2, 0.2), "1 month"))
    rows = checks.rows_of(
        bounded, checks.row_count_row(), checks.duplicate_row(["o_orderkey"]), checks.null_rate_row("o_custkey", 0.0),
        checks.newest_row("o_orderdate", inputs.AS_OF, 26),
    )
    assert plan(rows).count("FileScan") == 1


def test_rows_with_a_key_of_their_own_are_neither_sorted_nor_shuffled(spark):
    items = inputs.table(spark, SF, "lineitem")
    newest = keys.dedupe_latest(items, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    newest.collect()
    text = plan(newest).split("== Initial Plan ==")[0]
    assert "Window" not in text and "SortMergeJoin" not in text
    unique = text[: text.index("_newest")]  # the part of the union that rows with a key of their own take
    assert "LeftAnti" in unique and "Sort" not in unique and "hashpartitioning" not in unique


def test_replays_shuffle_the_keys_once(spark):
    text = plan(keys.replayed_keys(inputs.items(spark, SF), ["l_orderkey", "l_linenumber"], "batch_date"))
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1


def test_rule_tables_are_local(spark):
    from batchkeeper.contract import policy_frame

    assert "LocalTableScan" in plan(policy_frame(spark, {"a": "escalate"}))


def test_shuffles_are_sized_by_input(spark, tmp_path):
    from batchkeeper import session

    before = session.INPUT_PER_PARTITION
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    try:
        session.INPUT_PER_PARTITION = 100
        session.configure(spark, str(tmp_path / "t"))
        wanted = session.folder_size(spark, str(tmp_path / "t")) // 100
        assert wanted > 4  # and no limit above
        assert wanted == int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    finally:
        session.INPUT_PER_PARTITION = before
        session.configure(spark, str(tmp_path / "t"))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "4"
    session.configure(spark)

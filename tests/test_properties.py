"""Operators against a few lines of plain Python, on random small tables."""

from frames import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from batchkeeper.operators import baselines, joins, keys, merge

QUICK = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
key = st.one_of(st.none(), st.integers(0, 4))
small = st.integers(0, 3)


def order(values):
    return sorted(values, key=lambda t: tuple((v is not None, v) for v in t))


@QUICK
@given(st.lists(st.tuples(key, small, small), max_size=12))
def test_dedupe(spark, data):
    df = spark.createDataFrame(data, "k int, at int, v int")
    best = {}
    for k, at, v in data:
        if k is not None:
            best[k] = max(best.get(k, (-1, -1)), (at, v))
    expected = [(k, *b) for k, b in best.items()] + [r for r in data if r[0] is None]
    assert rows(keys.dedupe_latest(df, ["k"], ["at"])) == order(expected)
    excess = keys.duplicate_excess(df, ["k"]).first()
    assert excess["excess"] == len(data) - len(expected)


@QUICK
@given(st.lists(st.tuples(key, small), max_size=8), st.dictionaries(small, small, max_size=4))
def test_upsert(spark, target, source):
    t = spark.createDataFrame(target, "k int, v int")
    s = spark.createDataFrame(list(source.items()), "k int, v int")
    expected = [(k, source.get(k, v)) for k, v in target]
    expected += [(k, v) for k, v in source.items() if k not in {k for k, _ in target}]
    assert rows(merge.upsert(t, s, ["k"], ["v"], ["k", "v"])) == order(expected)


@QUICK
@given(st.lists(st.tuples(small, small), max_size=8), st.lists(st.tuples(small, small), max_size=8))
def test_reconcile(spark, before, after):
    schema = "a int, b int"
    diff = rows(merge.reconcile(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)))
    expected = [(*r, after.count(r) - before.count(r)) for r in set(before) | set(after)]
    assert diff == order([r for r in expected if r[2]])


@QUICK
@given(st.lists(key, max_size=10), st.lists(small, max_size=5))
def test_references(spark, facts, dim):
    f = spark.createDataFrame([(v,) for v in facts], "fk int")
    d = spark.createDataFrame([(v,) for v in dim], "id int")
    orphans = [v for v in facts if v is not None and v not in dim]
    nulls = facts.count(None)
    got = tuple(joins.fk_report(f, "fk", d, "id").first())
    assert got == (len(facts), nulls, len(facts) - nulls - len(orphans), len(orphans), len(set(orphans)))


@QUICK
@given(st.lists(st.integers(0, 50), min_size=1, max_size=10))
def test_holt(spark, series):
    from datetime import date, timedelta

    data = [("s", date(2024, 1, 1) + timedelta(days=i), n) for i, n in enumerate(series)]
    df = spark.createDataFrame(data, "dataset string, batch_date date, n_rows bigint")
    got = [r["forecast"] for r in baselines.holt_forecast(df, 0.4, 0.2).orderBy("batch_date").collect()]
    level, trend, expected = float(series[0]), 0.0, [None]
    for y in series[1:]:
        forecast = level + trend
        expected.append(forecast)
        new = 0.4 * y + 0.6 * forecast
        level, trend = new, 0.2 * (new - level) + 0.8 * trend
    assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], expected[1:]))

"""Loads of several days that become visible at once, or not at all."""

import pytest
from pyspark.sql import functions as F

from batchkeeper.sources import committed
from batchkeeper.sources.storage import matching
from frames import rows

DAYS = ["2026-01-01", "2026-01-02", "2026-01-03"]


def batch(spark, values):
    df = spark.createDataFrame([(k, d, v) for k, d, v in values], "k long, d string, v double")
    return df.select("k", F.col("d").cast("date").alias("day"), "v")


def content(spark, root, **kind):
    return [(k, str(d), v) for k, d, v in rows(committed.read_committed(spark, root, "day", **kind))]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "fct")
    committed.commit_days(batch(spark, [(i, DAYS[i % 3], float(i)) for i in range(9)]), path, "day", ["k"])
    return path


def test_a_load_replaces_its_days_and_clears_named_ones(spark, root):
    before = content(spark, root)
    committed.commit_days(batch(spark, [(100, DAYS[0], 1.0), (101, None, 2.0)]), root, "day", days=DAYS[:2])
    want = sorted([(100, DAYS[0], 1.0), (101, "None", 2.0), *[r for r in before if r[1] == DAYS[2]]])
    assert sorted(content(spark, root)) == want
    assert content(spark, root, turn=1) == before  # the old version can still be read
    committed.roll_back(spark, root, 1)
    assert content(spark, root) == before


def test_loading_twice_changes_nothing(spark, root):
    again = batch(spark, [(i, DAYS[i % 3], float(i)) for i in range(9)]).repartition(5)
    old = committed.version(spark, root)
    new = committed.commit_days(again, root, "day")
    assert committed.changed_days(old, new) == [] and new.turn == old.turn + 1


def test_a_load_that_breaks_leaves_the_old_table(spark, root):
    before = content(spark, root)
    values = batch(spark, [(i, DAYS[i % 3], -1.0) for i in range(90)]).repartition(6)
    broken = values.withColumn("v", F.when(F.col("k") == 77, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        committed.commit_days(broken, root, "day")
    assert content(spark, root) == before
    # a writer that died while it published
    spark.range(1).write.parquet(f"{root}/manifest/turn=2")
    assert content(spark, root, turn=1) == before
    from batchkeeper.sources.storage import drop_directory

    drop_directory(spark, f"{root}/manifest/turn=2/_SUCCESS")
    assert content(spark, root) == before
    assert committed.commit_days(values, root, "day").turn == 3


def test_files_that_differ_from_what_was_written_are_not_published(spark, root, monkeypatch):
    before = content(spark, root)
    real = committed.loaded

    def short(spark, path, schema, day):
        found = real(spark, path, schema, day)
        d = sorted(found)[0]
        return {**found, d: committed.Slice("", found[d].n_rows, str(int(found[d].digest) + 1))}

    monkeypatch.setattr(committed, "loaded", short)
    with pytest.raises(committed.LoadMismatch):
        committed.commit_days(batch(spark, [(1, DAYS[0], 5.0)]), root, "day")
    assert content(spark, root) == before


def test_merge_reads_touched_days_only(spark, root):
    source = batch(spark, [(0, DAYS[0], 50.0), (200, DAYS[0], 7.0)])
    committed.merge_committed(source, root, "day", ["k", "day"], ["v"], ["k", "day", "v"])
    new = committed.version(spark, root)
    assert {d: s.folder == new.days[DAYS[0]].folder for d, s in new.days.items()} == dict(zip(DAYS, (True, False, False), strict=True))
    got = {k: v for k, d, v in content(spark, root) if d == DAYS[0]}
    assert got == {0: 50.0, 3: 3.0, 6: 6.0, 200: 7.0}
    twice = batch(spark, [(0, DAYS[0], 1.0), (0, DAYS[0], 2.0)])
    with pytest.raises(ValueError, match="share a key"):
        committed.merge_committed(twice, root, "day", ["k", "day"], ["v"], ["k", "day", "v"])
    sent = twice.withColumn("sent", F.col("v"))
    committed.merge_committed(sent, root, "day", ["k", "day"], ["v"], ["k", "day", "v"], newest_by=["sent"])
    assert {k: v for k, d, v in content(spark, root) if d == DAYS[0]}[0] == 2.0


def test_versions_are_compared_without_reading_equal_days(spark, root):
    changed = batch(spark, [(i, DAYS[i % 3], float(i) + (i == 4)) for i in range(9)])
    committed.commit_days(changed, root, "day")
    diff = committed.reconcile_versions(spark, root, "day", 1, 2)
    assert sorted((r.k, r.v, r.n_diff) for r in diff.collect()) == [(4, 4.0, -1), (4, 5.0, 1)]
    assert all(f"day={DAYS[1]}" in f for f in diff.inputFiles())
    same = committed.reconcile_versions(spark, root, "day", 2, 2)
    assert same.collect() == [] and same.inputFiles() == []


def test_expired_folders_go_and_the_newest_stay(spark, root):
    for k in range(3):
        committed.commit_days(batch(spark, [(k, DAYS[0], float(k))]), root, "day")
    before = content(spark, root)
    gone = committed.expire(spark, root, keep=2)
    assert len([g for g in gone if "/data/" in g]) == 1 and committed.turns(spark, root) == [3, 4]
    assert content(spark, root) == before and len(matching(spark, f"{root}/data/write=*")) == 3


def test_an_empty_load_and_an_unknown_table(spark, root, tmp_path):
    committed.commit_days(batch(spark, []), root, "day", days=DAYS)
    assert content(spark, root) == []
    assert committed.read_committed(spark, root, "day").columns == ["k", "day", "v"]
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, str(tmp_path / "none"), "day")
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, root, "day", turn=99)

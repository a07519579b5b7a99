"""Fact tables whose loads become visible at once, however many days they replace.

A load writes its day slices into a folder of its own and reads them back. Only if they hold what was written does it
publish a manifest: the list of all days, each with the folder its rows lie in, their number and a fingerprint. Readers
follow the newest complete manifest, so they see all of a load or nothing. A load that stops halfway leaves files that no manifest
names; a load that is repeated publishes the same days again.

    <root>/data/write=<id>/<day>=<value>/...      rows
    <root>/manifest/turn=<n>/...                  one row per day, and one for the schema

Two versions of a table can be compared by their manifests: days with equal fingerprints hold the same rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchkeeper.operators.keys import dedupe_latest
from batchkeeper.operators.merge import reconcile, require_unique, upsert
from batchkeeper.session import literal_table, materialize
from batchkeeper.sources.storage import drop_directory, matching

ENTRY = "day string, folder string, n_rows bigint, digest string, schema string"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of rows without a day


class LoadMismatch(RuntimeError):
    """What lies in the files is not what was written; nothing was published."""


@dataclass(frozen=True)
class Slice:
    """One day of a version."""

    folder: str
    n_rows: int
    digest: str


@dataclass(frozen=True)
class Version:
    turn: int
    schema: T.StructType
    days: dict[str, Slice]


def fingerprint(schema: T.StructType) -> Column:
    """A number of a set of rows that does not depend on their order; maps, which Spark does not hash, are left out."""
    columns = sorted(f.name for f in schema.fields if "map<" not in f.dataType.simpleString())
    values = [F.col(f"`{c}`").cast("string") if isinstance(schema[c].dataType, T.DateType) else F.col(f"`{c}`") for c in columns]
    return F.coalesce(F.sum(F.xxhash64(*values).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))


def turns(spark: SparkSession, root: str, complete: bool = True) -> list[int]:
    """Published versions, oldest first; with ``complete`` false also those whose writer died."""
    mark = "/_SUCCESS" if complete else ""
    found = [re.search(r"turn=(\d+)", path) for path in matching(spark, f"{root.rstrip('/')}/manifest/turn=*{mark}")]
    return sorted(int(m.group(1)) for m in found if m)


def version(spark: SparkSession, root: str, turn: int | None = None) -> Version | None:
    """A version of the table, the newest one if none is named; None where nothing was published."""
    known = turns(spark, root)
    if turn is None and not known:
        return None
    turn = known[-1] if turn is None else turn
    if turn not in known:
        raise FileNotFoundError(f"{root} has no version {turn}")
    rows = spark.read.schema(ENTRY).parquet(f"{root.rstrip('/')}/manifest/turn={turn}").collect()  # one row per day
    schema = next(T.StructType.fromJson(_json(r["schema"])) for r in rows if r["folder"] is None)
    return Version(turn, schema, {r["day"] or NO_DAY: Slice(r["folder"], r["n_rows"], r["digest"]) for r in rows if r["folder"]})


def _json(text: str) -> dict:
    import json

    return json.loads(text)


def publish(spark: SparkSession, root: str, schema: T.StructType, days: dict[str, Slice]) -> Version:
    """One write of one small file, which is what makes a load visible. A turn that somebody else took fails here."""
    turn = max(turns(spark, root, complete=False), default=0) + 1
    rows = [(None, None, None, None, schema.json())]
    rows += [(None if d == NO_DAY else d, s.folder, s.n_rows, s.digest, None) for d, s in sorted(days.items())]
    literal_table(spark, rows, ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/manifest/turn={turn}")
    return Version(turn, schema, days)


def commit_days(
    df: DataFrame, root: str, day: str, cluster_by: Sequence[str] = (), days: Iterable[str] = ()
) -> Version:
    """Replace the day slices that ``df`` holds, and clear those of ``days`` it has no rows for, in one step.

    The rows are counted and fingerprinted while they are written, and again from the files, per day;
    a difference raises :class:`LoadMismatch` and publishes nothing. ``df`` may read the table itself.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    before = version(spark, root)
    folder = f"write={uuid.uuid4().hex}"
    path = f"{root}/data/{folder}"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    written = Observation()
    watched = df.observe(written, F.count(F.lit(1)).alias("n_rows"), fingerprint(schema).cast("string").alias("digest"))
    watched.hint("rebalance", day).sortWithinPartitions(day, *cluster_by).write.partitionBy(day).parquet(path)
    slices = loaded(spark, path, schema, day)
    total = (sum(s.n_rows for s in slices.values()), sum(Decimal(s.digest) for s in slices.values()))
    # a plan that is known to be empty runs nothing, and so observes nothing
    wanted = (0, Decimal(0)) if not slices and df.isEmpty() else (written.get["n_rows"], Decimal(written.get["digest"]))
    if total != wanted:
        raise LoadMismatch(f"{path} holds {total[0]} rows, {wanted[0]} were written")
    slices = {d: Slice(folder, s.n_rows, s.digest) for d, s in slices.items()}
    kept = {d: s for d, s in (before.days if before else {}).items() if d not in {str(x) for x in days}}
    return publish(spark, root, schema, kept | slices)


def loaded(spark: SparkSession, path: str, schema: T.StructType, day: str) -> dict[str, Slice]:
    """Rows and fingerprint of each day in a load's folder; one row per day reaches the driver."""
    if not matching(spark, f"{path}/{day}=*"):
        return {}
    rows = spark.read.schema(schema).parquet(path).groupBy(F.col(day).cast("string").alias("d"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), fingerprint(schema).cast("string").alias("digest")).collect()
    return {r["d"] if r["d"] is not None else NO_DAY: Slice("", r["n"], r["digest"]) for r in found}


def read_committed(
    spark: SparkSession, root: str, day: str, days: Sequence[str] | None = None, turn: int | None = None
) -> DataFrame:
    """The newest version of a table, or another; of the given days alone if there are any. No other folder is read."""
    root, found = root.rstrip("/"), version(spark, root, turn)
    if found is None:
        raise FileNotFoundError(f"nothing was published under {root}")
    wanted = found.days if days is None else {str(d): found.days[str(d)] for d in days if str(d) in found.days}
    paths = [f"{root}/data/{s.folder}/{day}={d}" for d, s in sorted(wanted.items())]
    if not paths:
        return spark.createDataFrame([], found.schema)
    rows = spark.read.schema(found.schema).option("basePath", f"{root}/data").parquet(*paths)
    return rows.select(*found.schema.fieldNames())


def roll_back(spark: SparkSession, root: str, turn: int) -> Version:
    """Publish an earlier version again. Its rows still lie there: nothing is copied."""
    earlier = version(spark, root, turn)
    return publish(spark, root, earlier.schema, earlier.days)


def merge_committed(
    source: DataFrame,
    root: str,
    day: str,
    keys: Sequence[str],
    update_cols: Sequence[str],
    insert_cols: Sequence[str],
    cluster_by: Sequence[str] = (),
    newest_by: Sequence[str] = (),
) -> Version:
    """MERGE into a table, reading and rewriting only the days the source touches, published in one step.

    Of source rows that share a key the newest by ``newest_by`` wins; without it they are refused. The merged
    rows go straight to their own folder, so nothing is written aside first.
    """
    spark = source.sparkSession
    source = materialize(source, "merge_source")
    if newest_by:
        source = materialize(dedupe_latest(source, list(keys), list(newest_by)).drop(*newest_by), "merge_newest")
    else:
        require_unique(source, keys)
    touched = [str(r[0]) for r in source.select(day).distinct().collect()]  # one row per day
    merged = upsert(read_committed(spark, root, day, touched), source, keys, update_cols, insert_cols)
    return commit_days(merged, root, day, cluster_by, days=touched)


def changed_days(before: Version, after: Version) -> list[str]:
    """Days that do not hold the same rows in both versions, by count and fingerprint: no row is read."""
    every = before.days.keys() | after.days.keys()

    def rows(v: Version, d: str) -> tuple | None:
        return (v.days[d].n_rows, v.days[d].digest) if d in v.days else None

    return sorted(d for d in every if rows(before, d) != rows(after, d))


def reconcile_versions(spark: SparkSession, root: str, day: str, before: int, after: int) -> DataFrame:
    """Rows whose multiplicity differs between two versions (``n_diff``); only days that differ are read."""
    old, new = version(spark, root, before), version(spark, root, after)
    days = changed_days(old, new)
    columns = [c for c in old.schema.fieldNames() if c in new.schema.fieldNames()]
    one, two = (read_committed(spark, root, day, days, t).select(*columns) for t in (before, after))
    return reconcile(one, two)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drop folders that none of the newest ``keep`` versions names, and older manifests; returns what went.

    Not while a load is under way: its folder is named by no manifest yet.
    """
    root = root.rstrip("/")
    known = turns(spark, root)
    named = {s.folder for t in known[-keep:] for s in version(spark, root, t).days.values()}
    gone = [p for p in matching(spark, f"{root}/data/write=*") if p.rsplit("/", 1)[1] not in named]
    gone += [f"{root}/manifest/turn={t}" for t in known[:-keep]]
    for path in gone:
        drop_directory(spark, path)
    return gone

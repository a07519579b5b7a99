"""Arriving events: typed, de-duplicated, counted, checked for freshness and loaded.

Thresholds are those of the batch contract. Sinks are safe to replay: each writes
either under its micro-batch id or through a keyed merge.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from batchkeeper.functions.casting import cast_to_contract
from batchkeeper.functions.scalars import hours_between
from batchkeeper.operators.keys import dedupe_latest
from batchkeeper.operators.predicates import split_null_keys
from batchkeeper.session import literal_table, materialize
from batchkeeper.sources.tables import load_fact_partition, read_fact, table_exists

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Sink = Callable[[DataFrame, int], None]


def configure_streaming(spark: SparkSession) -> SparkSession:
    """Keep keyed state on disk: a day of event ids outgrows the heap long before the disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def stream_events(
    spark: SparkSession, folder: str, types: Mapping[str, str], max_files: int | None = None
) -> DataFrame:
    """New JSON-lines files of a folder, read as text and typed like the batch path (``_cast_error`` kept)."""
    raw = ", ".join(f"`{c}` string" for c in types)
    reader = spark.readStream.schema(raw).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return cast_to_contract(reader.json(folder), types)


def stream_dedupe(df: DataFrame, key: Sequence[str], ts: str, horizon: str = "6 hours") -> DataFrame:
    """First arrival of each key within the horizon, as a stream that other operators can follow.

    Spark drops rows that come in behind the watermark; use :func:`arrival_sink` where none may be lost.
    """
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(list(key))


def stream_volume(df: DataFrame, ts: str, lower: float, upper: float, dataset: str = "events") -> DataFrame:
    """Rows per closed day against the batch bounds. ``df`` carries a watermark on ``ts``.

    Rows behind the watermark are not counted; :func:`arrival_sink` keeps them, and :func:`closed_days` counts its rows.
    """
    daily = df.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_rows"))
    return daily.select(
        F.lit(dataset).alias("dataset"),
        F.to_date("w.start").alias("batch_date"),
        "n_rows",
        F.lit(float(lower)).alias("lower"),
        F.lit(float(upper)).alias("upper"),
        F.col("n_rows").between(lower, upper).alias("passed"),
    )


def run_available(
    df: DataFrame, checkpoint: str, path: str | None = None, sink: Sink | None = None, progress: str | None = None
) -> StreamingQuery:
    """Process what has arrived and stop: into a Parquet folder, or through a sink function.

    ``progress`` is a folder for one row per micro-batch, see :func:`write_progress`.
    """
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
    if progress:
        write_progress(df.sparkSession, query.recentProgress, progress)
    return query


PROGRESS = "query_id string, batch_id bigint, n_rows bigint, max_ts timestamp, watermark timestamp, n_dropped bigint"


def write_progress(spark: SparkSession, reports: Sequence, path: str) -> None:
    """Keep how far a stream has come: per micro-batch its rows, newest event time, watermark and rows dropped as late.

    Each report goes under its query and micro-batch, so one that is told twice is kept once. A batch without rows
    has no newest time. Spark counts as dropped what arrives at a stateful operator behind the watermark.
    """

    def time(report, name: str) -> str | None:
        value = (report["eventTime"] or {}).get(name)
        return value.replace("T", " ").rstrip("Z") if value else None

    for report in reports:
        dropped = sum(int(o["numRowsDroppedByWatermark"]) for o in report["stateOperators"])
        number = int(report["batchId"])
        row = (str(report["id"]), number, int(report["numInputRows"]), time(report, "max"), time(report, "watermark"), dropped)
        kept = literal_table(spark, [row], PROGRESS).coalesce(1)
        kept.write.mode("overwrite").parquet(f"{path}/query={report['id']}/batch={number}")


class ProgressLog(StreamingQueryListener):
    """Writes the progress of every query of a session as it is made, for streams that never stop.

    ``spark.streams.addListener(ProgressLog(spark, path))``; reports arrive a little after their batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Nothing to keep yet."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        write_progress(self.spark, [event.progress], self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """No micro-batch, no row."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """What was made is kept already."""


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and micro-batch, as :func:`write_progress` kept them."""
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", True).parquet(path)


def freshness_sink(log: str, ts: str, max_delay_hours: float, as_of: str | None = None, dataset: str = "events") -> Sink:
    """Lag of each micro-batch's newest row behind the clock, one log row per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        newest = batch.agg(F.max(ts).alias("max_ts"), F.count(F.lit(1)).alias("n_rows"))
        lag = hours_between(F.col("max_ts"), now)
        newest.select(
            F.lit(dataset).alias("dataset"),
            "max_ts",
            "n_rows",
            lag.alias("lag_hours"),
            F.coalesce(lag <= max_delay_hours, F.lit(False)).alias("passed"),
        ).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return write


def load_sink(
    path: str, ts: str, key: Sequence[str], day: str = "day", cluster_by: Sequence[str] = (), stream: str = "s"
) -> Sink:
    """Add the rows with new keys to their days, as files of their own; no earlier file is touched.

    Rows go to ``day=/batch=<stream>-<micro-batch id>``, so a replayed batch replaces its own folders only; every
    stream over one table needs a name of its own. Only the keys of the days it touches are read. The first
    arrival of a key is kept. Rows without a key or a time have no place in the table and are left to
    ``arrival_sink`` or ``aside_sink``. See :func:`compact_days` for days that are over.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole, _ = split_null_keys(batch, [*key, ts])
        dated = dedupe_latest(whole.withColumn(day, F.to_date(ts)), [*key, day], [ts])
        own = f"{stream}-{batch_id}"
        if table_exists(spark, path):
            touched = [str(r[0]) for r in whole.select(F.to_date(ts)).distinct().collect()]  # one row per day
            stored = T.StructType([*dated.select(*key, day).schema, T.StructField("batch", T.StringType())])
            present = read_fact(spark, path, day, touched, stored).filter(F.col("batch") != own)
            dated = dated.join(present.select(*key, day), [*key, day], "left_anti")
        rows = dated.withColumn("batch", F.lit(own)).hint("rebalance", day).sortWithinPartitions(day, *cluster_by)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(day, "batch").parquet(path)

    return write


def compact_days(spark: SparkSession, path: str, target: str, day: str, days: Sequence[str], cluster_by: Sequence[str] = ()) -> None:
    """Write days that are over into a table of one folder per day, once each."""
    load_fact_partition(read_fact(spark, path, day, days).drop("batch"), target, day, cluster_by, days=days)


def arrival_sink(out: str, aside: str, marks: str, ts: str, key: Sequence[str], horizon: str = "6 hours") -> Sink:
    """Each key's first arrival within the horizon to ``out``, late and incomplete rows to ``aside``.

    Every row ends in one of three ways: kept, set aside with a reason, or a repeat of a row that was kept.
    Late is what lies ``horizon`` or more behind the newest time of the earlier batches, as a watermark has it;
    a repeat is looked for among the kept rows that lie within the horizon of the batch. Each batch writes
    under its own id and reads earlier ids only, so a replay changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if table_exists(spark, marks):
            earlier = spark.read.schema("max_ts timestamp, batch_id int").parquet(marks).filter(F.col("batch_id") < batch_id)
            mark = earlier.agg(F.max("max_ts")).first()[0]  # one value
        missing = F.col(ts).isNull()
        for k in key:
            missing = missing | F.col(k).isNull()
        late = F.lit(False)
        if mark is not None:
            late = F.col(ts) <= F.lit(mark) - F.expr(f"interval {horizon}")
        reason = F.when(missing, "incomplete").when(late, "late")
        judged = materialize(batch.withColumn("_reason", reason), "arrivals")
        judged.filter("_reason IS NOT NULL").write.mode("overwrite").parquet(f"{aside}/batch_id={batch_id}")
        rest = judged.filter("_reason IS NULL").drop("_reason")
        order = [ts, *[c for c in rest.columns if c not in (*key, ts)]]
        first = rest.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select(*key, "_first.*").select(*rest.columns)
        if table_exists(spark, out):
            batch_field = T.StructField("batch_id", T.IntegerType())
            kept = spark.read.schema(T.StructType([*first.schema, batch_field])).parquet(out).filter(F.col("batch_id") < batch_id)
            if mark is not None:  # nothing that is not late can repeat a row two horizons behind
                kept = kept.filter(F.col(ts) > F.lit(mark) - F.expr(f"interval {horizon}") - F.expr(f"interval {horizon}"))
            first = first.join(kept.select(*key), list(key), "left_anti")
        first.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        newest = F.greatest(F.max(ts), F.lit(mark).cast("timestamp"))
        batch.agg(newest.alias("max_ts")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return write


def closed_days(
    spark: SparkSession, out: str, marks: str, ts: str, lower: float, upper: float, horizon: str = "6 hours", dataset: str = "events"
) -> DataFrame:
    """Rows per day that the kept rows of :func:`arrival_sink` can no longer change, against the batch bounds."""
    mark = spark.read.schema("max_ts timestamp").parquet(marks).agg(F.max("max_ts")).first()[0]  # one value
    over = F.lit(mark).cast("timestamp") - F.expr(f"interval {horizon}")
    daily = spark.read.parquet(out).groupBy(F.to_date(ts).alias("batch_date")).agg(F.count(F.lit(1)).alias("n_rows"))
    closed = daily.filter(F.date_add("batch_date", 1).cast("timestamp") <= over)
    return closed.select(
        F.lit(dataset).alias("dataset"), "batch_date", "n_rows", F.lit(float(lower)).alias("lower"),
        F.lit(float(upper)).alias("upper"), F.col("n_rows").between(lower, upper).alias("passed"),
    )


def aside_sink(aside: str, marks: str, ts: str, key: Sequence[str], horizon: str = "6 hours") -> Sink:
    """Set aside rows behind the high-water mark of the earlier batches, and rows without a key or time.

    The former are the rows a watermarked query drops as late. The mark of each batch is kept
    under its id, so a replayed batch is judged by the same mark as the first time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if table_exists(spark, marks):
            earlier = spark.read.parquet(marks).filter(F.col("batch_id") < batch_id)
            mark = earlier.agg(F.max("max_ts")).first()[0]  # one value
        behind = F.col(ts).isNull()
        for k in key:
            behind = behind | F.col(k).isNull()
        if mark is not None:
            behind = behind | (F.col(ts) <= F.lit(mark) - F.expr(f"interval {horizon}"))
        batch.filter(F.coalesce(behind, F.lit(False))).write.mode("overwrite").parquet(f"{aside}/batch_id={batch_id}")
        newest = F.greatest(F.max(ts), F.lit(mark).cast("timestamp"))
        batch.agg(newest.alias("max_ts")).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")

    return write


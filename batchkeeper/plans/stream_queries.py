"""Registered queries: the event checks as streams over landed JSON lines.

The event table is landed as JSON lines first, which is how events arrive; each
stream then runs over all files that are there and stops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from batchkeeper.functions.casting import CAST_ERROR
from batchkeeper.functions.scalars import money
from batchkeeper.plans import inputs
from batchkeeper.plans.inputs import AS_OF, tidy
from batchkeeper.plans.registry import query
from batchkeeper.plans.table_queries import DAY_TOTALS_SQL
from batchkeeper.session import new_scratch
from batchkeeper.sources.tables import read_fact
from batchkeeper.streaming import events as stream

TYPES = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "ts": "timestamp"}


def _land(df, folder):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")
    text = [F.col(c).cast("string").alias(c) for c in TYPES if c != "ts"]
    df.select(*text, stamp).write.mode("append").json(folder)
    return folder


def _landed(spark, sf, resend=False):
    """Folder with all events; with ``resend`` every error event arrives twice."""
    stream.configure_streaming(spark)
    events = inputs.table(spark, sf, "events")
    if resend:
        events = events.unionByName(events.filter(F.col("event_type") == "error"))
    return _land(events, new_scratch(spark, "landing"))


@query("stream_dedupe", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedupe(spark, sf):
    arriving = stream.stream_events(spark, _landed(spark, sf, resend=True), TYPES).drop(CAST_ERROR)
    unique = stream.stream_dedupe(arriving, ["event_id"], "ts")
    out = new_scratch(spark, "unique")
    stream.run_available(unique, new_scratch(spark, "checkpoint"), path=out)
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query(
    "stream_volume",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT 'events' AS dataset, day AS batch_date, n AS n_rows,
  round((SELECT avg(n) FROM d) * 0.95e0, 6) AS lower, round((SELECT avg(n) FROM d) * 1.05e0, 6) AS upper,
  n BETWEEN (SELECT avg(n) FROM d) * 0.95e0 AND (SELECT avg(n) FROM d) * 1.05e0 AS passed
FROM d WHERE CAST(day + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""",
)
def stream_volume(spark, sf):
    """De-duplicated rows per closed day; the day that is still open has no row yet."""
    nominal = inputs.events(spark, sf).groupBy("batch_date").count().agg(F.avg("count")).first()[0]
    arriving = stream.stream_events(spark, _landed(spark, sf, resend=True), TYPES)
    unique = stream.stream_dedupe(arriving, ["event_id"], "ts")
    out = new_scratch(spark, "volume")
    daily = stream.stream_volume(unique, "ts", nominal * 0.95, nominal * 1.05)
    stream.run_available(daily, new_scratch(spark, "checkpoint"), path=out)
    return tidy(spark.read.parquet(out))


@query(
    "stream_freshness",
    f"""SELECT 'events' AS dataset, count(*) AS n_rows,
  round(date_diff('microsecond', max(ts), TIMESTAMP '{AS_OF}') / 3.6e9, 6) AS lag_hours,
  date_diff('microsecond', max(ts), TIMESTAMP '{AS_OF}') / 3.6e9 <= 6 AS passed FROM events""",
)
def stream_freshness(spark, sf):
    log = new_scratch(spark, "freshness")
    arriving = stream.stream_events(spark, _landed(spark, sf), TYPES)
    sink = stream.freshness_sink(log, "ts", 6, AS_OF)
    stream.run_available(arriving, new_scratch(spark, "checkpoint"), sink=sink)
    return tidy(spark.read.parquet(log).select("dataset", "n_rows", "lag_hours", "passed"))


@query("stream_load", DAY_TOTALS_SQL)
def stream_load(spark, sf):
    """Load the stream in several micro-batches, with resent rows in it, twice over: every event is in its day once."""
    stream.configure_streaming(spark)
    path, folder = new_scratch(spark, "fct_events"), new_scratch(spark, "landing")
    events = inputs.table(spark, sf, "events")
    _land(events, folder)
    _land(events.filter(F.col("event_type") == "error"), folder)
    for name in ("one", "two"):
        arriving = stream.stream_events(spark, folder, TYPES, max_files=1).drop(CAST_ERROR)
        sink = stream.load_sink(path, "ts", ["event_id"], "batch_date", ["user_id"], stream=name)
        stream.run_available(arriving, new_scratch(spark, "checkpoint"), sink=sink)
    stored = ", ".join(f"{c} {kind}" for c, kind in {**TYPES, "batch_date": "date", "batch": "string"}.items())
    return read_fact(spark, path, "batch_date", schema=stored).groupBy("batch_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("event_id").alias("n_keys"),
        F.sum(money(F.col("value"))).cast("double").alias("total_value"),
    )


@query("stream_late", "SELECT event_id, user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'")
def stream_late(spark, sf):
    """The later half of the days lands first, so all of the earlier half arrives late."""
    stream.configure_streaming(spark)
    folder, late = new_scratch(spark, "landing"), new_scratch(spark, "late")
    marks, checkpoint = new_scratch(spark, "marks"), new_scratch(spark, "checkpoint")
    events = inputs.table(spark, sf, "events")
    early = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    for part in (events.filter(~early), events.filter(early)):
        _land(part, folder)
        arriving = stream.stream_events(spark, folder, TYPES)
        stream.run_available(arriving, checkpoint, sink=stream.aside_sink(late, marks, "ts", ["event_id"]))
    return spark.read.parquet(late).select("event_id", "user_id", "event_type")


LATE_SQL = """WITH r AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 0
    WHEN ts < TIMESTAMP '2024-01-11' THEN 1 ELSE 2 END AS part FROM events),
m AS (SELECT max(ts) AS mark FROM events),
a AS (SELECT event_id, event_type, user_id, CASE WHEN part > 0 AND ts <= mark - INTERVAL 6 HOUR THEN 'late' ELSE 'kept' END AS route
  FROM r, m)
SELECT route, event_type, count(*) AS n_rows, count(DISTINCT event_id) AS n_keys, CAST(sum(event_id) AS BIGINT) AS key_sum
FROM (SELECT * FROM a UNION ALL SELECT * FROM a WHERE route = 'late' AND event_type = 'error') x GROUP BY 1, 2"""


@query("stream_dedupe_late", LATE_SQL)
def stream_dedupe_late(spark, sf):
    """The last third of the days lands first, with resent error events in every part.

    What is kept holds no key twice; every late row, resent or not, is set aside; together they are the input.
    """
    stream.configure_streaming(spark)
    folder, checkpoint = new_scratch(spark, "landing"), new_scratch(spark, "checkpoint")
    out, aside, marks = (new_scratch(spark, t) for t in ("unique", "late", "marks"))
    events = inputs.table(spark, sf, "events")
    begin, end = F.lit("2024-01-11").cast("timestamp_ntz"), F.lit("2024-01-21").cast("timestamp_ntz")
    for part in (F.col("ts") >= end, F.col("ts") < begin, (F.col("ts") >= begin) & (F.col("ts") < end)):
        own = events.filter(part)
        _land(own.unionByName(own.filter(F.col("event_type") == "error")), folder)
        arriving = stream.stream_events(spark, folder, TYPES).drop(CAST_ERROR)  # one micro-batch a part
        sink = stream.arrival_sink(out, aside, marks, "ts", ["event_id"])
        stream.run_available(arriving, checkpoint, sink=sink)
    both = spark.read.parquet(out).withColumn("route", F.lit("kept")).unionByName(
        spark.read.parquet(aside).withColumn("route", F.lit("late")).drop("_reason")
    )
    return both.groupBy("route", "event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_keys"), F.sum("event_id").alias("key_sum")
    )


@query(
    "stream_progress",
    """SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS n_kept,
  CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS BIGINT) AS n_dropped,
  count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS n_aside, count(*) AS n_read,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events""",
)
def stream_progress(spark, sf):
    """The later half of the days first: what the watermarked stream reports as dropped is what the sink sets aside."""
    stream.configure_streaming(spark)
    folder, out, aside, marks, log, one, two = (
        new_scratch(spark, t) for t in ("landing", "unique", "late", "marks", "progress", "checkpoint", "checkpoint")
    )
    events = inputs.table(spark, sf, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (events.filter(~early), events.filter(early)):
        _land(part, folder)
        arriving = stream.stream_events(spark, folder, TYPES).drop(CAST_ERROR)
        stream.run_available(stream.stream_dedupe(arriving, ["event_id"], "ts"), one, path=out, progress=log)
        stream.run_available(arriving, two, sink=stream.aside_sink(aside, marks, "ts", ["event_id"]))
    told = stream.read_progress(spark, log).agg(
        F.sum("n_dropped").alias("n_dropped"), F.sum("n_rows").alias("n_read"), F.max("max_ts").alias("newest")
    )
    rows = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias(n)) for p, n in ((out, "n_kept"), (aside, "n_aside"))]
    names = ("n_kept", "n_aside", "n_dropped", "n_read", "newest")
    # one row each; put side by side without a join
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [told, *rows])
    return tidy(both.agg(*[F.max(c).alias(c) for c in names]))

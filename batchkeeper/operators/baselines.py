"""A batch against its own history. All inputs hold one row per dataset (or series) and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchkeeper.functions.scalars import beyond_bound_pct
from batchkeeper.session import literal_table


def _trailing(n: int, series: str = "dataset"):
    return Window.partitionBy(series).orderBy("batch_date").rowsBetween(-n, -1)


def three_sigma(counts: DataFrame, n: int, sigmas: float = 3.0) -> DataFrame:
    """Outside trailing mean ± sigmas·sd of the n batches before. Under two priors: no verdict, not a pass."""
    w = _trailing(n)
    mean, sd, priors = F.avg("n_rows").over(w), F.stddev_samp("n_rows").over(w), F.count("n_rows").over(w)
    value = F.col("n_rows")
    status = (
        F.when(F.col("n_prior") < 2, "insufficient_history")
        .when(value > F.col("mean") + sigmas * F.col("sd"), "spike")
        .when(value < F.col("mean") - sigmas * F.col("sd"), "drop")
        .otherwise("ok")
    )
    based = counts.withColumns({"n_prior": priors, "mean": mean, "sd": sd})
    return based.withColumn("status", status).select(
        "dataset", "batch_date", "n_rows", "n_prior", "mean", "sd", "status"
    )


def vs_trailing_median(counts: DataFrame, n: int, tolerance: float) -> DataFrame:
    """Share by which a batch departs from the median of the n batches before."""
    median = F.percentile("n_rows", F.lit(0.5)).over(_trailing(n))
    share = F.when(F.col("median") > 0, F.col("n_rows") / F.col("median") - 1)
    return (
        counts.withColumn("median", median)
        .withColumn("deviation", share)
        .select(
            "dataset", "batch_date", "n_rows", "median", "deviation",
            (F.abs("deviation") <= tolerance).alias("passed"),
        )
    )


def null_spike(rates: DataFrame, n: int, factor: float, floor: float) -> DataFrame:
    """A null rate that leaps over its own trailing average.

    ``rates(dataset, batch_date, rate)``. A spike is above ``floor`` and above
    ``factor`` times the average of the n batches before.
    """
    usual = F.avg("rate").over(_trailing(n))
    spike = (F.col("rate") > floor) & (F.col("rate") > factor * F.col("usual_rate"))
    return rates.withColumn("usual_rate", usual).select(
        "dataset", "batch_date", "rate", "usual_rate", F.coalesce(spike, F.lit(False)).alias("spike")
    )


def volume_deviation(counts: DataFrame) -> DataFrame:
    """Signed percent beyond the violated bound, truncated to whole percent; 0 inside."""
    pct = beyond_bound_pct(F.col("n_rows"), F.col("lower"), F.col("upper"))
    return counts.select("dataset", "batch_date", "n_rows", "lower", "upper", pct.alias("deviation_pct"))


def static_source(batches: DataFrame) -> DataFrame:
    """``batches(dataset, batch_date, max_ts)``: loaded, but the newest timestamp did not advance."""
    w = Window.partitionBy("dataset").orderBy("batch_date")
    previous = F.max("max_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("previous_max", previous).select(
        "dataset", "batch_date", "max_ts", "previous_max",
        F.coalesce(F.col("max_ts") <= F.col("previous_max"), F.lit(False)).alias("static"),
    )


def seven_day_history(counts: DataFrame, days: int = 7) -> DataFrame:
    """The last batches with their running mean and a status against their bounds."""
    w = Window.partitionBy("dataset").orderBy("batch_date")
    running = F.avg("n_rows").over(w.rowsBetween(1 - days, 0))
    back = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("batch_date")))
    healthy = F.col("n_rows").between(F.col("lower"), F.col("upper"))
    return (
        counts.withColumns({"running_mean": running, "_back": back})
        .filter(F.col("_back") <= days)
        .select(
            "dataset", "batch_date", "n_rows", "running_mean",
            F.when(healthy, "healthy").otherwise("anomaly").alias("status"),
        )
    )


STATE = "dataset string, batch_date date, level double, trend double"


def holt_advance(state: DataFrame, series: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Double exponential smoothing, carried on from a stored state over the batches that are new.

    ``state(dataset, batch_date, level, trend)``: at most one row per series, where it stands; a series without one starts at its
    first value with no trend. ``series(dataset, batch_date, n_rows)``: one row per batch. Result: each batch after the state's
    with its one-step forecast, residual, and the state after it; the last row of a series is its next state. Batches
    at or before the state are left out, so a rerun changes nothing. A series holds its new batches only,
    one number each; series run in parallel.
    """
    begun = state.select("dataset", F.col("batch_date").alias("_until"), F.col("level").alias("_level"), F.col("trend").alias("_trend"))
    fresh = series.join(begun, "dataset", "left").filter("_until IS NULL OR batch_date > _until")
    point = F.struct("batch_date", F.col("n_rows").cast("double").alias("y"))
    held = fresh.groupBy("dataset").agg(
        F.sort_array(F.collect_list(point)).alias("points"),
        F.max(F.struct(F.col("_level").alias("level"), F.coalesce("_trend", F.lit(0.0)).alias("trend"))).alias("at"),
    )
    path = F.array().cast("array<struct<forecast:double,level:double,trend:double>>")
    zero = F.struct(F.col("at.level").alias("level"), F.col("at.trend").alias("trend"), path.alias("path"))

    def step(acc, p):
        expected = acc["level"] + acc["trend"]
        level = F.when(acc["level"].isNull(), p["y"]).otherwise(alpha * p["y"] + (1 - alpha) * expected)
        trend = F.when(acc["level"].isNull(), F.lit(0.0)).otherwise(
            beta * (level - acc["level"]) + (1 - beta) * acc["trend"]
        )
        now = F.struct(expected.alias("forecast"), level.alias("level"), trend.alias("trend"))
        return F.struct(level.alias("level"), trend.alias("trend"), F.concat(acc["path"], F.array(now)).alias("path"))

    folded = held.withColumn("path", F.aggregate("points", zero, step)["path"])
    rows = folded.select("dataset", F.inline(F.arrays_zip("points", "path")))
    return rows.select(
        "dataset",
        F.col("points.batch_date").alias("batch_date"),
        F.col("points.y").cast("bigint").alias("n_rows"),
        F.col("path.forecast").alias("forecast"),
        (F.col("points.y") - F.col("path.forecast")).alias("residual"),
        F.col("path.level").alias("level"),
        F.col("path.trend").alias("trend"),
    )


def next_state(state: DataFrame, advanced: DataFrame) -> DataFrame:
    """Where each series stands after :func:`holt_advance`; a series without new batches stays where it was."""
    columns = ("dataset", "batch_date", "level", "trend")
    rows = state.select(*columns).unionByName(advanced.select(*columns))
    last = rows.groupBy("dataset").agg(F.max_by(F.struct(*columns[1:]), "batch_date").alias("last"))
    return last.select("dataset", "last.*")


def holt_forecast(series: DataFrame, alpha: float, beta: float) -> DataFrame:
    """One-step forecasts of whole series: :func:`holt_advance` from the beginning."""
    nothing = literal_table(series.sparkSession, [], STATE)
    return holt_advance(nothing, series, alpha, beta).drop("level", "trend")

"""Checks of a batch against its own past that no single batch can answer, from rows of the check log.

All inputs are check rows: a few per dataset and day, however large the batches were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.operators import baselines, checks


@dataclass(frozen=True)
class Watch:
    """What a team declares to be unusual. ``landing_hours`` of None: arrival is not judged."""

    days: int = 14
    null_factor: float = 3.0
    null_floor: float = 0.005
    median_tolerance: float = 0.5
    landing_hours: float | None = None


def watched(log: DataFrame, watch: Watch, arrivals: DataFrame | None = None) -> DataFrame:
    """Check rows ``null_spike``, ``volume_median``, ``static_source`` and ``landing_sla``, one per series and day.

    ``log``: check rows with ``as_of``, the clock their freshness was measured by, one row per check, column and
    day. A day is judged by the days before it that the log holds: leave out those that are no example of a usual
    day. A day without any before it passes. ``arrivals(dataset, batch_date, landed_at)``.
    """
    # one series per dataset and column
    rates = log.filter("check_name = 'null_rate' AND metric IS NOT NULL").select(
        F.struct("dataset", "column_name").alias("dataset"), "batch_date", F.col("metric").alias("rate")
    )
    spikes = baselines.null_spike(rates, watch.days, watch.null_factor, watch.null_floor).select("dataset.*", "batch_date", "rate", "usual_rate", "spike")
    limit = f"greatest({float(watch.null_floor)!r}D, {float(watch.null_factor)!r}D * usual_rate)"
    usual = "concat('rate=', round(rate, 6), ' usual=', coalesce(string(round(usual_rate, 6)), 'none'))"
    spike_row = checks.check_row("null_spike", "column_name", "rate", "NOT spike", "if(spike, 1, 0)", usual, upper=limit)

    counts = log.filter("check_name = 'row_count' AND metric IS NOT NULL").select(
        "dataset", "batch_date", F.col("metric").cast("bigint").alias("n_rows")
    )
    medians = baselines.vs_trailing_median(counts, watch.days, watch.median_tolerance)
    low, high = (f"median * {1 + sign * watch.median_tolerance!r}D" for sign in (-1, 1))
    median_row = checks.check_row(
        "volume_median", "NULL", "n_rows", "coalesce(passed, true)", "if(coalesce(passed, true), 0, 1)",
        "concat('rows=', n_rows, ' median=', coalesce(string(median), 'none'))", low, high,
    )

    # the newest row's time, back from its lag in hours
    newest = F.timestamp_micros(F.unix_micros("as_of") - F.round(F.col("metric") * 3.6e9).cast("bigint"))
    batches = log.filter("check_name = 'freshness' AND metric IS NOT NULL").select("dataset", "batch_date", newest.alias("max_ts"))
    ahead = "(timestampdiff(MICROSECOND, previous_max, max_ts) / 3.6e9D)"
    seen = "concat('max=', date_format(max_ts, 'yyyy-MM-dd HH:mm:ss'), ' before=', coalesce(date_format(previous_max, 'yyyy-MM-dd HH:mm:ss'), 'none'))"
    static_row = checks.check_row("static_source", "NULL", ahead, "NOT static", "if(static, 1, 0)", seen)

    parts = [
        checks.rows_of(spikes, spike_row), checks.rows_of(medians, median_row),
        checks.rows_of(baselines.static_source(batches), static_row),
    ]
    if arrivals is not None and watch.landing_hours is not None:
        parts.append(checks.landing_sla(arrivals, watch.landing_hours))
    return checks.union_checks(*parts)

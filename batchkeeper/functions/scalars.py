"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3.6e9
MICROS_PER_SECOND = 1e6


def hours_between(start: Column, end: Column) -> Column:
    """Exact hours as a double. Whole-hour differences would let a 6.05 h lag pass a 6 h SLA."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_HOUR)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_SECOND)


def in_bounds(value: Column, lower: Column, upper: Column) -> Column:
    """Inclusive at both ends; a NULL anywhere counts as out of bounds."""
    return F.coalesce(value.between(lower, upper), F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    """part/whole as a double, NULL for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def beyond_bound_pct(n: Column, lower: Column, upper: Column) -> Column:
    """Signed whole percent by which ``n`` passes the bound it violates; 0 inside the bounds."""
    over = (n - upper) * 100.0 / upper
    under = (n - lower) * 100.0 / lower
    pct = F.when(n > upper, over).when(n < lower, under).otherwise(F.lit(0.0))
    return F.when(pct >= 0, F.floor(pct)).otherwise(F.ceil(pct)).cast("bigint")


def incident_id(day: Column, *parts: Column) -> Column:
    """Stable id ``INC-YYYYMMDD-xxxxxxxx``: the same finding gets the same id in every rerun."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    stamp = F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("00000000"))
    return F.concat(F.lit("INC-"), stamp, F.lit("-"), F.substring(digest, 1, 8))


def padded_id(prefix: str, width: int, number: Column) -> Column:
    """``ORD00000042``-style ids. Numbers wider than the pad keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def uniform(seed: int, stream: str, *columns: Column) -> Column:
    """Repeatable draw in [0, 1) from a hash of the row's own key, the same after any task retry."""
    buckets = 1 << 52
    hashed = F.xxhash64(F.lit(seed), F.lit(stream), *columns)
    return F.pmod(hashed, F.lit(buckets).cast("bigint")).cast("double") / F.lit(float(buckets))


def pick(draw: Column, values: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """One of ``values`` by a draw in [0, 1); equal weights unless given."""
    weights = list(weights or [1] * len(values))
    total, reached = float(sum(weights)), 0.0
    chosen = None
    for value, weight in list(zip(values, weights))[:-1]:
        reached += weight
        hit = draw < F.lit(reached / total)
        chosen = F.when(hit, F.lit(value)) if chosen is None else chosen.when(hit, F.lit(value))
    last = F.lit(values[-1])
    return last if chosen is None else chosen.otherwise(last)


def pick_index(draw: Column, n: int) -> Column:
    """A whole number 1..n by a draw in [0, 1)."""
    return (F.floor(draw * F.lit(float(n))) + 1).cast("bigint")


def money(column: Column) -> Column:
    """Exact cents, so that sums do not depend on the order of addition."""
    return column.cast("decimal(28,2)")

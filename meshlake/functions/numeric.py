"""Rounding flavours and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_away(x: Column, digits: int) -> Column:
    """Round half away from zero."""
    m = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m


def trunc_round(x: Column, digits: int) -> Column:
    """``trunc(x*m + 0.5)/m``: biased upward for negatives, by contract."""
    m = float(10 ** digits)
    return (x * m + 0.5).cast("bigint") / F.lit(m)


def spread(col: str) -> Column:
    """Standard deviation; without the last digits, which follow the order of rows, so that what is rounded or graded from it does not."""
    return F.round(F.coalesce(F.stddev_pop(col), F.lit(0.0)), 9)


def trunc(x: Column) -> Column:
    return x.cast("bigint")


def upper_median(col: str) -> Column:
    """``sorted[n/2]``.

    The aggregate keeps one counter per distinct value and merges partial counters
    before the shuffle, so its state is bounded by the value domain (quarter-dB
    signal readings, hop counts, hundredths of a km), not by the row count.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col} DESC)")


def true_median(col: Column | str) -> Column:
    """Middle value, or the mean of the two middle values."""
    return F.percentile(col, F.lit(0.5))


def index_percentile(col: str, p: float, n: Column) -> Column:
    """``sorted[int(n*p)]`` over an aggregated, sorted array column."""
    return F.try_element_at(F.col(col), (n * p).cast("int") + 1)

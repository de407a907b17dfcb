"""Ratios, shares and fixed-point text with the toolkit's zero and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")


def ratio(value: Column, baseline: Column) -> Column:
    """``value / baseline``, NaN when the baseline is zero."""
    return F.when(baseline == 0, F.lit(NAN)).otherwise(value.cast("double") / baseline)


def percent_change(difference: Column, baseline: Column) -> Column:
    """``difference`` in percent of ``baseline``, NaN when the baseline is zero."""
    return ratio(difference, baseline) * 100


def share(count: Column, total: Column) -> Column:
    """``count`` in percent of ``total``, 0.0 when there is nothing to share."""
    return F.when(total == 0, F.lit(0.0)).otherwise(count * F.lit(100.0) / total)


def mean(total: Column, count: Column) -> Column:
    """``total / count``, 0.0 for no rows."""
    return F.when(count == 0, F.lit(0.0)).otherwise(total.cast("double") / count)


def per_second(amount: Column, seconds: Column) -> Column:
    """Throughput, 0.0 when no time has passed."""
    return F.when(seconds > 0, amount.cast("double") / seconds).otherwise(F.lit(0.0))


def fixed4(value: Column) -> Column:
    """Text of a number in [0, 1] with four decimals, rounded on its exact binary value.

    Printing rounds the shortest decimal form half up, which differs for values such
    as 1/32 (an exact tie, goes to even) and 3/160 (stored just below its tie). The
    distance to the tie is exact here because each half of ``value`` times 20000
    fits a double.
    """
    low = F.floor(value * 10000)
    high_bits = F.floor(value * (1 << 26)) / F.lit(float(1 << 26))
    past_tie = (high_bits * 20000 - (low * 2 + 1)) + (value - high_bits) * 20000
    up = (past_tie > 0) | ((past_tie == 0) & (low % 2 == 1))
    scaled = low + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%04d", F.floor(scaled / 10000), scaled % 10000)

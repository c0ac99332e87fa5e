"""Rounding and ratios. Ratios are null where the divisor is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Rounds a number that is not negative. The same in any engine, as it is plain arithmetic on doubles."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def click_rate(clicks: Column, impressions: Column) -> Column:
    return half_up(ratio(clicks, impressions), 4)


def weighted_position(weighted: Column, impressions: Column) -> Column:
    return half_up(ratio(weighted, impressions), 1)

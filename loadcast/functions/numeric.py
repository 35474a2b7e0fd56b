"""Numeric helpers shared by aggregates and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, digits: int) -> Column:
    """numpy/pandas ``round``: scale, round half to even on the double, unscale
    (``rint(x * 10^d) / 10^d``). Spark's ``bround`` rounds the decimal string of the double
    instead, which differs on values such as 4.015 (pandas: 4.01, bround: 4.02)."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def exact_avg(c, scale: int = 4) -> Column:
    """Mean over an exact decimal sum, divided once: independent of summation order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.avg(col.cast(f"decimal(18,{scale})")).cast("double")


def exact_sum(c, scale: int = 4) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(f"decimal(18,{scale})")).cast("double")

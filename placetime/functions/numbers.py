"""Rounding flavours, ratios and rank arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column) -> Column:
    """Round to an integer with ties towards +infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def half_even(x: Column) -> Column:
    """Round to an integer with ties to even."""
    return F.bround(x, 0).cast("long")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null when the denominator is null or zero."""
    return F.when(den != 0, num.cast("double") / den)


def pct_change(cur: Column, prior: Column) -> Column:
    """Relative change, null on a missing or zero base."""
    return F.when(prior != 0, (cur - prior).cast("double") / prior)


def pct_int(cur: Column, prior: Column) -> Column:
    """Integer percentage change, half-up, null on a missing or zero base."""
    return half_up(F.when(prior != 0, (cur - prior).cast("double") / prior * 100))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def rank_target(n: Column, pct: int) -> Column:
    """1-based position of the nearest-rank percentile: min(n, floor(pct * n / 100) + 1)."""
    return F.least(n, F.floor(n * pct / 100).cast("long") + 1)

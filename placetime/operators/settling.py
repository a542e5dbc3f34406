"""Reporting lag: distributions, completeness of young months, cohorts and pointers.

Percentiles come from value histograms (distinct lags in days), so a group of any size is
reduced to at most a few thousand rows before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, timekeys as tk
from ..functions.numbers import half_even, rank_target
from ..functions.ranks import nearest_rank, value_counts


def lags(events: DataFrame, start: str, end: str, as_of_window: tuple[Column, Column] | None = None) -> DataFrame:
    """Non-negative day lags between two dates, optionally for starts in [lo, hi)."""
    rows = events.withColumn("lag", F.datediff(F.col(end), F.col(start))).where("lag >= 0")
    if as_of_window:
        lo, hi = as_of_window
        rows = rows.where((F.col(start) >= lo) & (F.col(start) < hi))
    return rows


def reference_window(as_of: str) -> tuple[Column, Column]:
    """The settled year: 24 to 12 months back."""
    d = F.lit(as_of).cast("date")
    return tk.months_back(d, 24), tk.months_back(d, 12)


def lag_stats(
    rows: DataFrame,
    keys: Sequence[str],
    within: Sequence[int] = (7, 30, 60),
    percentiles: Sequence[int] = (50, 90),
    lag: str = "lag",
    decimals: int = 0,
) -> DataFrame:
    """n, nearest-rank percentiles, and percentages within given days, per key."""
    counts = value_counts(rows, keys, lag)

    def share(d: int) -> Column:
        got = F.coalesce(F.sum(F.when(F.col(lag) <= d, F.col("c"))), F.lit(0))
        pct = got.cast("double") / F.max("n") * 100
        return (half_even(pct) if decimals == 0 else F.bround(pct, decimals)).alias(f"within_{d}_pct")

    names = {f"p{p}_days": p for p in percentiles}
    return counts.groupBy(*keys).agg(
        F.max("n").alias("n"), *nearest_rank(counts, keys, lag, **names), *[share(d) for d in within]
    )


def lag_cdf(rows: DataFrame, keys: Sequence[str], days: int = fixed.LAG_CDF_DAYS, lag: str = "lag") -> DataFrame:
    """F(k), k = 0..days: share of lags at most k, six decimals.

    Each histogram entry fills the days up to the next one, so the curve is dense without
    joining it to a day axis.  The result is tiny; write it once when it is used often.
    """
    hist = value_counts(rows, keys, lag)
    # the entries that reach the curve, and the first one wherever it lies: few rows a key
    near = hist.where((F.col(lag) <= days) | (F.col("cum") == F.col("c")))
    by_lag = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(lag)
    h = near.withColumns({"_first": F.col("cum") == F.col("c"), "_next": F.lead(lag).over(by_lag)})
    lo = F.when(F.col("_first"), F.lit(0)).otherwise(F.col(lag))
    hi = F.least(F.coalesce(F.col("_next") - 1, F.lit(days)), F.lit(days))
    return h.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).select(
        *keys, "k",
        F.when(F.col("k") < F.col(lag), 0.0)
        .otherwise(F.bround(F.col("cum").cast("double") / F.col("n"), 6)).alias("f"),
    )


def late_at_percentile(rows: DataFrame, keys: Sequence[str], pct: int = 90, lag: str = "lag") -> DataFrame:
    """The nearest-rank percentile of the lag as a hold-back delay, with the rows that arrive
    within it and after it."""
    counts = value_counts(rows, keys, lag)
    reached = F.when(F.col("cum") >= rank_target(F.col("n"), pct), F.struct(F.col(lag).alias("delay"), "cum"))
    return counts.groupBy(*keys).agg(F.min(reached).alias("at"), F.max("n").alias("n")).select(
        *keys, F.col("at.delay").alias("delay"), F.col("at.cum").alias("in_time"), (F.col("n") - F.col("at.cum")).alias("late"),
    )


def month_completeness(cdf: DataFrame, ages: DataFrame, keys: Sequence[str], cap: int | None = fixed.LAG_CDF_DAYS) -> DataFrame:
    """Expected share of a month's reports that have arrived.

    ages: keys, delta (days since month end) and month_days; each day of the month is that
    much older, so the curve is averaged over delta .. delta + month_days - 1.  Ages beyond
    the curve read its last point (cap) or, with cap=None, count as complete.
    """
    days = ages.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("month_days") - 1)))
    age = F.col("delta") + F.col("_j")
    look = days.withColumn("k", F.least(age, F.lit(cap)) if cap is not None else age)
    joined = look.join(cdf.select(*keys, "k", "f"), [*keys, "k"], "left")
    return joined.groupBy(*ages.columns).agg(
        (F.sum(F.coalesce("f", F.lit(1.0 if cap is None else 0.0))) / F.first("month_days")).alias("completeness")
    )


def month_ages(months: DataFrame, as_of: str, month: str = "period") -> DataFrame:
    d = F.lit(as_of).cast("date")
    return months.withColumns({
        "delta": F.datediff(d, F.last_day(month)),
        "month_days": tk.month_length(F.col(month)),
    })


def missing_by_age(cdf: DataFrame, keys: Sequence[str], grid: Sequence[int] = fixed.MISSING_GRID, month_days: int = 30) -> DataFrame:
    """Percentage of a month still missing at each age after its end."""
    ages = cdf.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(g) for g in grid])).alias("delta"),
        F.lit(month_days).alias("month_days"),
    )
    return month_completeness(cdf, ages, keys).withColumn("missing_pct", (1 - F.col("completeness")) * 100)


def days_to_threshold(cdf: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = (0.99, 0.995, 0.999), days: int = 90, month_days: int = 30) -> DataFrame:
    """First age in 0..days-1 at which a month reaches each threshold; null if never."""
    ages = cdf.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("delta"),
        F.lit(month_days).alias("month_days"),
    )
    done = month_completeness(cdf, ages, keys)
    marks = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return done.select(*keys, "delta", "completeness", marks).groupBy(*keys, "threshold").agg(
        F.min(F.when(F.col("completeness") >= F.col("threshold"), F.col("delta"))).alias("days")
    )


def settled_month(cdf: DataFrame, keys: Sequence[str], as_of: str, bar: float = fixed.SOLID_COMPLETENESS, fallback: int = 1, cap: int | None = fixed.LAG_CDF_DAYS) -> DataFrame:
    """Latest complete month if its expected completeness clears the bar, else `fallback`
    months further back; both completeness values are kept."""
    d = F.lit(as_of).cast("date")
    months = cdf.select(*keys).distinct().select(
        *keys, F.explode(F.array(tk.months_back(d, 1), tk.months_back(d, 1 + fallback))).alias("period")
    )
    comp = month_completeness(cdf, month_ages(months, as_of), keys, cap)
    latest = F.max(F.struct("period", "completeness"))
    older = F.min(F.struct("period", "completeness"))
    two = comp.groupBy(*keys).agg(latest.alias("a"), older.alias("b"))
    solid = F.col("a.completeness") >= bar
    return two.select(
        *keys,
        F.col("a.period").alias("latest_complete"),
        F.col("a.completeness").alias("latest_completeness"),
        F.when(solid, F.col("a.period")).otherwise(F.col("b.period")).alias("latest_settled"),
        F.when(solid, F.col("a.completeness")).otherwise(F.col("b.completeness")).alias("settled_completeness"),
        F.when(solid, 0).otherwise(fallback).alias("settle_lag_months"),
    )


def cohorts(events: DataFrame, start: str, end: str, as_of: str, keys: Sequence[str], mature_days: int = fixed.COHORT_MATURITY_DAYS) -> DataFrame:
    """Report dates of every mature incident-month cohort, as counts."""
    rows = events.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    c = rows.groupBy(*keys, tk.month_start(F.col(start)).alias("cohort"), F.col(end).cast("date").alias("report")).agg(
        F.count(F.lit(1)).alias("c")
    )
    return c.where(F.datediff(F.lit(as_of).cast("date"), F.last_day("cohort")) >= mature_days)


def cohort_completion(cohort_rows: DataFrame, keys: Sequence[str], grid: Sequence[int], unit: str = "month") -> DataFrame:
    """Share of each cohort filed by each horizon: month-end + h days, or the k-th later
    month-end.  One conditional sum per horizon, then one row per (cohort, horizon)."""
    def horizon(h: int) -> Column:
        return F.date_add(F.last_day("cohort"), h) if unit == "day" else tk.month_end_after(F.col("cohort"), h)

    wide = cohort_rows.groupBy(*keys, "cohort").agg(
        F.sum("c").alias("final"),
        *[
            F.coalesce(F.sum(F.when(F.col("report") <= horizon(h), F.col("c"))), F.lit(0)).alias(f"_h{h}")
            for h in grid
        ],
    )
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"_h{h}").alias("filed")) for h in grid
    ])).alias("p")
    return wide.select(*keys, "cohort", "final", pairs).select(
        *keys, "cohort", "final", F.col("p.h").alias("h"), F.col("p.filed").alias("filed"),
        (F.col("p.filed") / F.col("final")).alias("completion"),
    )


def cohort_summary(completion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of completion over cohorts per horizon, with uplift 1 / mean.  A group has one
    row per cohort month."""
    groups = [*keys, "h"]
    counts = value_counts(completion, groups, "completion")
    pcts = counts.groupBy(*groups).agg(*nearest_rank(counts, groups, "completion", p10=10, p50=50, p90=90))
    base = completion.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("completion").alias("mean"),
        F.stddev_pop("completion").alias("sd"),
        F.min("completion").alias("min"), F.max("completion").alias("max"),
    )
    four = lambda c: F.round(F.col(c), 4).alias(c)
    return base.join(pcts, groups).select(
        *groups, "n", *[four(c) for c in ("mean", "sd", "p10", "p50", "p90", "min", "max")],
        F.round(1 / F.nullif(F.col("mean"), F.lit(0.0)), 4).alias("uplift"),
    )


def completion_by_year(completion: DataFrame, keys: Sequence[str]) -> DataFrame:
    return completion.groupBy(*keys, F.year("cohort").alias("year"), "h").agg(
        F.count(F.lit(1)).alias("cohorts"), F.round(F.avg("completion"), 4).alias("mean")
    )


def reporting_triangle(completion: DataFrame, keys: Sequence[str], grid: Sequence[int]) -> DataFrame:
    """Cohorts as rows, horizons as columns, filed counts as values."""
    return completion.groupBy(*keys, "cohort", "final").agg(
        *[F.max(F.when(F.col("h") == h, F.col("filed"))).alias(f"h{h}") for h in grid]
    )


def confidence(summary: DataFrame, k: int = 1, band: float = fixed.CONFIDENCE_BAND) -> DataFrame:
    """high when the p10-p90 spread at horizon k is within the band, else moderate."""
    spread = F.round(F.col("p90") - F.col("p10"), 4)
    return summary.where(F.col("h") == k).withColumns({
        "spread": spread,
        "level": F.when(spread <= band, "high").otherwise("moderate"),
        "expected_increase_pct": F.round((F.col("uplift") - 1) * 100, 1),
    })


def projected_final(series: DataFrame, summary: DataFrame, as_of: str, keys: Sequence[str]) -> DataFrame:
    """Observed counts of recent months scaled by the uplift of their age in months."""
    d = F.lit(as_of).cast("date")
    age = F.months_between(F.trunc(d, "MM"), F.col("period")).cast("int") - 1
    up = summary.select(*keys, F.col("h").alias("age"), "uplift")
    return series.withColumn("age", age).join(up, [*keys, "age"]).withColumns({
        "projected": F.col("n") * F.col("uplift"),
        "expected_increase_pct": F.round((F.col("uplift") - 1) * 100, 1),
    })


def publication_delta(events: DataFrame, report: str, load: str, within: Sequence[int] = (2, 7)) -> DataFrame:
    """Bulk-reload date (the commonest load date, the earliest on a tie) and the report-to-load
    delay of rows loaded after it."""
    per_day = events.where(F.col(load).isNotNull()).groupBy(F.col(load).cast("date").alias("d")).agg(
        F.count(F.lit(1)).alias("c")
    )
    top = per_day.agg(F.max(F.struct("c", (-F.unix_date("d")).alias("o"), "d")).alias("t"))
    reload = top.select("t.d").scalar()
    later = events.where(F.col(load).cast("date") > reload).withColumn(
        "lag", F.datediff(F.col(load), F.col(report))
    ).where("lag >= 0")
    return lag_stats(later, [], within).withColumns({
        "reload_date": reload, "reload_rows": top.select("t.c").scalar(),
    })

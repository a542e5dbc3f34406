"""Metrics over dense long series (keys, idx, n).  Every window is partitioned by the series
keys, so a task holds at most whole series, each as long as its axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.joins import param_array
from ..functions.numbers import clamp, half_up, pct_change, pct_int, ratio
from .rollup import CITYWIDE

KEYS = ("signal", "label")


def _w(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("idx")


def lagged(n: str, k: int, keys: Sequence[str] = KEYS) -> Column:
    return F.lag(n, k).over(_w(keys))


def trailing_sum(n: str, k: int, keys: Sequence[str] = KEYS, back: int = 0) -> Column:
    """Sum of the k periods ending `back` periods ago; null without full history."""
    w = _w(keys).rowsBetween(-(k - 1) - back, -back)
    return F.when(F.col("idx") >= k - 1 + back, F.sum(n).over(w))


def yoy(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Value, the value 12 periods earlier and their relative change."""
    return s.withColumn("prior", lagged("n", 12, keys)).withColumn(
        "pct", pct_change(F.col("n"), F.col("prior"))
    )


def trailing12(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    total = trailing_sum("n", 12, keys)
    return s.withColumns({"t12_sum": total, "t12_avg": total / 12.0})


def trend12(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing-12 average against a year before; all null when the prior one is zero."""
    now, prev = trailing_sum("n", 12, keys) / 12.0, trailing_sum("n", 12, keys, 12) / 12.0
    out = s.withColumns({"_now": now, "_prev": prev})
    ok = F.col("_prev").isNotNull() & (F.col("_prev") != 0)
    return out.withColumns({
        "trend_now": F.when(ok, F.col("_now")),
        "trend_prev": F.when(ok, F.col("_prev")),
        "trend_pct": F.when(ok, (F.col("_now") - F.col("_prev")) / F.col("_prev")),
    }).drop("_now", "_prev")


def trailing_yoy(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing-12 total against a year before; a zero base keeps both totals, null change."""
    cur, prior = trailing_sum("n", 12, keys), trailing_sum("n", 12, keys, 12)
    return s.withColumns({"t12": cur, "t12_prior": prior}).withColumn(
        "t12_pct", pct_change(F.col("t12"), F.col("t12_prior"))
    )


def prior_year_line(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return s.withColumn("prior_year", lagged("n", 12, keys))


def momentum(s: DataFrame, horizons: Sequence[int] = (1, 3, 12), keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing h periods against the h before, null without history or on a zero block."""
    return s.withColumns({
        f"mom_{h}": pct_change(trailing_sum("n", h, keys), trailing_sum("n", h, keys, h))
        for h in horizons
    })


def compare_month(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Against the previous period and the period a year before."""
    return s.withColumns({
        "vs_last": pct_change(F.col("n"), lagged("n", 1, keys)),
        "vs_year": pct_change(F.col("n"), lagged("n", 12, keys)),
    })


def compare_to_average(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Against the mean of every period from the start."""
    run = _w(keys).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n").over(run)
    return s.withColumn("_t", total).withColumns({
        "avg_to_date": F.col("_t") / (F.col("idx") + 1),
        "vs_avg": F.when(
            F.col("_t") != 0,
            (F.col("n") * (F.col("idx") + 1) - F.col("_t")).cast("double") / F.col("_t"),
        ),
    }).drop("_t")


def window_presets(latest: int, split_idx: int) -> list[dict]:
    """Month windows offered by default, as index ranges."""
    return [
        {"preset": "1mo", "lo": latest, "hi": latest},
        {"preset": "3mo", "lo": max(0, latest - 2), "hi": latest},
        {"preset": "12mo", "lo": max(0, latest - 11), "hi": latest},
        {"preset": "since_split", "lo": split_idx, "hi": latest},
        {"preset": "all", "lo": 0, "hi": latest},
    ]


def clamp_window(lo: Column, hi: Column, latest: Column, min_width: int = 1) -> tuple[Column, Column]:
    """A dragged window forced into [0, latest], ordered, and at least min_width wide."""
    a = clamp(lo, F.lit(0), latest)
    b = clamp(hi, a, latest)
    wide = F.when(b - a + 1 < min_width, F.least(latest, a + min_width - 1)).otherwise(b)
    return a, wide


def window_sums(s: DataFrame, windows: Sequence[dict], keys: Sequence[str] = KEYS) -> DataFrame:
    """Total of each window and of the same window a year before, with the change; the prior
    is null where it would start before the axis."""
    rows = s.withColumn("w", F.explode(param_array(windows)))
    i, lo, hi = F.col("idx"), F.col("w.lo"), F.col("w.hi")
    agg = rows.groupBy(*keys, F.col("w.preset").alias("preset"), lo.alias("lo"), hi.alias("hi")).agg(
        F.coalesce(F.sum(F.when(i.between(lo, hi), F.col("n"))), F.lit(0)).alias("cur"),
        F.coalesce(F.sum(F.when(i.between(lo - 12, hi - 12), F.col("n"))), F.lit(0)).alias("prior"),
    )
    return agg.withColumn("prior", F.when(F.col("lo") >= 12, F.col("prior"))).withColumn(
        "pct", pct_change(F.col("cur"), F.col("prior"))
    )


def share(s: DataFrame, on: Sequence[str] = ("signal", "period")) -> DataFrame:
    """District share of Citywide in each period, and its share to date and over all time."""
    part = W.partitionBy(*on)
    city = F.max(F.when(F.col("label") == CITYWIDE, F.col("n"))).over(part)
    rows = s.withColumn("city", city)
    run = _w(KEYS).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*KEYS)
    return rows.withColumns({
        "share": ratio(F.col("n"), F.col("city")),
        "share_to_date": ratio(F.sum("n").over(run), F.sum("city").over(run)),
        "share_all_time": ratio(F.sum("n").over(whole), F.sum("city").over(whole)),
        "share_t12": ratio(
            trailing_sum("n", 12), F.when(F.col("idx") >= 11, F.sum("city").over(_w(KEYS).rowsBetween(-11, 0)))
        ),
    }).where(F.col("label") != CITYWIDE)


def share_arrow(now: Column, typical: Column) -> Column:
    """Arrow that agrees with the printed integer percentages."""
    a, b = half_up(now * 100), half_up(typical * 100)
    return F.when(a.isNull() | b.isNull(), "").when(a > b, "up").when(a < b, "down").otherwise("flat")


def window_share(sums: DataFrame) -> DataFrame:
    """District share of Citywide over each window of `window_sums`."""
    part = W.partitionBy("signal", "preset")
    city = F.max(F.when(F.col("label") == CITYWIDE, F.col("cur"))).over(part)
    return sums.withColumn("share", ratio(F.col("cur"), city)).where(F.col("label") != CITYWIDE)


def week_partner(weekly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each week beside the week 364 days earlier, which on a Monday axis is a Monday too."""
    prior = weekly.select(
        *keys, F.date_add("period", 364).alias("period"), F.col("n").alias("prior"),
    )
    return weekly.join(prior, [*keys, "period"], "left")


def nearest_week(weeks: DataFrame, targets: DataFrame) -> DataFrame:
    """Axis week closest to each target date, the earlier one on a tie.  The candidates are
    the target's own Monday and its neighbours, then the axis ends for targets beyond it."""
    ends = weeks.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    lo, hi = ends.select("a").scalar(), ends.select("b").scalar()
    monday = F.date_sub("target", F.weekday("target"))
    near = F.array(monday, F.date_add(monday, 7))
    c = targets.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(
        "period", F.explode(F.array_distinct(F.transform(near, lambda d: F.greatest("_lo", F.least("_hi", d)))))
    )
    gap = F.abs(F.datediff("period", "target"))
    return c.groupBy("target").agg(F.min(F.struct(gap.alias("gap"), "period")).alias("m")).select(
        "target", F.col("m.period").alias("period")
    )


def kpi_chips(
    monthly: DataFrame, weekly: DataFrame, month: Column, week: Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """1-month, 3-month and fortnight change on a year, anchored at a settled month and week;
    needs 13 months.  A fortnight over a small base is flagged, not hidden."""
    m = monthly.withColumns({
        "cur1": F.col("n"), "prior1": lagged("n", 12, keys),
        "cur3": trailing_sum("n", 3, keys), "prior3": trailing_sum("n", 3, keys, 12),
    }).where((F.col("period") == month) & (F.col("idx") >= 12))
    two = weekly.withColumn("two", trailing_sum("n", 2, keys)).select(*keys, "period", "two")
    now2 = two.where(F.col("period") == week).select(*keys, F.col("two").alias("cur2"))
    old2 = two.where(F.col("period") == F.date_sub(week, 364)).select(*keys, F.col("two").alias("prior2"))
    chips = m.join(now2, list(keys), "left").join(old2, list(keys), "left")
    return chips.select(
        *keys, "cur1", "prior1", pct_int(F.col("cur1"), F.col("prior1")).alias("change_1mo"),
        "cur3", "prior3", pct_int(F.col("cur3"), F.col("prior3")).alias("change_3mo"),
        "cur2", "prior2", pct_int(F.col("cur2"), F.col("prior2")).alias("change_2wk"),
        F.coalesce(F.col("prior2") < fixed.LOW_BASE, F.lit(False)).alias("low_base"),
    )


def fixed_window_yoy(events: DataFrame, as_of: str, keys: Sequence[str], settle: int = 2) -> DataFrame:
    """Last 1 and 3 months and last 14 days before the settled boundary, each against the same
    span a year (364 days for the fortnight) earlier, in one aggregation."""
    end = F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -settle)
    day = F.col("day")

    def n(lo: Column, hi: Column, name: str) -> Column:
        return F.count_if((day >= lo) & (day < hi)).alias(name)

    year = F.add_months(end, -12)
    end2 = F.date_sub(end, 364)
    rows = events.where((day >= F.add_months(end, -15)) & (day < end)).groupBy(*keys).agg(
        n(F.add_months(end, -1), end, "last1"), n(F.add_months(year, -1), year, "prior1"),
        n(F.add_months(end, -3), end, "last3"), n(F.add_months(year, -3), year, "prior3"),
        n(F.date_sub(end, 14), end, "last2w"), n(F.date_sub(end2, 14), end2, "prior2w"),
    )
    return rows.withColumns({
        "change_1mo": pct_int(F.col("last1"), F.col("prior1")),
        "change_3mo": pct_int(F.col("last3"), F.col("prior3")),
        "change_2wk": pct_int(F.col("last2w"), F.col("prior2w")),
    })


def newest_peek(s: DataFrame, complete: Column, settled: Column, completeness: Column) -> DataFrame:
    """The complete month that is held back, if any and if it has counts."""
    return s.where(
        (F.col("period") == complete) & (complete != settled) & (F.col("n") > 0)
    ).withColumn("completeness", completeness)


def time_slice(cubed: DataFrame, buckets: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Series of a chosen subset of time-of-day buckets."""
    return cubed.where(F.col("bucket").isin(*buckets)).groupBy(*keys).agg(F.sum("n").alias("n"))


def verdict(pct: Column, goal: Column) -> Column:
    """Direction-aware verdict, strictly beyond +-5 %."""
    says = fixed.VERDICT_LABELS
    up = goal == "up"
    better = F.when(up, pct > fixed.VERDICT_BAND).otherwise(pct < -fixed.VERDICT_BAND)
    worse = F.when(up, pct < -fixed.VERDICT_BAND).otherwise(pct > fixed.VERDICT_BAND)
    return (
        F.when(pct.isNull(), says["no_history"])
        .when(better, F.when(up, says["up_good"]).otherwise(says["down_good"]))
        .when(worse, F.when(up, says["up_bad"]).otherwise(says["down_bad"]))
        .otherwise(says["flat"])
    )


def trend_verdict(pct: Column) -> tuple[Column, Column]:
    """Label and tone of a change in reports, at or beyond +-5 %."""
    down, up = pct <= -fixed.VERDICT_BAND, pct >= fixed.VERDICT_BAND
    says = fixed.VERDICT_LABELS
    label = F.when(down, says["down_good"]).when(up, says["down_bad"]).otherwise(says["flat"])
    tone = F.when(down, "good").when(up, "bad").otherwise("flat")
    return label, tone


def delta_class(pct: Column) -> Column:
    """up / down / flat with a +-0.5 % dead band."""
    return F.when(pct > fixed.TONE_BAND, "up").when(pct < -fixed.TONE_BAND, "down").otherwise("flat")


def goal_tone(pct: Column, goal: Column) -> Column:
    """good / bad by goal direction, flat inside the dead band or without a value."""
    good = F.when(goal == "up", pct > 0).otherwise(pct < 0)
    return F.when(pct.isNull() | (F.abs(pct) < fixed.TONE_BAND), "flat").when(good, "good").otherwise("bad")


def badge(change: Column, goal: Column) -> Column:
    """KPI badge: none without data, good when it moves towards the goal, else bad."""
    good = ((goal == "down") & (change < 0)) | ((goal == "up") & (change > 0))
    return F.when(change.isNull(), "nodata").when(good, "good").otherwise("bad")

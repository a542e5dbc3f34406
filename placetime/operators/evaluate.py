"""Before/after evaluation of many interventions at once.

Interventions are joined to events by grid cell; events are first reduced to counts per
lever, position and day, so a busy corner enters the join once per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import timekeys as tk
from ..functions.joins import is_small, spread_out
from ..functions.numbers import clamp
from .spatial import near_pairs


CIRCLE = ("t_lat", "t_lng", "radius")


def circle_counts(
    interventions: DataFrame, events: DataFrame, max_radius: float, history_start: str | None = None
) -> DataFrame:
    """Daily counts (t_lat, t_lng, radius, lever, day, n) of events inside each distinct circle, once however many
    interventions share it.  interventions: lat_e5, lng_e5, radius."""
    rows = events.where("lat_e5 is not null and day is not null")
    if history_start:
        rows = rows.where(F.col("day") >= F.lit(history_start).cast("date"))
    daily = rows.groupBy("lever", "lat_e5", "lng_e5", "day").agg(F.count(F.lit(1)).alias("n"))
    circles = circle_of(interventions).select(*CIRCLE).distinct()
    # and each distinct position is tested once, however many days and levers it has
    spots = daily.select("lat_e5", "lng_e5").distinct()
    reach = near_pairs(spots, circles, F.col("radius").cast("double"), max_radius, scale_at="target")
    reach = reach.select("lat_e5", "lng_e5", *CIRCLE)
    return daily.join(reach, ["lat_e5", "lng_e5"]).groupBy(*CIRCLE, "lever", "day").agg(F.sum("n").alias("n"))


def circle_of(interventions: DataFrame) -> DataFrame:
    """Interventions with the columns of their circle."""
    return interventions.withColumnsRenamed({"lat_e5": "t_lat", "lng_e5": "t_lng"})


def event_radius_join(
    interventions: DataFrame, events: DataFrame, max_radius: float, history_start: str | None = None
) -> DataFrame:
    """Daily counts (intervention, lever, day, n) of each lever's events inside the pin's
    radius.  interventions: id, levers, lat_e5, lng_e5, radius.

    The result has a row for each pin, lever and day; counts over days are cheaper from `circle_counts`."""
    pins = circle_of(interventions).select(F.col("id").alias("intervention"), "levers", *CIRCLE)
    counts = circle_counts(interventions, events, max_radius, history_start)
    if is_small(pins):      # many pins may share a circle: its days are dealt to the tasks
        met = spread_out(counts, [*CIRCLE, "lever", "day"]).join(F.broadcast(pins), list(CIRCLE)).where(F.array_contains("levers", F.col("lever")))
    else:
        on = [*CIRCLE, "lever"]
        by_lever = pins.withColumn("lever", F.explode(F.array_distinct("levers")))
        met = spread_out(counts, on).join(spread_out(by_lever, on), on)
    return met.select("intervention", "lever", "day", "n")


def counts_between(daily: DataFrame, spans: DataFrame, keys: Sequence[str], lo: str, **upto: str) -> DataFrame:
    """Spans with, by each name in `upto`, what the key's days from lo to the day in that column hold.  daily: keys, day, n.

    Running totals of a key are kept at the days that spans begin after and end at, so the work is that of the days
    and of the spans, not of the days of each span.
    """
    ends = F.explode(F.array(F.date_sub(lo, 1), *map(F.col, upto.values())))
    marks = spans.select(*keys, ends.alias("day")).where("day is not null").distinct().withColumns({"n": F.lit(0).cast("long"), "_mark": F.lit(1)})
    days = daily.select(*keys, "day", F.col("n").cast("long").alias("n"), F.lit(0).alias("_mark")).unionByName(marks)
    days = days.groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.max("_mark").alias("_mark"))
    run = F.sum("n").over(W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    totals = days.withColumn("_total", run).where("_mark = 1")
    zero = F.lit(0).cast("long")

    def at(met: DataFrame, col: str, day: Column, out: str) -> DataFrame:
        return met.join(totals.select(*keys, day.alias(col), F.col("_total").alias(out)), [*keys, col], "left")

    met = at(spans, lo, F.date_add("day", 1), "_before")
    for out, hi in upto.items():
        n = F.when(F.col(lo) <= F.col(hi), F.coalesce(f"_{out}", zero) - F.coalesce("_before", zero)).otherwise(zero)
        met = at(met, hi, F.col("day"), f"_{out}").withColumn(out, n).drop(f"_{out}")
    return met.select(*spans.columns, *upto)


def _met_again(rows: DataFrame, found: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with what was found for their values of `on`, nulls included."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    new = [c for c in found.columns if c not in on]
    return rows.alias("a").join(found.alias("b"), same, how).select("a.*", *[F.col(f"b.{c}") for c in new])


def before_after(daily: DataFrame, windows: DataFrame, keys: Sequence[str] = ("intervention", "lever")) -> DataFrame:
    """Counts and 30-day rates before and from the intervention day inside [start, end].

    windows: rows with the keys of daily, date, start, end; other columns stay.  Equal windows of a key are counted
    once.  pct is infinite when a quiet spot became active, 0 when both sides are empty.
    """
    same = [*keys, "date", "start", "end"]
    last_before = F.when(F.col("date").isNotNull() & F.col("end").isNotNull(), F.least("end", F.date_sub("date", 1)))
    spans = windows.select(*same).distinct().withColumn("cut", last_before)
    c = counts_between(daily, spans, keys, "start", total="end", pre="cut").drop("cut")
    c = _met_again(windows, c, same)
    past_end = F.date_add("end", 1)
    split = clamp(F.col("date"), F.col("start"), past_end)
    c = c.withColumns({
        "post": F.col("total") - F.col("pre"),
        "pre_days": F.greatest(F.lit(0), F.datediff(split, "start")),
        "post_days": F.greatest(F.lit(0), F.datediff(past_end, split)),
    })

    def rate(n: str, d: str) -> Column:
        return F.when(F.col(d) > 0, F.col(n).cast("double") / F.col(d) * 30).otherwise(0.0)

    c = c.withColumns({"pre_rate": rate("pre", "pre_days"), "post_rate": rate("post", "post_days")})
    a, b = F.col("pre_rate"), F.col("post_rate")
    return c.withColumns({
        "pct": F.when(a > 0, (b - a) / a * 100).when(b > 0, float("inf")).otherwise(0.0),
        "direction": F.when(b < a, "down").when(b > a, "up").otherwise("flat"),
        "short_window": (F.col("post_days") > 0) & (F.col("post_days") < 30),
        "in_window": F.col("date").between(F.col("start"), F.col("end")),
    })


def bucket_series(daily: DataFrame, windows: DataFrame, keys: Sequence[str] = ("intervention", "lever")) -> DataFrame:
    """Zero-filled bars over each window; day, week or month bars by its length.  Equal windows of a key are counted once.

    windows: rows with the keys of daily, start, end; other columns but date stay."""
    same = [*keys, "start", "end"]
    w = windows.select(*same).distinct().withColumn("gran", tk.granularity(F.col("start"), F.col("end")))
    steps = (
        F.when(F.col("gran") == "day", F.sequence("start", "end", F.expr("interval 1 day")))
        .when(F.col("gran") == "week", tk.week_steps(F.col("start"), F.col("end")))
        .otherwise(tk.month_steps(tk.month_start(F.col("start")), F.col("end")))
    )
    bars = w.select(*same, "gran", F.explode(steps).alias("bucket"))
    last = F.when(F.col("gran") == "day", F.col("bucket")).when(F.col("gran") == "week", F.date_add("bucket", 6)).otherwise(F.last_day("bucket"))
    counted = counts_between(daily, bars.withColumns({"lo": F.greatest("bucket", "start"), "hi": F.least(last, F.col("end"))}), keys, "lo", n="hi")
    others = [c for c in windows.columns if c not in ("date", "start", "end")]
    return _met_again(windows, counted.drop("lo", "hi"), same).select(*others, "gran", "bucket", "n")


def detect_onset(
    daily: DataFrame, pins: DataFrame, history_start: str, keys: Sequence[str] = ("intervention",)
) -> DataFrame:
    """Suggested window start: onset of the latest elevated run before the intervention.

    Monthly counts before the intervention day; the bar is max(2 b, b + 2) for the median b
    of all but the last three months; the run is the trailing stretch of months whose
    three-month mean stays at or above the bar.  Falls back to 90 days back when history is
    shorter than six months, has under twelve events, or the run is under two months;
    an intervention before the history has no months and no bar.

    pins: rows with the keys of daily and a date; other columns stay.  Equal dates of a key are looked at once.
    """
    first = F.lit(history_start).cast("date")
    one = [*keys, "date"]
    axis = spread_out(pins.select(*one).distinct(), one).select(*one, F.posexplode(
        tk.month_steps(F.trunc(first, "MM"), F.trunc("date", "MM"))
    ).alias("idx", "month"))
    spans = axis.withColumns({"lo": F.col("month"), "hi": F.least(F.last_day("month"), F.date_sub("date", 1))})
    s = counts_between(daily, spans, keys, "lo", n="hi").drop("lo", "hi")
    whole = W.partitionBy(*one)
    recent = whole.orderBy("idx").rowsBetween(-2, 0)
    s = s.withColumns({
        "months": F.count(F.lit(1)).over(whole), "roll": F.avg("n").over(recent),
        "total_pre": F.sum("n").over(whole),
    })
    early = F.col("idx") < F.greatest(F.lit(1), F.col("months") - 3)
    baseline = F.median(F.when(early, F.col("n"))).over(whole)
    s = s.withColumn("baseline", baseline).withColumn(
        "bar", F.greatest(F.col("baseline") * 2, F.col("baseline") + 2)
    )
    # the trailing run starts right after the last month below the bar
    last_low = F.max(F.when(F.col("roll") < F.col("bar"), F.col("idx")))
    runs = s.groupBy(*one, "months", "total_pre", "bar").agg(
        F.coalesce(last_low + 1, F.lit(0)).alias("onset_idx")
    )
    runs = _met_again(pins, runs, one, "left").fillna(0, ["months", "total_pre", "onset_idx"])
    found = (
        (F.col("months") >= 6) & (F.col("total_pre") >= 12)
        & (F.col("months") - F.col("onset_idx") >= 2)
    )
    onset = F.add_months(F.trunc(first, "MM"), F.col("onset_idx"))
    return runs.select(
        *pins.columns, "bar",
        F.when(found, tk.ym(onset)).alias("onset_month"),
        F.greatest(first, F.when(found, onset).otherwise(F.date_sub("date", 90))).alias("start"),
        F.when(found, "regime").otherwise("fallback").alias("method"),
    )


def breaks_crossed(windows: DataFrame, breaks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Windows that straddle a known reporting change: start < break date < end."""
    marks = F.array(*[
        F.struct(F.lit(lever).alias("lever"), F.lit(date).alias("date"), F.lit(label).alias("label"))
        for lever, date, label in breaks
    ])
    hit = F.filter(
        marks,
        lambda b: (b["lever"] == F.col("lever"))
        & (F.col("start") < b["date"].cast("date")) & (b["date"].cast("date") < F.col("end")),
    )
    return windows.withColumn("b", F.explode(hit)).select(
        *windows.columns, F.col("b.date").alias("break_date"), F.col("b.label").alias("break_label")
    )


def settling_flag(end: Column, lag_months: Column | int, today: str) -> Column:
    """The window ends inside the months that are still filling up."""
    lag = F.lit(lag_months) if isinstance(lag_months, int) else lag_months
    edge = F.date_sub(F.lit(today).cast("date"), (lag * 31).cast("int"))
    return F.datediff(end, edge) > 0


def cap_report(events: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """What a newest-first row cap would have loaded: whether it bites, and the oldest day it
    still reaches.  Reads a daily histogram; no rows are dropped."""
    per_day = events.where("day is not null").groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("c"))
    newest = W.partitionBy(*keys).orderBy(F.desc("day"))
    run = F.sum("c").over(newest.rowsBetween(W.unboundedPreceding, 0))
    before = F.col("run") - F.col("c")
    return per_day.withColumn("run", run).groupBy(*keys).agg(
        F.max("run").alias("rows"),
        (F.max("run") >= cap).alias("truncated"),
        F.min(F.when(before < cap, F.col("day"))).alias("earliest"),
    )


def cap_warning(report: DataFrame, start: Column) -> DataFrame:
    return report.withColumn("incomplete", F.col("truncated") & (start < F.col("earliest")))

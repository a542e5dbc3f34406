"""Month, week, day and hour keys on wall-clock (time-zone free) timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def instant(ntz_ts: Column) -> Column:
    """Wall clock read as UTC, for operators that need an instant (watermarks, windows)."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, ntz_ts))


def wall_clock(ts: Column) -> Column:
    """Inverse of `instant`, whatever the session time zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.unix_seconds(ts), zero)


def ym(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def month_start(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def week_start(c: Column) -> Column:
    """Monday of the week; date arithmetic, so the session time zone never matters."""
    d = c.cast("date")
    return F.date_sub(d, F.weekday(d))


def day_offset(c: Column, epoch: str) -> Column:
    return F.datediff(c.cast("date"), F.lit(epoch).cast("date"))


def months_back(as_of: Column, n: int) -> Column:
    """First day of the month n months before as_of's month."""
    return F.add_months(F.trunc(as_of, "MM"), -n)


def month_length(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))


def month_end_after(month: Column, k: Column | int) -> Column:
    """Last day of the month k months after `month`."""
    return F.last_day(F.add_months(month, k))


def months_between_ym(a: Column, b: Column) -> Column:
    """Whole months from yyyy-MM text a to b."""
    def serial(c: Column) -> Column:
        return F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    return serial(b) - serial(a)


def minus_weeks(ts: Column, weeks: Column | int) -> Column:
    w = F.lit(weeks) if isinstance(weeks, int) else weeks
    return ts - F.make_dt_interval(w * 7)


def tod_bucket(hour: Column) -> Column:
    """day 06-19, night otherwise; an unknown hour is night."""
    is_day = (hour >= fixed.DAY_START_HOUR) & (hour < fixed.NIGHT_START_HOUR)
    return F.when(is_day, "day").otherwise("night")


def tod_granular(hour: Column, unknown: str | None = "night") -> Column:
    """Four-way partition; `unknown` is the bucket of null or negative hours."""
    out = None
    for name, hours in fixed.GRANULAR_HOURS.items():
        cond = hour.isin(*hours)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(unknown))


def granularity(start: Column, end: Column) -> Column:
    """Bar size that keeps a span readable: day <= 75 days, week <= 540, else month."""
    days = F.datediff(end, start) + 1
    return F.when(days <= 75, "day").when(days <= 540, "week").otherwise("month")


def bucket_start(day: Column, gran: Column) -> Column:
    return (
        F.when(gran == "day", day.cast("date"))
        .when(gran == "week", week_start(day))
        .otherwise(month_start(day))
    )


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")


def day_label(c: Column) -> Column:
    return F.date_format(c, "M/d")


def short_month_label(c: Column) -> Column:
    return F.date_format(c, "MMM ''yy")


def hour_label(hour: Column) -> Column:
    suffix = F.when(hour < 12, "a").otherwise("p")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), suffix)


def month_steps(lo: Column, hi: Column) -> Column:
    """Array of month starts from lo to hi, both inclusive; empty when hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )


def week_steps(lo: Column, hi: Column) -> Column:
    lo, hi = week_start(lo), week_start(hi)
    return F.when(hi >= lo, F.sequence(lo, hi, F.expr("interval 7 days"))).otherwise(
        F.array().cast("array<date>")
    )

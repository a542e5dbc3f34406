"""Dense count series.

Events are reduced once to a small cube (signal, district, period, bucket); every series,
split, group and total is then derived from that cube, so the raw rows are read and
shuffled a single time however many series are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import timekeys as tk
from ..functions.geo import to_e5
from ..functions.numbers import half_up, ratio
from ..functions.ranks import number_within

CITYWIDE = "Citywide"


def date_axis(spark, lo: str, hi: str, unit: str = "month") -> DataFrame:
    """(idx, period): contiguous month starts or Mondays from lo to hi, inclusive."""
    steps = tk.month_steps if unit == "month" else tk.week_steps
    start = F.trunc(F.lit(lo).cast("date"), "MM") if unit == "month" else F.lit(lo).cast("date")
    return spark.range(1).select(
        F.posexplode(steps(start, F.lit(hi).cast("date"))).alias("idx", "period")
    )


def axis_pointers(as_of: str, settle_months: int = 0) -> dict[str, Column]:
    """Current partial month, latest complete month and latest settled month."""
    d = F.lit(as_of).cast("date")
    return {
        "current_partial": tk.months_back(d, 0),
        "latest_complete": tk.months_back(d, 1),
        "latest_settled": tk.months_back(d, 1 + settle_months),
    }


def settled_week(settled_month: Column) -> Column:
    """Last Monday whose Sunday falls before the month after `settled_month`."""
    cutoff = F.add_months(settled_month, 1)
    return tk.week_start(F.date_sub(cutoff, 7))


def cube(
    events: DataFrame,
    period: Column,
    keys: Sequence[str] = ("signal", "district"),
    bucket: Column | None = None,
) -> DataFrame:
    """Counts by keys, period and day/night (or `bucket`)."""
    b = bucket if bucket is not None else tk.tod_bucket(F.col("hour"))
    return events.withColumns({"period": period, "bucket": b}).groupBy(*keys, "period", "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_cube(
    events: DataFrame, id_col: str, period: Column, keys: Sequence[str] = ("signal", "district")
) -> DataFrame:
    """Like cube, counting distinct ids inside each group.  Totals are sums of these, so an
    id in two groups counts in both."""
    rows = events.withColumns({"period": period, "bucket": tk.tod_bucket(F.col("hour"))})
    return rows.groupBy(*keys, "period", "bucket").agg(F.count_distinct(F.col(id_col)).alias("n"))


def by_label(cubed: DataFrame, districts: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """District series plus Citywide.  Citywide sums every row, so rows outside the listed
    districts count there only."""
    keys = ["signal", "period", *extra]
    labels = F.when(
        F.col("district").isin(*districts), F.array(F.col("district"), F.lit(CITYWIDE))
    ).otherwise(F.array(F.lit(CITYWIDE)))
    return cubed.withColumn("label", F.explode(labels)).groupBy(*keys, "label").agg(
        F.sum("n").alias("n")
    )


def densify(
    counts: DataFrame,
    keys: DataFrame,
    lo: Column,
    hi: Column,
    unit: str = "month",
    value: str = "n",
) -> DataFrame:
    """Every key at every period from lo to hi, zero where there is no count, with its axis
    index.  The axis is exploded beside the key rows; nothing is cross joined."""
    names = keys.columns
    steps = {
        "month": tk.month_steps,
        "week": tk.week_steps,
        "day": lambda a, b: F.sequence(a, b, F.expr("interval 1 day")),
    }[unit]
    grid = keys.select(*names, F.posexplode(steps(lo, hi)).alias("idx", "period"))
    return grid.join(counts.select(*names, "period", value), [*names, "period"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0).cast("long"))
    )


def label_keys(spark, signals: Sequence[str], districts: Sequence[str]) -> DataFrame:
    rows = [(s, d) for s in signals for d in (*districts, CITYWIDE)]
    return spark.createDataFrame(rows, "signal string, label string")


def recube(daily: DataFrame, unit: str, keys: Sequence[str] = ("signal", "district")) -> DataFrame:
    """A daily cube summed to months or weeks, so both come from one pass over the events."""
    start = tk.month_start if unit == "month" else tk.week_start
    return daily.withColumn("period", start(F.col("period"))).groupBy(*keys, "period", "bucket").agg(
        F.sum("n").alias("n")
    )


def dense_series(cubed: DataFrame, signals, districts, lo: str, as_of: str, unit: str = "month") -> DataFrame:
    """Signals x labels x periods of a cube, dense."""
    keys = label_keys(cubed.sparkSession, signals, districts)
    a, b = F.lit(lo).cast("date"), F.lit(as_of).cast("date")
    if unit == "month":
        a, b = F.trunc(a, "MM"), F.trunc(b, "MM")
    return densify(by_label(cubed, districts), keys, a, b, unit)


def dense_monthly(events: DataFrame, signals, districts, lo: str, as_of: str) -> DataFrame:
    return dense_series(cube(events, tk.month_start(F.col("day"))), signals, districts, lo, as_of)


def dense_weekly(events: DataFrame, signals, districts, lo: str, as_of: str) -> DataFrame:
    return dense_series(cube(events, tk.week_start(F.col("day"))), signals, districts, lo, as_of, "week")


def daily_to_weekly(events: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """Distinct ids per day, summed to Monday weeks."""
    daily = events.groupBy(*keys, "day").agg(F.count_distinct(F.col(id_col)).alias("n"))
    return daily.groupBy(*keys, tk.week_start(F.col("day")).alias("period")).agg(
        F.sum("n").alias("n")
    )


def tod_split(cubed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """day / night columns; their sum is the total."""
    def part(b: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b)

    return cubed.groupBy(*keys).agg(F.sum("n").alias("total"), part("day"), part("night"))


def granular_split(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four-way split, one column per bucket; they add up to the total."""
    b = tk.tod_granular(F.col("hour"))
    return events.withColumn("_b", b).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("_b") == k).alias(k) for k in ("morning", "afternoon", "evening", "night")],
    )


def group_sum(series: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member series of each group added up; members has group_key, signal."""
    return series.join(members, "signal").groupBy("group_key", *keys).agg(
        F.sum("n").alias("n")
    )


def aggregate_series(series: DataFrame, signals: Sequence[str], name: str) -> DataFrame:
    """Element-wise sum of some signals as a new signal."""
    return series.where(F.col("signal").isin(*signals)).groupBy("label", "period").agg(
        F.sum("n").alias("n")
    ).select(F.lit(name).alias("signal"), "label", "period", "n")


def composition(series: DataFrame, members: Sequence[str]) -> DataFrame:
    """Integer share of each member in the members' total, per label and period."""
    rows = series.where(F.col("signal").isin(*members))
    total = F.sum("n").over(W.partitionBy("label", "period"))
    share = F.coalesce(half_up(ratio(F.col("n") * 100, total)), F.lit(0).cast("long"))
    return rows.withColumn("pct", share)


def resolution_series(events: DataFrame, axes: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """One count column per resolution axis; other resolutions are in neither."""
    return events.groupBy(*keys).agg(
        *[F.count_if(F.col("resolution") == v).alias(k) for k, v in axes.items()]
    )


def monthly_count(events: DataFrame, cond: Column, keys: Sequence[str]) -> DataFrame:
    return events.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def map_category(events: DataFrame, col: str, mapping: dict[str, str], out: str = "kind") -> DataFrame:
    """Coarse type of a description, null where it has none."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return events.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(col)))


def type_mix(events: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    """Count per type, its share of typed rows, and the untyped share of all rows."""
    c = events.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    typed = F.sum(F.when(F.col(kind).isNotNull(), F.col("n"))).over(part)
    total = F.sum("n").over(part)
    return c.select(
        *keys, F.coalesce(F.col(kind), F.lit("untyped")).alias(kind), "n",
        half_up(
            F.when(F.col(kind).isNotNull(), ratio(F.col("n") * 100, typed)).otherwise(
                ratio(F.col("n") * 100, total)
            )
        ).alias("pct"),
    )


def residual_last(mix: DataFrame, kind: str, residual: str, keys: Sequence[str] = ()) -> DataFrame:
    """Order position by count, the residual bucket pinned last."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    order = part.orderBy(F.col(kind) == residual, F.desc("n"), kind)
    return mix.withColumn("pos", F.row_number().over(order))


def hour_histogram(events: DataFrame, keys: Sequence[str], weeks: float | None = None) -> DataFrame:
    """24 dense hours per key, with the first fullest hour flagged and, given a window length
    in weeks, the weekly average.  One aggregation with a counter per hour."""
    wide = events.where("hour is not null").groupBy(*keys).agg(
        *[F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    )
    counts = F.array(*[F.col(f"h{h}") for h in range(24)])
    peak = F.array_position(counts, F.array_max(counts)) - 1
    out = wide.select(*keys, peak.alias("_peak"), F.posexplode(counts).alias("hour", "n")).select(
        *keys, "hour", "n", (F.col("hour") == F.col("_peak")).alias("is_peak")
    )
    return out if weeks is None else out.withColumn("per_week", F.col("n") / float(weeks))


def corner_monthly(reports: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """Monthly counts per corner with one position each: the first month that has one, five
    decimals.  Corners never placed are dropped."""
    rows = reports.where("corner is not null and corner <> ''")
    by_month = rows.groupBy(*keys, "corner", "ym").agg(
        F.count(F.lit(1)).alias("n"), F.max("lat").alias("lat"), F.max("lng").alias("lng")
    )
    whole = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    months = W.partitionBy(*keys, "corner")          # at most one row per month
    first = F.min(F.when(whole, F.struct("ym", "lat", "lng"))).over(months)
    placed = by_month.withColumns({"p": first, "total": F.sum("n").over(months)})
    return placed.where("p is not null").select(
        *keys, "corner", "ym", "n", "total",
        to_e5(F.col("p.lat")).alias("lat_e5"), to_e5(F.col("p.lng")).alias("lng_e5"),
    )


def corner_window(corners: DataFrame, lo: str, hi: str, keys: Sequence[str] = ("district",)) -> DataFrame:
    """Each corner's reports in a month window."""
    return corners.groupBy(*keys, "corner").agg(
        F.coalesce(F.sum(F.when(F.col("ym").between(lo, hi), F.col("n"))), F.lit(0)).alias("n")
    )


def corner_boxes(corners: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    return corners.groupBy(*keys).agg(
        F.min("lat_e5").alias("south"), F.max("lat_e5").alias("north"),
        F.min("lng_e5").alias("west"), F.max("lng_e5").alias("east"),
        F.sum("n").alias("n"),
    )


RANK_SLICES = 32


def ranked(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Top k per key in a total order, in two steps: the best k of each key's slices, then of the key."""
    slice_ = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(RANK_SLICES)).alias("_slice")
    best = W.partitionBy(*keys, "_slice").orderBy(*order)
    few = df.select("*", slice_).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank", "_slice")
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return few.withColumn("rank", F.row_number().over(part.orderBy(*order))).where(F.col("rank") <= k)


def top_corners(reports: DataFrame, k: int = 7, keys: Sequence[str] = ("district",)) -> DataFrame:
    c = reports.where("corner is not null and corner <> ''").groupBy(*keys, "corner").agg(
        F.count(F.lit(1)).alias("n")
    )
    return ranked(c, k, keys, [F.desc("n"), F.col("corner")])


def ranked_corners(corners: DataFrame, lo: str, hi: str, k: int = 12, keys: Sequence[str] = ("district",)) -> DataFrame:
    """Busiest corners of a window with their share of the window total."""
    c = corner_window(corners, lo, hi, keys).where("n > 0")
    totals = c.groupBy(*keys).agg(F.sum("n").alias("window_total"))
    best = ranked(c, k, keys, [F.desc("n"), F.col("corner")])
    return best.join(totals, list(keys)).withColumn(
        "pct", half_up(ratio(F.col("n") * 100, F.col("window_total")))
    )


def break_audit(events: DataFrame, components: dict[str, Column], period: Column, keys: Sequence[str]) -> DataFrame:
    """Component series beside their union, one row counted once in the union."""
    conds = list(components.values())
    union = conds[0]
    for c in conds[1:]:
        union = union | c
    return events.withColumn("period", period).groupBy(*keys, "period").agg(
        F.count_if(union).alias("union"),
        *[F.count_if(c).alias(k) for k, c in components.items()],
    )


def counts_by(events: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Plain group counts: category by flag, arrivals by day, an excluded code by year."""
    rows = events if where is None else events.where(where)
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def recent_months_table(events: DataFrame, months: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Categories as rows, months as columns, zero filled."""
    rows = events.where(F.col("ym").isin(*months))
    return rows.groupBy(*keys).pivot("ym", list(months)).agg(F.count(F.lit(1))).na.fill(0)


def scoped(events: DataFrame, scopes: Sequence[dict[str, str | None]], cols: Sequence[str]) -> DataFrame:
    """Repeat each row for every scope it belongs to; a null scope field means any.

    scopes: dicts with `scope` and a value or None per column of cols.
    """
    def tag(s: dict) -> Column:
        cond = F.lit(True)
        for c in cols:
            if s.get(c) is not None:
                cond = cond & (F.col(c) == s[c])
        return F.when(cond, F.lit(s["scope"]))

    marks = F.filter(F.array(*[tag(s) for s in scopes]), lambda x: x.isNotNull())
    return events.withColumn("scope", F.explode(marks))


def group_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows arranged by key: each row with its position in its key's list and the list's
    length.  The lists stay rows, so a key of any size is spread over tasks."""
    return number_within(df, [key], order, size="size")

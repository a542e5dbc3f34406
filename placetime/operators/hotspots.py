"""Grid-cell hotspots judged against their district: a difference-in-differences class per
cell for any set of windows, read from one small cells-by-month table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, timekeys as tk
from ..functions.joins import param_array
from ..functions.numbers import half_up, ratio
from ..functions.text import clean_location
from .rollup import ranked
from .spatial import cell_of

CELL = ("signal", "cy", "cx")
BUCKETS = ("day", "night")


def located(events: DataFrame, districts: Sequence[str]) -> DataFrame:
    """In-district events with coordinates, with their cell."""
    return cell_of(
        events.where(F.col("district").isin(*districts) & F.col("lat_e5").isNotNull())
    )


def _splits() -> list[Column]:
    b, g = tk.tod_bucket(F.col("hour")), tk.tod_granular(F.col("hour"))
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(b == k).alias(k) for k in BUCKETS],
        *[F.count_if(g == k).alias(f"g_{k}") for k in fixed.GRANULAR_HOURS],
    ]


COUNTS = ("n", *BUCKETS, *[f"g_{k}" for k in fixed.GRANULAR_HOURS])


def cell_cube(placed: DataFrame) -> DataFrame:
    """The one aggregation over located events: per cell, district and month, the total, its
    time-of-day splits, coordinate sums and the latest event time.

    Every buffer is fixed-width, so it is a hash aggregation with map-side partials.  Cell
    facts, cell months and district months all derive from this small table; write it once
    (`functions.ranks.materialize`) when more than one of them is needed.
    """
    rows = placed.withColumn("period", tk.month_start(F.col("day")))
    return rows.groupBy(*CELL, "district", "period").agg(
        *_splits(),
        F.sum("lat_e5").alias("lat_sum"), F.sum("lng_e5").alias("lng_sum"), F.max("ts").alias("last_ts"),
    )


def _months(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cube.groupBy(*keys, "period").agg(*[F.sum(c).alias(c) for c in COUNTS])


def cells_monthly(cube: DataFrame) -> DataFrame:
    """Per cell and month: total, day, night and the four granular buckets."""
    return _months(cube, CELL)


def district_monthly(cube: DataFrame) -> DataFrame:
    """The tide's denominators: every located event by district and month, with its splits."""
    return _months(cube, ("signal", "district"))


def cell_facts(cube: DataFrame, floor: int = fixed.CELL_FLOOR) -> DataFrame:
    """Cells with enough all-time volume: total, centroid, and the district of their latest
    event (of the later name on a tie)."""
    facts = cube.groupBy(*CELL).agg(
        F.sum("n").alias("total"), F.sum("lat_sum").alias("_lat"), F.sum("lng_sum").alias("_lng"),
        F.max(F.struct("last_ts", "district")).alias("_l"),
    ).where(F.col("total") >= floor)
    mean = lambda c: F.round(F.col(c) / F.col("total")).cast("int")
    return facts.select(
        *CELL, "total", mean("_lat").alias("lat_e5"), mean("_lng").alias("lng_e5"),
        F.col("_l.district").alias("district"),
    )


def dominant_name(placed: DataFrame, name: str = "name") -> DataFrame:
    """Most frequent cleaned place name per cell; ties go to the name seen first."""
    rows = placed.where(F.coalesce(F.col(name), F.lit("")) != "")
    raw = rows.groupBy(*CELL, name).agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("first_seen"))
    counts = raw.groupBy(*CELL, clean_location(F.col(name)).alias("_name")).agg(
        F.sum("c").alias("c"), F.min("first_seen").alias("first_seen")
    )
    best = ranked(counts, 1, CELL, [F.desc("c"), F.col("first_seen"), F.col("_name")])
    return best.select(*CELL, F.col("_name").alias("name"))


def slice_value(slice_name: str) -> Column:
    """Value column of a time slice: 'all', 'day', 'night', or granular names joined by '+'."""
    if slice_name == "all":
        return F.col("n")
    cols = [F.col(p if p in BUCKETS and "+" not in slice_name else f"g_{p}") for p in slice_name.split("+")]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def window_rows(windows: Sequence[dict]) -> list[dict]:
    """Window parameters with month counts.  Each needs key, lo, hi, base_lo, base_hi
    (first-of-month ISO dates, inclusive) and optionally slice."""
    def months(a: str, b: str) -> int:
        return (int(b[:4]) - int(a[:4])) * 12 + int(b[5:7]) - int(a[5:7]) + 1

    return [
        {
            "key": w["key"], "lo": w["lo"], "hi": w["hi"],
            "base_lo": w["base_lo"], "base_hi": w["base_hi"],
            "slice": w.get("slice", "all"),
            "now_months": months(w["lo"], w["hi"]),
            "pre_months": months(w["base_lo"], w["base_hi"]),
        }
        for w in windows
    ]


def _window_counts(monthly: DataFrame, keys: Sequence[str], params: list[dict]) -> DataFrame:
    slices = sorted({p["slice"] for p in params})
    value = None
    for s in slices:
        v = slice_value(s)
        value = F.when(F.col("w.slice") == s, v) if value is None else value.when(F.col("w.slice") == s, v)
    rows = monthly.withColumn("w", F.explode(param_array(params))).withColumn("_v", value)
    period = F.col("period").cast("string")
    now = period.between(F.col("w.lo"), F.col("w.hi"))
    pre = period.between(F.col("w.base_lo"), F.col("w.base_hi"))

    def total(cond: Column, v: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, v)), F.lit(0).cast("long")).alias(name)

    return rows.groupBy(
        *keys, F.col("w.key").alias("window"), F.col("w.now_months").alias("now_months"),
        F.col("w.pre_months").alias("pre_months"),
    ).agg(
        total(pre, F.col("_v"), "pre"), total(now, F.col("_v"), "now"),
        total(now, F.col("day"), "now_day"), total(now, F.col("night"), "now_night"),
    )


def district_tide(districts_monthly: DataFrame, windows: Sequence[dict]) -> DataFrame:
    """Monthly rate of each district now over its baseline rate; 1 without a baseline."""
    c = _window_counts(districts_monthly, ("signal", "district"), window_rows(windows))
    pre, now = F.col("pre") / F.col("pre_months"), F.col("now") / F.col("now_months")
    return c.select(
        "signal", "district", "window", pre.alias("d_pre"), now.alias("d_now"),
        F.when(F.col("pre") > 0, now / F.nullif(pre, F.lit(0.0))).otherwise(1.0).alias("tide"),
    )


def classify_cells(
    cube: DataFrame,
    windows: Sequence[dict],
    hot: float,
    floor: int = fixed.CELL_FLOOR,
    band: float = fixed.TIDE_BAND,
) -> DataFrame:
    """Class of each cell of a `cell_cube` in each window.

    A cell is expected to move as its district did (its baseline rate times the tide).
    persistent: hot before and now; cooled: fell beyond the band and was hot before or is
    not hot now; emerged: newly hot and beyond the band above the expected rate; null: the
    rest, including newly hot cells that only tracked their district.
    """
    facts, monthly, districts_monthly = cell_facts(cube, floor), cells_monthly(cube), district_monthly(cube)
    params = window_rows(windows)
    kept = monthly.join(facts.select(*CELL, "district", "total"), list(CELL))
    c = _window_counts(kept, (*CELL, "district", "total"), params)
    tide = district_tide(districts_monthly, windows).select("signal", "district", "window", "tide")
    j = c.join(tide, ["signal", "district", "window"], "left")
    j = j.withColumn("tide", F.coalesce("tide", F.lit(1.0)))
    j = j.withColumns({
        "pre_rate": F.col("pre") / F.col("pre_months"),
        "now_rate": F.col("now") / F.col("now_months"),
    }).withColumn("expected_rate", F.col("pre_rate") * F.col("tide"))
    volume = F.col("pre") + F.col("now")
    hot_before, hot_now = F.col("pre_rate") >= hot, F.col("now_rate") >= hot
    rose = F.col("now_rate") > F.col("expected_rate") * (1 + band)
    fell = F.col("now_rate") < F.col("expected_rate") * (1 - band)
    none = F.lit(None).cast("string")
    category = (
        F.when((volume < floor) | ~(hot_before | hot_now), none)
        .when(hot_now & ~hot_before, F.when(rose, "emerged"))
        .when(fell, "cooled")
        .when(hot_before & hot_now, "persistent")
    )
    return j.withColumns({
        "category": category,
        "night_pct": ratio(F.col("now_night") * 100, F.col("now_day") + F.col("now_night")),
    })


def category_counts(classified: DataFrame) -> DataFrame:
    """Cells per class by district and citywide."""
    labels = F.explode(F.array("district", F.lit("Citywide"))).alias("label")
    return (
        classified.where("category is not null")
        .select("signal", "window", labels, "category")
        .groupBy("signal", "window", "label", "category").agg(F.count(F.lit(1)).alias("cells"))
    )


def cell_breakdown(
    placed: DataFrame, kind: str, k: int = 8, buckets: Sequence[str] | None = None
) -> DataFrame:
    """Top kinds per cell with their share of the shown total; with `buckets`, rows with an
    unknown hour drop out."""
    rows = placed
    if buckets is not None:
        rows = rows.where(tk.tod_granular(F.col("hour"), unknown=None).isin(*buckets))
    counts = rows.groupBy(*CELL, F.coalesce(F.col(kind), F.lit("")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )
    top = ranked(counts, k, CELL, [F.desc("n"), F.col("kind")])
    shown = F.sum("n").over(W.partitionBy(*CELL))
    return top.withColumn("pct", half_up(ratio(F.col("n") * 100, shown)))

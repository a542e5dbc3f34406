"""Deterministic samples and recent windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import timekeys as tk
from ..functions.ranks import global_rank


def systematic_sample(df: DataFrame, size: int, order: Sequence[Column], bucket: Column | None = None) -> DataFrame:
    """Rows at the positions floor(i * rows / size) of a total order, i = 0 .. size - 1 (every row when there are
    fewer than `size`).  `order`: ascending columns whose values are unique together.

    Only the order columns are shuffled and put in order, in ranges of equal size whatever the values are; whole
    rows are fetched by the keys that were chosen.  bucket: a column that never falls along `order`, such as
    the day of a time order; buckets without a wanted position, known from counts, are not ordered at all.
    """
    names = [f"_o{k}" for k in range(len(order))]
    keys = df.select(F.lit(0).alias("_bucket") if bucket is None else bucket.alias("_bucket"), *[c.alias(n) for c, n in zip(order, names)])
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    run = W.partitionBy(F.lit(0)).orderBy(F.col("_bucket").asc_nulls_first())   # one row a bucket
    spans = counts.withColumns({
        "_end": F.sum("_c").over(run), "_n": F.sum("_c").over(W.partitionBy(F.lit(0))),
    }).withColumn("_start", F.col("_end") - F.col("_c"))
    size_ = F.lit(size).cast("long")
    first, last = (F.least(F.floor((F.col(c) * size_ + F.col("_n") - 1) / F.col("_n")).cast("long"), size_) for c in ("_start", "_end"))
    kept = spans.where(last > first).withColumn("_before", F.sum("_c").over(run) - F.col("_c"))
    wanted = kept.withColumn("_i", F.explode(F.sequence(first, last - 1))).select(
        (F.floor(F.col("_i") * F.col("_n") / size_).cast("long") - F.col("_start") + F.col("_before")).alias("_rank")
    ).distinct()
    few = keys.join(kept.select(F.col("_bucket").alias("_b")), F.col("_bucket").eqNullSafe(F.col("_b")), "left_semi")
    placed = global_rank(few, [F.col("_bucket").asc_nulls_first(), *[F.col(n).asc_nulls_first() for n in names]], "_rank")
    chosen = placed.join(wanted, "_rank", "left_semi").select(*names)
    same = F.lit(True)
    for c, n in zip(order, names):
        same = same & c.eqNullSafe(F.col(n))
    return df.join(chosen, same, "left_semi")


def recent_window(events: DataFrame, weeks: int, ts: str = "ts") -> DataFrame:
    """Rows of the last `weeks` weeks counted back from the newest row."""
    anchor = events.agg(F.max(ts)).scalar()
    return events.where(F.col(ts) >= tk.minus_weeks(anchor, weeks))


def hour_brush(events: DataFrame, hours: Sequence[int]) -> DataFrame:
    """Rows of the chosen hours; no choice keeps all."""
    return events.where(F.col("hour").isin(*hours)) if hours else events


def tod_filter(events: DataFrame, choice: str | Sequence[str], page: str = "both") -> DataFrame:
    """'both', 'day', 'night', or granular buckets, which override the page-level choice."""
    if not isinstance(choice, str):
        return events.where(tk.tod_granular(F.col("hour")).isin(*choice)) if choice else tod_filter(events, page)
    return events if choice == "both" else events.where(tk.tod_bucket(F.col("hour")) == choice)


def recent_flag(day: Column, as_of: str, months: int = 3) -> Column:
    """On or after the first day of the last `months` complete months."""
    return day >= tk.months_back(F.lit(as_of).cast("date"), months)

"""How concentrated activity is over targets (stops): curves, scales, tables, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.numbers import ratio
from ..functions.ranks import value_counts
from ..functions.text import basis_types, parse_stop_code
from .rollup import ranked


def target_totals(monthly: DataFrame, as_of: str, keys: Sequence[str] = ("id", "signal")) -> DataFrame:
    """Last-12-complete-months total, all-time total without the partial month, and the
    number of active months.  monthly: keys, period (month start), n."""
    partial = F.trunc(F.lit(as_of).cast("date"), "MM")
    done = monthly.where(F.col("period") < partial)
    recent = F.col("period") >= F.add_months(partial, -12)
    return done.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0).cast("long")).alias("t12"),
        F.sum("n").alias("all_time"),
        F.count_if(F.col("n") > 0).alias("active_months"),
    )


def active_months_union(monthly: DataFrame, signals: Sequence[str], as_of: str) -> DataFrame:
    """Months with at least one event in any chosen signal, per target."""
    partial = F.trunc(F.lit(as_of).cast("date"), "MM")
    rows = monthly.where(F.col("signal").isin(*signals) & (F.col("n") > 0) & (F.col("period") < partial))
    return rows.groupBy("id").agg(F.count_distinct("period").alias("active_months"))


MASK_MONTHS = 63


def month_mask(monthly: DataFrame, history_start: str, as_of: str) -> DataFrame:
    """Active months as bitmasks per target, signal and block of MASK_MONTHS months, so a history of
    any length keeps every month; months before `history_start` lie in negative blocks."""
    first = F.lit(history_start).cast("date")
    partial = F.trunc(F.lit(as_of).cast("date"), "MM")
    idx = F.floor(F.months_between(F.trunc("period", "MM"), F.trunc(first, "MM"))).cast("int")
    rows = monthly.where((F.col("n") > 0) & (F.col("period") < partial))
    block = F.floor(idx / MASK_MONTHS).cast("int").alias("block")
    return rows.groupBy("id", "signal", block).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(idx, F.lit(MASK_MONTHS)))).alias("mask")
    )


def masked_months(masks: DataFrame, keys: Sequence[str] = ("id", "signal")) -> DataFrame:
    """Active months from the masks of all blocks."""
    return masks.groupBy(*keys).agg(F.sum(F.bit_count("mask")).alias("months"))


def combined_totals(totals: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Totals of a chosen signal set; targets without activity in any of them drop out."""
    return totals.where(F.col("signal").isin(*signals)).groupBy("id").agg(
        F.sum("t12").alias("t12"), F.sum("all_time").alias("all_time")
    ).where("all_time > 0")


def concentration_curve(totals: DataFrame, keys: Sequence[str], value: str = "t12", ks: Sequence[int] = fixed.CURVE_POINTS) -> DataFrame:
    """Share of the whole held by the top k targets, for each k up to the number of targets.
    Only the top max(ks) per key are ever ordered."""
    whole = totals.groupBy(*keys).agg(F.sum(value).alias("total"))
    top = ranked(totals, max(ks), keys, [F.desc(value), F.col("id")])
    run = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    marks = top.withColumn("run", F.sum(value).over(run)).where(F.col("rank").isin(*ks))
    return marks.join(whole, list(keys)).select(
        *keys, F.col("rank").alias("top"), ratio(F.col("run"), F.col("total")).alias("share")
    )


def top_targets(totals: DataFrame, k: int = 25, keys: Sequence[str] = (), value: str = "t12") -> DataFrame:
    return ranked(totals, k, keys, [F.desc(value), F.col("id")])


def zero_targets(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """Sheltered targets with no activity in the given totals."""
    quiet = targets.where("shelter").join(totals.where("all_time > 0").select("id"), "id", "left_anti")
    return quiet.agg(F.count(F.lit(1)).alias("sheltered_with_zero"))


def signal_scale(totals: DataFrame, keys: Sequence[str] = ("signal",), value: str = "t12") -> DataFrame:
    """Citywide scale of a signal: the value at position floor(0.95 n) among positive targets,
    at least 3."""
    counts = value_counts(totals.where(F.col(value) > 0), keys, value)
    pos = F.floor(F.col("n") * 95 / 100) + 1
    return counts.groupBy(*keys).agg(
        F.min(F.when(F.col("cum") >= F.least(F.col("n"), pos), F.col(value))).alias("v")
    ).select(*keys, F.greatest(F.lit(3).cast("long"), F.col("v")).alias("scale"))


def relative_intensity(totals: DataFrame, scale: DataFrame, present: float = 0.25) -> DataFrame:
    """Per target and signal: intensity min(1.5, value / scale) and whether it is shown; plus
    the dominant signal (first on a tie) and a quiet flag."""
    t = totals.join(scale, "signal", "left").withColumn(
        "intensity", F.least(F.lit(1.5), F.coalesce(F.col("t12") / F.col("scale"), F.lit(0.0)))
    )
    best = t.groupBy("id").agg(
        F.min(F.struct((-F.col("intensity")).alias("i"), "signal")).alias("b"),
        F.sum("intensity").alias("total_intensity"),
    )
    best = best.select(
        "id", "total_intensity",
        F.when(F.col("b.i") < 0, F.col("b.signal")).alias("dominant"),
        (F.col("b.i") >= 0).alias("quiet"),
    )
    return t.join(best, "id").withColumn("shown", F.col("intensity") >= present)


def thin_data(totals: DataFrame, floor: int = 6) -> DataFrame:
    """Targets whose every signal has fewer than `floor` events in the last year."""
    return totals.groupBy("id").agg((F.max("t12") < floor).alias("thin"))


def overlay_list(raw: DataFrame, detail: bool = False) -> DataFrame:
    """Rows of the listed-stops overlay: code, id, location, boardings; with detail also the
    private columns."""
    def col(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit(""))) if name in raw.columns else F.lit("")

    rows = raw.where(col("Stop ID") != "")
    cols = [
        col("Stop ID").alias("code"), parse_stop_code(col("Stop ID")).alias("id"),
        col("Location").alias("list_location"),
        F.coalesce(F.nullif(col("Boardings"), F.lit("")), col("Lift deployments: Aver/day")).alias("boardings"),
    ]
    if detail:
        cols += [
            col("Police Precinct").alias("precinct"), col("Primary Issue").alias("issue"),
            col("Basis / Notes").alias("basis"), basis_types(col("Basis / Notes")).alias("basis_types"),
            F.nullif(col("Jan-Jun Rank"), F.lit("")).alias("missed_servicing_rank"),
            (F.lower(col("Needs Verification")) == "yes").alias("needs_verification"),
            (F.lower(col("Request for removals")) == "yes").alias("removal_requested"),
        ]
    return rows.select(*cols)


def overlay_match(listed: DataFrame, stops: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Listed rows with a matched flag, the stop's name and shelter, and which of its
    alternative stops are listed too.  alternatives: id, alt_id."""
    known = listed.join(stops.select("id", "name", "shelter"), "id", "left").withColumn(
        "matched", F.col("name").isNotNull()
    )
    on_list = known.where("matched").select(F.col("id").alias("alt_id")).distinct()
    alts = alternatives.join(on_list, "alt_id", "left_semi").groupBy("id").agg(
        F.array_sort(F.collect_set("alt_id")).alias("alts_on_list")
    )
    return known.join(alts, "id", "left").withColumn(
        "alts_on_list", F.coalesce("alts_on_list", F.array().cast("array<string>"))
    )


def overlay_totals(totals: DataFrame, listed: DataFrame) -> DataFrame:
    """Last-year totals over listed targets, per signal."""
    return totals.join(listed.select("id").distinct(), "id", "left_semi").groupBy("signal").agg(
        F.sum("t12").alias("t12"), F.count_distinct("id").alias("targets")
    )


def neighbour_mean(edges: DataFrame, monthly: DataFrame, keys: Sequence[str] = ("signal", "period")) -> DataFrame:
    """Mean series of each target's neighbours and how many it averages over.

    monthly may be sparse: a neighbour without a count is a zero, so the sum is divided by
    the number of neighbours."""
    size = edges.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
    nb = monthly.select(F.col("id").alias("nb_id"), *keys, "n")
    sums = edges.select("id", "nb_id").join(nb, "nb_id").groupBy("id", *keys).agg(F.sum("n").alias("n"))
    return sums.join(size, "id").select("id", *keys, "neighbours", (F.col("n") / F.col("neighbours")).alias("mean"))


def order_table(df: DataFrame, col: str, descending: bool = True, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(col) if descending else F.col(col), tie)

"""Checks that return violations(check, entity, detail); no rows means the check passes."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from ..sources.predicates import Predicate, same
from .rollup import CITYWIDE


def _violations(df: DataFrame, check: str, entity: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), entity.cast("string").alias("entity"),
        detail.cast("string").alias("detail"),
    )


def axis_gaps(axis: DataFrame, unit: str = "month") -> DataFrame:
    """Axis entries not followed by the next month or Monday.  An axis is one short list."""
    nxt = F.lead("period").over(W.partitionBy(F.lit(0)).orderBy("period"))
    want = F.add_months("period", 1) if unit == "month" else F.date_add("period", 7)
    rows = axis.select("period").withColumn("next", nxt).where(F.col("next").isNotNull())
    return _violations(rows.where(F.col("next") != want), "axis_gap", F.col("period"), F.col("next"))


def off_axis(pointers: DataFrame, axis: DataFrame) -> DataFrame:
    """Named pointers that are not on the axis.  pointers: name, period."""
    bad = pointers.where("period is not null").join(axis.select("period"), "period", "left_anti")
    return _violations(bad, "pointer_off_axis", F.col("name"), F.col("period"))


def sparse_series(series: DataFrame, axis_length: int, keys: Sequence[str] = ("signal", "label")) -> DataFrame:
    """Series with the wrong length, a null or a negative value."""
    per = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("n").isNull() | (F.col("n") < 0)).alias("bad"),
    )
    rows = per.where((F.col("rows") != axis_length) | (F.col("bad") > 0))
    return _violations(rows, "series_shape", F.concat_ws("/", *keys), F.concat_ws(" ", "rows", "bad"))


def citywide_below_sum(series: DataFrame) -> DataFrame:
    """Periods where Citywide is less than its districts together."""
    city = F.sum(F.when(F.col("label") == CITYWIDE, F.col("n")))
    parts = F.sum(F.when(F.col("label") != CITYWIDE, F.col("n")))
    per = series.groupBy("signal", "period").agg(city.alias("city"), parts.alias("parts"))
    return _violations(per.where("city < parts"), "citywide_below_sum",
                       F.concat_ws("/", "signal", F.col("period").cast("string")), F.concat_ws(" < ", "city", "parts"))


def set_check(a: DataFrame, b: DataFrame, col: str, mode: str = "equal") -> DataFrame:
    """equal: members of one side only; subset: members of a missing from b."""
    miss = a.select(col).distinct().join(b.select(col), col, "left_anti").select(col, F.lit("missing right").alias("side"))
    if mode == "equal":
        extra = b.select(col).distinct().join(a.select(col), col, "left_anti")
        miss = miss.unionByName(extra.select(col, F.lit("missing left").alias("side")))
    return _violations(miss, f"set_{mode}", F.col(col), F.col("side"))


def axis_prefix(short: DataFrame, full: DataFrame) -> DataFrame:
    """Positions where the short axis differs from the start of the full one."""
    j = short.select("idx", F.col("period").alias("a")).join(
        full.select("idx", F.col("period").alias("b")), "idx", "left"
    )
    return _violations(j.where(~F.col("a").eqNullSafe(F.col("b"))), "axis_prefix", F.col("idx"), F.col("a"))


CATEGORIES = ("persistent", "cooled", "emerged")


def bad_cells(cells: DataFrame, districts: Sequence[str], box: tuple[int, int, int, int]) -> DataFrame:
    """Cells whose months exceed their total, with an unknown class or district, or outside the
    box (south, west, north, east)."""
    south, west, north, east = box
    rules = {
        "months_over_total": F.col("month_sum") > F.col("total"),
        "bad_category": F.col("category").isNotNull() & ~F.col("category").isin(*CATEGORIES),
        "bad_district": ~F.coalesce(F.col("district").isin(*districts), F.lit(False)),
        "outside_box": ~(F.col("lat_e5").between(south, north) & F.col("lng_e5").between(west, east)),
    }
    marks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    rows = cells.withColumn("check", F.explode(marks))
    return rows.select("check", F.concat_ws("/", "signal", "cy", "cx").alias("entity"),
                       F.col("district").alias("detail"))


def empty_provenance(prov: DataFrame) -> DataFrame:
    return _violations(prov.where("records <= 0"), "no_records", F.col("signal"), F.col("records"))


def split_mismatch(df: DataFrame, parts: Sequence[str], total: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose parts do not add up to the total."""
    s = F.lit(0)
    for p in parts:
        s = s + F.coalesce(F.col(p), F.lit(0))
    return _violations(df.where(s != F.col(total)), "split_mismatch", F.concat_ws("/", *keys), F.col(total))


def reconcile(baked: DataFrame, source: DataFrame, keys: Sequence[str], ceiling: Column, tolerance: float = 0.0, recent_tolerance: float = 0.02, recent: int = 4) -> DataFrame:
    """Month-by-month difference of two series up to the settled month.  The most recent
    `recent` months of the axis get at least the recent tolerance."""
    last = F.max("period").over(W.partitionBy(*keys))
    b = baked.withColumn("_last", last).where(F.col("period") <= ceiling)
    j = b.select(*keys, "period", "_last", F.col("n").alias("baked")).join(
        source.select(*keys, "period", F.col("n").alias("source")), [*keys, "period"]
    )
    diff = F.col("source") - F.col("baked")
    pct = F.when(F.col("source") != 0, F.abs(diff).cast("double") / F.col("source")).otherwise(
        F.when(F.col("baked") == 0, 0.0).otherwise(1.0)
    )
    late = F.col("period") > F.add_months("_last", -recent)
    bar = F.when(late, F.lit(max(tolerance, recent_tolerance))).otherwise(F.lit(float(tolerance)))
    return j.withColumns({"diff": diff, "pct": pct}).withColumn("ok", F.col("pct") <= bar).drop("_last")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str = "n", cliff: float = fixed.CLIFF_BAND) -> DataFrame:
    """Full comparison of two snapshots: state and relative change per key, swings flagged."""
    o = old.select(*keys, F.col(value).alias("old"))
    n = new.select(*keys, F.col(value).alias("new"))
    j = o.join(n, list(keys), "full_outer")
    change = F.when(F.col("old") != 0, (F.col("new") - F.col("old")).cast("double") / F.col("old"))
    state = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone")
        .when((F.col("old") == 0) & (F.col("new") != 0), "new activity")
        .when(F.col("old") == F.col("new"), "same").otherwise("changed")
    )
    flagged = F.coalesce(F.abs(change) > cliff, F.lit(False)) | (
        (F.col("old") == 0) & F.coalesce(F.col("new") != 0, F.lit(False))
    )
    return j.withColumns({"state": state, "pct": change, "cliff": F.coalesce(flagged, F.lit(False))})


def registry_conflicts(registries: dict[str, Sequence], spark) -> DataFrame:
    """Signals with one key but different filters across registries, by the filters' normal forms: the order, nesting
    and repetition of terms do not count."""
    rows = [(r, s.key, repr(s.filter.normal())) for r, sigs in registries.items() for s in sigs]
    df = spark.createDataFrame(rows, "registry string, signal string, filter string")
    per = df.groupBy("signal").agg(
        F.count_distinct("filter").alias("filters"), F.array_sort(F.collect_set("registry")).alias("registries")
    )
    return _violations(per.where("filters > 1"), "filter_drift", F.col("signal"), F.array_join("registries", ","))


def filter_parity(tables: dict[str, DataFrame], pairs: dict[str, tuple[str, Predicate, Predicate]]) -> DataFrame:
    """Pairs of filters that should be one, by definition and by data: (entity, same_form, ours, theirs, apart).

    pairs: name -> (table, ours, theirs).  `same_form` compares normal forms, so it holds on any data; `apart`
    counts rows that only one of the two takes.  One pass a table."""
    out = None
    for table, df in tables.items():
        own = {name: (a, b) for name, (t, a, b) in pairs.items() if t == table}
        if not own:
            continue
        holds = lambda p: F.coalesce(p.column(), F.lit(False))
        tests = {f"{side}{k}": holds(p) for k, pair in enumerate(own.values()) for side, p in zip("ab", pair)}
        counts = df.select(*[c.alias(n) for n, c in tests.items()]).agg(
            *[F.count_if(n).alias(n) for n in tests], *[F.count_if(F.col(f"a{k}") != F.col(f"b{k}")).alias(f"x{k}") for k in range(len(own))]
        )
        rows = [
            F.struct(F.lit(name).alias("entity"), F.lit(same(a, b)).alias("same_form"), F.col(f"a{k}").alias("ours"), F.col(f"b{k}").alias("theirs"), F.col(f"x{k}").alias("apart"))
            for k, (name, (a, b)) in enumerate(own.items())
        ]
        one = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        out = one if out is None else out.unionByName(one)
    return out


def bad_stops(stops: DataFrame, neighbours: DataFrame, totals: DataFrame, box: tuple[int, int, int, int], sheltered: tuple[int, int] | None = None, unmatched: float = 0.05) -> DataFrame:
    """Stop-table checks: unique ids, inside the box, not its own neighbour, no negative
    totals, sheltered count in range, few stops missing from the feed."""
    south, west, north, east = box
    none = F.lit(None).cast("string")
    dup = stops.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = _violations(dup, "duplicate_id", F.col("id"), F.col("c"))
    off = stops.where(~(F.col("lat_e5").between(south, north) & F.col("lng_e5").between(west, east)))
    out = out.unionByName(_violations(off, "outside_box", F.col("id"), none))
    own = neighbours.where("id = nb_id")
    out = out.unionByName(_violations(own, "own_neighbour", F.col("id"), none))
    neg = totals.where("t12 < 0")
    out = out.unionByName(_violations(neg, "negative_total", F.col("id"), F.col("t12")))
    per = stops.agg(
        F.count_if("shelter").alias("s"), F.count_if(~F.col("in_feed")).alias("u"), F.count(F.lit(1)).alias("n")
    )
    if sheltered:
        rng = per.where(~F.col("s").between(*sheltered))
        out = out.unionByName(_violations(rng, "sheltered_count", F.lit("stops"), F.col("s")))
    miss = per.where(F.col("u") > F.col("n") * unmatched)
    return out.unionByName(_violations(miss, "not_in_feed", F.lit("stops"), F.col("u")))


def shard_cover(stops: DataFrame, shards: DataFrame) -> DataFrame:
    """Stops that no shard holds, and shard rows of no stop."""
    none = F.lit(None).cast("string")
    lost = stops.select("id").join(shards.select("id"), "id", "left_anti")
    extra = shards.select("id").join(stops.select("id"), "id", "left_anti")
    return _violations(lost, "not_in_shards", F.col("id"), none).unionByName(_violations(extra, "unknown_in_shards", F.col("id"), none))


def filter_drift(events: DataFrame, ours: dict[str, Column], theirs: dict[str, Column]) -> DataFrame:
    """Signals of two registries whose filters disagree on some event, with the number of such events."""
    keys = sorted(ours.keys() & theirs.keys())
    differ = [F.count_if(F.coalesce(ours[k], F.lit(False)) != F.coalesce(theirs[k], F.lit(False))).alias(k) for k in keys]
    counts = events.agg(*differ).select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*keys))).alias("signal", "n"))
    return _violations(counts.where("n > 0"), "filter_drift", F.col("signal"), F.col("n"))


def leaked_columns(df: DataFrame, private: Sequence[str], spark) -> DataFrame:
    rows = [("private_column", c, "present") for c in df.columns if c in private]
    return spark.createDataFrame(rows, "check string, entity string, detail string")


def class_mismatch(baked: DataFrame, again: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose published class differs from a fresh classification."""
    j = baked.select(*keys, F.col("category").alias("a")).join(
        again.select(*keys, F.col("category").alias("b")), list(keys), "full_outer"
    )
    rows = j.where(~F.col("a").eqNullSafe(F.col("b")))
    return _violations(rows, "class_mismatch", F.concat_ws("/", *keys), F.concat_ws(" vs ", "a", "b"))


def class_invariants(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Structural rules every window's classification must keep."""
    bad = (
        (F.col("category").isNotNull() & ~F.col("category").isin(*CATEGORIES))
        | (F.col("now") < 0) | (F.col("pre_rate") < 0) | (F.col("now_rate") < 0)
    )
    return _violations(classified.where(bad), "class_invariant", F.concat_ws("/", *keys), F.col("category"))


def generated_windows(seed: int, count: int, first: str, last: str, base: dict, slices: Sequence[str], longest: int = 12) -> list[dict]:
    """Windows of 1 to `longest` months between two months, drawn from a seed, slices in turn; keys g0, g1, ..."""
    rnd = random.Random(seed)
    index = lambda d: int(d[:4]) * 12 + int(d[5:7]) - 1
    day = lambda i: f"{i // 12:04d}-{i % 12 + 1:02d}-01"
    out = []
    for k in range(count):
        lo = rnd.randint(index(first), index(last))
        hi = min(lo + rnd.randrange(longest), index(last))
        out.append({"key": f"g{k}", "lo": day(lo), "hi": day(hi), "slice": slices[k % len(slices)], **base})
    return out


def halves(windows: Sequence[dict]) -> list[tuple[dict, dict, dict]]:
    """(window, first half, second half) of the windows of two months or more."""
    index = lambda d: int(d[:4]) * 12 + int(d[5:7]) - 1
    day = lambda i: f"{i // 12:04d}-{i % 12 + 1:02d}-01"
    out = []
    for w in windows:
        lo, hi = index(w["lo"]), index(w["hi"])
        if lo < hi:
            cut = (lo + hi) // 2
            out.append((w, {**w, "key": w["key"] + "a", "hi": day(cut)}, {**w, "key": w["key"] + "b", "lo": day(cut + 1)}))
    return out


def class_rules(classified: DataFrame, hot: float, floor: int, band: float, whole: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """What every class must satisfy by the numbers beside it, whatever the window: one row a broken rule.

    `whole` names the windows over all hours, whose day and night counts make up the total.
    """
    category, pre, now, expected = (F.col(c) for c in ("category", "pre_rate", "now_rate", "expected_rate"))
    volume = F.col("pre") + F.col("now")
    before, today = pre >= hot, now >= hot
    rose, fell = now > expected * (1 + band), now < expected * (1 - band)
    rules = {
        "class_domain": category.isNotNull() & ~category.isin(*CATEGORIES),
        "class_negative": (F.col("pre") < 0) | (F.col("now") < 0) | (pre < 0) | (now < 0) | (expected < 0),
        "class_floor": category.isNotNull() & (volume < floor),
        "class_cold": category.isNotNull() & ~before & ~today,
        "class_emerged": (category == "emerged") & ~(today & ~before & rose),
        "class_cooled": (category == "cooled") & ~(before & fell),
        "class_persistent": (category == "persistent") & (~before | ~today | fell),
        "class_silent": category.isNull() & (volume >= floor) & ((before & (fell | today)) | (today & ~before & rose)),
        "class_split": F.col("window").isin(*whole) & (F.col("now_day") + F.col("now_night") != F.col("now")),
    }
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda r: r.isNotNull())
    found = classified.withColumn("_rule", F.explode(broken))
    return found.select(F.col("_rule").alias("check"), F.concat_ws("/", *keys).alias("entity"), category.alias("detail"))


def floor_order(low: DataFrame, high: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells classified at a higher floor that have not the same class at a lower one."""
    kept = high.where("category IS NOT NULL").select(*keys, F.col("category").alias("a"))
    j = kept.join(low.select(*keys, F.col("category").alias("b")), list(keys), "left")
    return _violations(j.where(~F.col("a").eqNullSafe(F.col("b"))), "floor_order", F.concat_ws("/", *keys), F.concat_ws(" vs ", "a", "b"))


def window_sums(classified: DataFrame, parts: Sequence[tuple[dict, dict, dict]], keys: Sequence[str]) -> DataFrame:
    """Cells whose count in a window is not the sum of its halves."""
    signs = [(w["key"], whole["key"], sign) for whole, a, b in parts for w, sign in ((whole, 1), (a, -1), (b, -1))]
    marks = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(whole).alias("whole"), F.lit(sign).alias("sign")) for w, whole, sign in signs])
    place = [k for k in keys if k != "window"]
    own = classified.select(*place, "now", F.explode(F.filter(marks, lambda m: m["w"] == F.col("window"))).alias("m"))
    off = own.groupBy(*place, F.col("m.whole").alias("window")).agg(F.sum(F.col("m.sign") * F.col("now")).alias("off")).where("off <> 0")
    return _violations(off, "window_sum", F.concat_ws("/", *keys), F.col("off"))


def cliff_flag(pct: Column, band: float = fixed.CLIFF_BAND) -> Column:
    return F.coalesce(F.abs(pct) > band, F.lit(False))

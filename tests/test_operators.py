import datetime as dt
import math
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from placetime.functions import fixed
from placetime.operators import (
    concentration as co, evaluate as ev, feed as fe, hotspots as ho, places as pl, quality as qu,
    records as re, rollup as ru, sampling as sa, series as se, settling as st, spatial as sp,
)

M = 1.1132


def metres(a, b):
    dy = (a[0] - b[0]) * M
    dx = (a[1] - b[1]) * M * math.cos(math.radians(a[0] / 1e5))
    return math.hypot(dy, dx)


def scatter(n, lat, lng, spread, seed):
    r = random.Random(seed)
    return [(i, lat + r.randrange(spread), lng + r.randrange(spread)) for i in range(n)]


@pytest.mark.parametrize("lat, lng", [(3775000, -12245000), (0, 0), (6500000, 17990000 - 100000), (-4500000, 1000)])
@pytest.mark.parametrize("r", [25, 250, 900])
def test_near_pairs_equals_brute_force(spark, lat, lng, r):
    pts, tgt = scatter(120, lat, lng, 3000, 1), scatter(40, lat, lng, 3000, 2)
    p = spark.createDataFrame(pts, "id int, lat_e5 int, lng_e5 int")
    t = spark.createDataFrame(tgt, "tid int, t_lat int, t_lng int")
    got = set(rows(sp.near_pairs(p, t, r, r), "id", "tid"))
    want = {(a[0], b[0]) for a in pts for b in tgt if metres(a[1:], b[1:]) <= r}
    assert got == want
    assert set(rows(sp.near_pairs(p, t, r, r, measured=False), "id", "tid")) == want


def test_stop_and_ring_boundaries(spark):
    # one E5 step of latitude is 1.1132 m
    stops = spark.createDataFrame([(1, 3700000, 0), (2, 3700010, 0), (3, 3701000, 0)], "id int, lat_e5 int, lng_e5 int")
    ev_ = [(0, 3700000 - 21), (1, 3700000 - 23), (2, 3700000 - 224), (3, 3700000 - 225), (4, 3700004), (5, 3700005)]
    events = spark.createDataFrame([(i, la, 0, "s") for i, la in ev_], "id int, lat_e5 int, lng_e5 int, signal string")
    got = {r[0]: r[1:] for r in rows(sp.stop_and_ring_counts(events, stops, ["signal"]), "id", "stop", "ring")}
    # id 0: 23.4 m to stop 1, 34.5 m to stop 2 (ring); id 4 and 5 lie between both stops, within 25 m of each
    assert got[1] == (3, 2)          # events 0, 4 and 5 (tie: smaller id); ring: events 1 and 2
    assert got[2] == (0, 2)          # ring: events 0 and 1; event 2 is 260 m away
    assert 3 not in got


def test_ring_grows_with_radius(spark):
    p = spark.createDataFrame(scatter(300, 3770000, -12250000, 2000, 5), "id int, lat_e5 int, lng_e5 int").withColumn("s", F.lit("x"))
    t = spark.createDataFrame(scatter(20, 3770000, -12250000, 2000, 6), "id int, lat_e5 int, lng_e5 int")
    counts = [sp.stop_and_ring_counts(p, t, ["s"], 25, r).agg(F.sum("ring")).first()[0] or 0 for r in (100, 250, 500)]
    assert counts == sorted(counts) and counts[-1] > counts[0]


def test_hot_position_is_joined_once(spark):
    hot = spark.range(0, 20000).select((F.col("id") % 3 == 0).alias("h"), "id").select(
        "id", F.when(F.col("h"), 3770000).otherwise(3770000 + F.col("id") % 997).cast("int").alias("lat_e5"),
        F.when(F.col("h"), 0).otherwise(F.col("id") % 991).cast("int").alias("lng_e5"), F.lit("s").alias("signal"))
    t = spark.createDataFrame([(7, 3770000, 0)], "id int, lat_e5 int, lng_e5 int")
    r = sp.stop_and_ring_counts(hot, t, ["signal"]).first()
    near = hot.where("lat_e5 = 3770000 and lng_e5 = 0").count()
    assert r["stop"] >= near >= 6667
    assert sp.positions(hot, ["signal"]).where("n >= 6667").count() == 1


def test_knn_excludes_itself_and_breaks_ties_by_id(spark):
    s = spark.createDataFrame([(1, 0, 0), (2, 10, 0), (3, -10, 0), (4, 20, 0), (5, 0, 0), (6, 90000, 0)], "id int, lat_e5 int, lng_e5 int")
    got = rows(sp.knn(s, s, 3, 400).where("id = 1"), "rank", "nb_id")
    assert got == [(1, 5), (2, 2), (3, 3)]
    assert sp.knn(s, s, 3, 400).where("id = nb_id").count() == 0


def test_snap_prefers_names_then_distance(spark):
    stops = spark.createDataFrame([(1, "MAIN", "OAK", 0, 0), (2, "ELM", "", 0, 0), (3, "ELM", "FIR", 0, 5000)], "id int, on string, at string, lat_e5 int, lng_e5 int")
    corners = spark.createDataFrame([("OAK / PINE", 10, 0), ("MAIN / OAK", 130, 0), ("ELM / ASH", 95, 0)], "name string, lat_e5 int, lng_e5 int")
    got = {r[0]: r[1] for r in rows(sp.snap_to_corner(stops, corners), "id", "corner")}
    assert got == {1: "MAIN / OAK", 2: "OAK / PINE", 3: None}


def test_polygon_plan_is_one_broadcast_without_aggregation_of_points(spark):
    edges = [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0)]
    rings = spark.createDataFrame([("A", 1, 0, "outer", edges), ("B", 0, 0, "outer", edges)], "district string, feature_order int, part int, role string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    pts = spark.createDataFrame([(1, 50000, 50000), (2, None, None), (3, 200000, 0)], "id int, lat_e5 int, lng_e5 int")
    a = sp.assign_polygon(pts, rings)
    assert rows(a, "id", "district") == [(1, "B"), (2, "UNKNOWN"), (3, "UNKNOWN")]   # lower feature_order wins
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert sp.index_fits(rings) and not sp.index_fits(rings, size=1)


def test_within_circle_and_bbox(spark):
    p = spark.createDataFrame([(1, 3770000, -12240000), (2, 3770200, -12240000), (3, 3770300, -12240000)], "id int, lat_e5 int, lng_e5 int")
    assert [r[0] for r in rows(sp.within_circle(p, 3770000, -12240000, 250), "id")] == [1, 2]
    assert [r[0] for r in rows(sp.bbox_filter(p, 3770000, -12240000, 3770200, -12240000), "id")] == [1, 2]


# -- series ---------------------------------------------------------------------------------------
def series(spark, values, label="A"):
    data = [("s", label, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "signal string, label string, idx int, n long").withColumn("period", F.add_months(F.lit("2023-01-01").cast("date"), F.col("idx")))


def at(df, idx, *cols):
    return tuple(df.where(F.col("idx") == idx).select(*cols).first())


def test_yoy_null_rules(spark):
    s = se.yoy(series(spark, [0, 4] + [1] * 10 + [5, 6]))
    assert at(s, 11, "prior", "pct") == (None, None)
    assert at(s, 12, "n", "prior", "pct") == (5, 0, None)          # zero base keeps both values
    assert at(s, 13, "prior", "pct") == (4, 0.5)


@pytest.mark.parametrize("length, filled", [(11, 0), (12, 1), (13, 2)])
def test_trailing12_needs_a_full_year(spark, length, filled):
    s = se.trailing12(series(spark, [2] * length))
    assert s.where("t12_sum is not null").count() == filled


def test_trend12_and_trailing_yoy_differ_on_a_zero_year(spark):
    s = series(spark, [0] * 12 + [3] * 12)
    assert at(se.trend12(s), 23, "trend_now", "trend_pct") == (None, None)
    assert at(se.trailing_yoy(s), 23, "t12", "t12_prior", "t12_pct") == (36, 0, None)
    assert at(se.trailing_yoy(s), 22, "t12_prior") == (None,)


def test_momentum(spark):
    s = se.momentum(series(spark, [1, 1, 1, 2, 2, 2, 0, 4]))
    assert at(s, 5, "mom_1", "mom_3", "mom_12") == (0.0, 1.0, None)
    assert at(s, 7, "mom_1") == (None,)                             # the block before is zero
    assert at(s, 4, "mom_3") == (None,)


def test_verdict_bands(spark):
    df = spark.createDataFrame([(0.05, "down"), (0.0501, "down"), (-0.06, "down"), (0.06, "up"), (None, "up")], "p double, g string")
    assert [r[0] for r in df.select(se.verdict(F.col("p"), F.col("g"))).collect()] == ["Little change", "Worsening", "Improving", "Rising — good", "Not enough history"]
    label, tone = se.trend_verdict(F.col("p"))
    assert [r[0] for r in df.select(label).collect()] == ["Worsening", "Worsening", "Improving", "Worsening", "Little change"]
    assert [r[0] for r in df.select(se.goal_tone(F.lit(0.004), F.col("g"))).collect()] == ["flat"] * 5
    assert spark.range(1).select(se.badge(F.lit(0), F.lit("down"))).first()[0] == "bad"


def test_share_and_window(spark):
    s = series(spark, [1, 2, 3]).unionByName(series(spark, [4, 0, 6], "Citywide"))
    sh = se.share(s)
    assert at(sh, 0, "share") == (0.25,) and at(sh, 1, "share") == (None,)
    assert at(sh, 2, "share_to_date", "share_all_time") == (0.6, 0.6)
    w = se.window_sums(series(spark, list(range(1, 25))), [{"preset": "a", "lo": 12, "hi": 13}, {"preset": "b", "lo": 3, "hi": 4}])
    assert rows(w, "preset", "cur", "prior") == [("a", 27, 3), ("b", 9, None)]


def test_windows_add_up(spark):
    s = series(spark, [random.Random(3).randrange(9) for _ in range(40)])
    parts = [{"preset": str(i), "lo": i * 10, "hi": i * 10 + 9} for i in range(4)]
    total = se.window_sums(s, parts).agg(F.sum("cur")).first()[0]
    assert total == s.agg(F.sum("n")).first()[0]


def test_dense_rollup_counts_outsiders_citywide_only(spark):
    e = spark.createDataFrame([("s", "A", "2024-01-31", 3), ("s", "UNKNOWN", "2024-01-01", None), ("s", "A", "2024-03-01", 12)], "signal string, district string, d string, hour int").withColumn("day", F.col("d").cast("date"))
    m = ru.dense_monthly(e, ["s"], ["A", "B"], "2024-01-01", "2024-03-09")
    assert rows(m.where("label = 'Citywide'"), "idx", "n") == [(0, 2), (1, 0), (2, 1)]
    assert rows(m.where("label = 'B'"), "n") == [(0,), (0,), (0,)]
    assert qu.citywide_below_sum(m).count() == 0 and qu.sparse_series(m, 3).count() == 0
    assert ru.dense_monthly(e.where("false"), ["s"], ["A"], "2024-01-01", "2024-02-01").agg(F.sum("n")).first()[0] == 0


def test_weeks_across_a_53_week_year(spark):
    w = ru.date_axis(spark, "2020-12-20", "2021-01-15", "week")
    assert [str(r[0]) for r in rows(w, "period")] == ["2020-12-14", "2020-12-21", "2020-12-28", "2021-01-04", "2021-01-11"]
    assert qu.axis_gaps(w, "week").count() == 0


def test_distinct_total_is_the_sum_of_groups(spark):
    e = spark.createDataFrame([("s", "A", 1, 5), ("s", "A", 1, 7), ("s", "A", 1, 8)], "signal string, district string, id int, hour int").withColumn("day", F.lit("2024-01-01").cast("date"))
    c = ru.distinct_cube(e, "id", F.col("day"))
    assert c.agg(F.sum("n")).first()[0] == 2          # one id, in two buckets


def test_settled_week(spark):
    r = spark.range(1).select(ru.settled_week(F.lit("2026-05-01").cast("date"))).first()[0]
    assert str(r) == "2026-05-25"                       # 25-31 May ends before 1 June


def test_low_base_and_chips(spark):
    m = series(spark, [10] * 12 + [15])
    w = spark.createDataFrame([("s", "A", i, 3) for i in range(60)], "signal string, label string, idx int, n long").withColumn("period", F.date_add(F.lit("2023-01-02").cast("date"), F.col("idx") * 7))
    c = se.kpi_chips(m, w, F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date")).first()
    assert (c["change_1mo"], c["prior2"], c["change_2wk"], c["low_base"]) == (50, 6, 0, True)


# -- settling ---------------------------------------------------------------------------------------
def test_lag_stats_edges(spark):
    d = [("2024-01-01", f"2024-01-{i:02d}") for i in range(2, 12)] + [("2024-01-05", "2024-01-01")]
    df = spark.createDataFrame(d, "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    r = st.lag_stats(st.lags(df, "a", "b"), []).first()
    assert (r["n"], r["p50_days"], r["p90_days"], r["within_7_pct"]) == (10, 6, 10, 70)
    empty = st.lag_stats(st.lags(df.where("false"), "a", "b"), []).collect()
    assert all(r["n"] is None for r in empty)


def test_cdf_is_dense_and_completeness_averages_it(spark):
    df = spark.createDataFrame([("g", 0), ("g", 2), ("g", 2), ("g", 500)], "g string, lag int")
    g = st.lag_cdf(df, ["g"])
    f = {r["k"]: r["f"] for r in g.collect()}
    assert len(f) == 121 and f[0] == 0.25 and f[1] == 0.25 and f[2] == 0.75 and f[120] == 0.75
    late = st.lag_cdf(df.where("lag > 120"), ["g"])
    assert rows(late.groupBy("f").count()) == [(0.0, 121)]
    ages = spark.createDataFrame([("g", 0, 4)], "g string, delta int, month_days int")
    assert st.month_completeness(g, ages, ["g"]).first()["completeness"] == pytest.approx((0.25 + 0.25 + 0.75 + 0.75) / 4)


def test_young_cohorts_are_left_out(spark):
    d = spark.createDataFrame([("2024-01-15", "2024-02-20"), ("2024-01-20", "2024-01-31"), ("2024-06-15", "2024-06-20")], "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), F.lit("x").alias("g"))
    c = st.cohort_completion(st.cohorts(d, "a", "b", "2024-09-01", ["g"]), ["g"], (0, 1))
    assert rows(c, "h", "filed", "final") == [(0, 1, 2), (1, 2, 2)]
    s = st.cohort_summary(c, ["g"])
    assert rows(s, "h", "mean", "sd", "uplift") == [(0, 0.5, 0.0, 2.0), (1, 1.0, 0.0, 1.0)]


# -- hotspots ----------------------------------------------------------------------------------------
def cells(spark, spec):
    """spec: {cell: (count before, count now)}; one district, 24 months before and 3 now."""
    data = []
    for cy, (pre, now) in spec.items():
        data += [("s", cy, "2023-06-15", i) for i in range(pre)] + [("s", cy, "2025-02-15", i) for i in range(now)]
    df = spark.createDataFrame(data, "signal string, c int, d string, id int")
    return df.select("signal", F.col("id"), F.col("d").cast("date").alias("day"), F.col("d").cast("timestamp_ntz").alias("ts"), F.lit(9).alias("hour"), F.lit("A").alias("district"), (F.col("c") * 100).alias("lat_e5"), F.lit(0).alias("lng_e5"))


WIN = [{"key": "w", "lo": "2025-01-01", "hi": "2025-03-01", "base_lo": "2023-01-01", "base_hi": "2024-12-01"}]


def test_cell_classes(spark):
    e = cells(spark, {1: (48, 7), 2: (48, 1), 3: (3, 9), 4: (40, 6), 5: (1, 4), 6: (5, 0)})
    got = {r["cy"]: r for r in ho.classify_cells(ho.cell_cube(ho.located(e, ["A"])), WIN, hot=2.0).collect()}
    assert {k: got[k]["category"] for k in got} == {1: "persistent", 2: "cooled", 3: "emerged", 4: None}
    assert 5 not in got and 6 not in got               # under the all-time floor
    assert got[1]["tide"] == pytest.approx((27 / 3) / (145 / 24)) and got[1]["night_pct"] == 0.0


def test_newly_hot_but_tracking_its_district_is_not_emerged(spark):
    e = cells(spark, {1: (40, 6), 2: (20, 12)})
    got = {r["cy"]: r["category"] for r in ho.classify_cells(ho.cell_cube(ho.located(e, ["A"])), WIN, hot=1.9, band=3.0).collect()}
    assert got == {1: None, 2: None}


def test_no_baseline_means_tide_one_and_no_volume_means_no_night_share(spark):
    e = cells(spark, {1: (0, 9), 2: (9, 0)})
    only_now = ho.classify_cells(ho.cell_cube(ho.located(e.where("day > '2025-01-01'"), ["A"])), WIN, hot=2.0).first()
    assert only_now["tide"] == 1.0 and only_now["category"] == "emerged"
    r = {x["cy"]: x["night_pct"] for x in ho.classify_cells(ho.cell_cube(ho.located(e, ["A"])), WIN, hot=2.0).collect()}
    assert r[2] is None and r[1] == 0.0


def test_fuzzed_windows_keep_invariants(spark):
    rnd = random.Random(11)
    e = cells(spark, {c: (rnd.randrange(60), rnd.randrange(12)) for c in range(1, 15)})
    cube = ho.cell_cube(ho.located(e, ["A"]))
    wins = []
    for i in range(20):
        lo = dt.date(2025, 1 + i % 3, 1)
        wins.append({"key": f"w{i}", "lo": str(lo), "hi": str(dt.date(2025, lo.month + i % 4, 1)), "base_lo": "2023-01-01", "base_hi": "2024-12-01", "slice": ["all", "day", "night", "morning+evening"][i % 4]})
    many = ho.classify_cells(cube, wins, hot=1.0)
    assert qu.class_invariants(many, ["cy", "window"]).count() == 0
    again = ho.classify_cells(cube.repartition(7), wins[:1], hot=1.0)
    assert qu.class_mismatch(many.where("window = 'w0'"), again, ["cy"]).count() == 0


def test_generated_windows_and_class_rules(spark):
    base = {"base_lo": "2023-01-01", "base_hi": "2024-12-01"}
    wins = qu.generated_windows(5, 30, "2025-01-01", "2026-02-01", base, ["all", "night"], longest=5)
    assert wins == qu.generated_windows(5, 30, "2025-01-01", "2026-02-01", base, ["all", "night"], longest=5) != qu.generated_windows(6, 30, "2025-01-01", "2026-02-01", base, ["all", "night"], longest=5)
    assert all("2025-01-01" <= w["lo"] <= w["hi"] <= "2026-02-01" for w in wins) and len({(w["lo"], w["hi"]) for w in wins}) > 10
    parts = qu.halves(wins)
    assert parts and all(a["lo"] == w["lo"] and a["hi"] < b["lo"] and b["hi"] == w["hi"] for w, a, b in parts)
    rnd = random.Random(3)
    cube = ho.cell_cube(ho.located(cells(spark, {c: (rnd.randrange(60), rnd.randrange(12)) for c in range(1, 15)}), ["A"]))
    every, keys = wins + [w for _, *two in parts for w in two], ["cy", "window"]
    whole = [w["key"] for w in every if w["slice"] == "all"]
    low, high = ho.classify_cells(cube, every, 1.0, 6), ho.classify_cells(cube, every, 1.0, 50)
    low.persist()
    assert qu.class_rules(low, 1.0, 6, 0.35, whole, keys).count() == 0
    assert qu.window_sums(low, parts, keys).count() == 0 and qu.floor_order(low, high, keys).count() == 0
    assert high.where("category IS NOT NULL").count() < low.where("category IS NOT NULL").count()
    swapped = low.withColumn("category", F.when(F.col("category") == "cooled", "persistent").when(F.col("category") == "persistent", "cooled"))
    broken = {r.check for r in qu.class_rules(swapped, 1.0, 6, 0.35, whole, keys).collect()}
    assert {"class_persistent", "class_silent"} <= broken | ({"class_persistent"} if not low.where("category = 'cooled'").count() else set())
    assert qu.window_sums(low.withColumn("now", F.col("now") + 1), parts, keys).count() > 0
    assert qu.floor_order(high, low, keys).count() > 0
    low.unpersist()


def test_dominant_name_tie_goes_to_first_seen(spark):
    d = [("s", 1, "B ST, X", "2024-01-02"), ("s", 1, "A ST", "2024-01-03"), ("s", 1, None, "2024-01-01")]
    p = spark.createDataFrame(d, "signal string, cy int, name string, t string").withColumn("cx", F.lit(0)).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert rows(ho.dominant_name(p), "name") == [("B ST",)]


def test_breakdown_drops_unknown_hours_only_when_filtered(spark):
    p = spark.createDataFrame([("s", 1, 0, None, "x"), ("s", 1, 0, 7, "y")], "signal string, cy int, cx int, hour int, kind string")
    assert ho.cell_breakdown(p, "kind").count() == 2
    assert rows(ho.cell_breakdown(p, "kind", buckets=["morning", "night"]), "kind", "pct") == [("y", 100)]


# -- evaluation ----------------------------------------------------------------------------------------
def daily(spark, data, lever="x"):
    return spark.createDataFrame([(1, lever, d, n) for d, n in data], "intervention int, lever string, d string, n long").withColumn("day", F.col("d").cast("date")).drop("d")


def window(spark, date, start, end, lever="x"):
    return spark.createDataFrame([(1, lever, date, start, end)], "intervention int, lever string, date string, start string, end string").select("intervention", "lever", *[F.col(c).cast("date").alias(c) for c in ("date", "start", "end")])


def test_before_after_rates_and_infinity(spark):
    w = window(spark, "2024-02-01", "2024-01-02", "2024-02-10")
    r = ev.before_after(daily(spark, [("2024-01-10", 6), ("2024-02-01", 1), ("2024-03-01", 9)]), w).first()
    assert (r["pre"], r["post"], r["pre_days"], r["post_days"], r["short_window"], r["in_window"]) == (6, 1, 30, 10, True, True)
    assert r["pre_rate"] == 6.0 and r["post_rate"] == 3.0 and r["pct"] == -50.0 and r["direction"] == "down"
    assert ev.before_after(daily(spark, [("2024-02-03", 1)]), w).first()["pct"] == float("inf")
    quiet = ev.before_after(daily(spark, [("2023-02-03", 1)]), w).first()
    assert quiet["pct"] == 0.0 and quiet["direction"] == "flat"
    out = ev.before_after(daily(spark, [("2024-01-10", 2)]), window(spark, "2024-05-01", "2024-01-02", "2024-02-10")).first()
    assert not out["in_window"] and out["post_days"] == 0 and out["post_rate"] == 0.0


def onset(spark, months, date="2024-12-15"):
    data = [(f"{y}-{m:02d}-10", n) for (y, m), n in months.items() if n]
    pins = spark.createDataFrame([(1, date)], "intervention int, d string").select("intervention", F.col("d").cast("date").alias("date"))
    return ev.detect_onset(daily(spark, data).groupBy("intervention", "day").agg(F.sum("n").alias("n")), pins, "2024-01-01").first()


def test_onset_finds_the_latest_rise(spark):
    r = onset(spark, {(2024, m): 1 for m in range(1, 9)} | {(2024, m): 12 for m in range(9, 13)})
    assert (r["method"], r["onset_month"], str(r["start"])) == ("regime", "2024-09", "2024-09-01")


def test_onset_falls_back(spark):
    flat = onset(spark, {(2024, m): 3 for m in range(1, 13)})
    assert flat["method"] == "fallback" and str(flat["start"]) == "2024-09-16"
    assert onset(spark, {(2024, 11): 5, (2024, 12): 5})["method"] == "fallback"      # under 12 events
    assert str(onset(spark, {(2024, 2): 50}, "2024-03-05")["start"]) == "2024-01-01"   # clamped to history


def test_bars_are_zero_filled(spark):
    b = ev.bucket_series(daily(spark, [("2024-01-03", 2)]), window(spark, "2024-01-05", "2024-01-02", "2024-01-06"))
    assert [(str(r[0]), r[1]) for r in rows(b, "bucket", "n")] == [("2024-01-02", 0), ("2024-01-03", 2), ("2024-01-04", 0), ("2024-01-05", 0), ("2024-01-06", 0)]


def test_radius_join_per_intervention(spark):
    pins = spark.createDataFrame([(1, ["x"], 0, 0, 100.0), (2, ["x", "y"], 0, 0, 500.0)], "id int, levers array<string>, lat_e5 int, lng_e5 int, radius double")
    e = spark.createDataFrame([("x", 80, 0), ("x", 100, 0), ("y", 400, 0), ("y", 500, 0), ("z", 0, 0)], "lever string, lat_e5 int, lng_e5 int").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = rows(ev.event_radius_join(pins, e, 500), "intervention", "lever", "n")
    assert got == [(1, "x", 1), (2, "x", 2), (2, "y", 1)]


def test_cap_report(spark):
    e = spark.range(0, 10).select(F.lit("k").alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    r = ev.cap_report(e, ["k"], 4).first()
    assert (r["rows"], r["truncated"], str(r["earliest"])) == (10, True, "2024-01-07")


def test_breaks_only_inside_the_window(spark):
    b = [("x", "2024-02-01", "change")]
    assert ev.breaks_crossed(window(spark, "2024-02-01", "2024-01-01", "2024-03-01"), b).count() == 1
    assert ev.breaks_crossed(window(spark, "2024-02-01", "2024-02-01", "2024-03-01"), b).count() == 0


# -- concentration, feed, places, records ---------------------------------------------------------------
def test_curve_stops_at_the_number_of_targets(spark):
    t = spark.createDataFrame([("s", i, 10 - i, 1) for i in range(10)], "signal string, id int, t12 long, all_time long")
    assert rows(co.concentration_curve(t, ["signal"]), "top", "share") == [(5, 40 / 55), (10, 1.0)]


def test_scale_and_dominant_signal(spark):
    t = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("a", 2, 4), ("b", 2, 4), ("a", 3, 1), ("b", 3, 0)], "signal string, id int, t12 long")
    sc = co.signal_scale(t)
    assert rows(sc) == [("a", 4), ("b", 4)]
    r = {(x["id"], x["signal"]): x for x in co.relative_intensity(t, sc).collect()}
    assert r[(1, "a")]["quiet"] and r[(1, "a")]["dominant"] is None
    assert r[(2, "b")]["dominant"] == "a" and r[(3, "a")]["shown"] and not r[(3, "b")]["shown"]


def test_mask_counts_the_union(spark):
    m = spark.createDataFrame([("s", "a", "2023-01-01"), ("s", "b", "2023-01-01"), ("s", "b", "2023-03-01"), ("s", "a", "2024-12-01")], "id string, signal string, p string").select("id", "signal", F.col("p").cast("date").alias("period"), F.lit(1).cast("long").alias("n"))
    masks = co.month_mask(m, "2023-01-01", "2024-12-20")
    union = masks.groupBy("id").agg(F.bit_count(F.bit_or("mask")).alias("n")).first()["n"]
    assert union == 2 == co.active_months_union(m, ["a", "b"], "2024-12-20").first()["active_months"]


def test_overlay_detail_is_private_by_default(spark):
    raw = spark.createDataFrame([("14567", "Main", "", "55", "Missed servicing", "Yes"), ("", "x", "", "", "", "")], "`Stop ID` string, Location string, Boardings string, `Lift deployments: Aver/day` string, `Basis / Notes` string, `Request for removals` string")
    assert co.overlay_list(raw).columns == ["code", "id", "list_location", "boardings"]
    r = co.overlay_list(raw, detail=True).first()
    assert (r["id"], r["boardings"], r["basis_types"], r["removal_requested"], r["needs_verification"]) == ("4567", "55", ["contractor"], True, False)


def test_nearest_alternative_takes_the_closer_side(spark):
    mk = lambda data, cols: spark.createDataFrame(data, cols)
    feed = {
        "stops": mk([("a", "1", "A", "37.0", "0.0", ""), ("b", "2", "B", "37.001", "0.0", ""), ("c", "", "C", "37.0015", "0.0", "")], "stop_id string, stop_code string, stop_name string, stop_lat string, stop_lon string, wheelchair_boarding string"),
        "routes": mk([("r1", "", "Long")], "route_id string, route_short_name string, route_long_name string"),
        "trips": mk([("t1", "r1", "0", "s"), ("t2", "r1", "0", "s"), ("t3", "r1", "0", "s")], "trip_id string, route_id string, direction_id string, shape_id string"),
        "stop_times": mk([("t1", "1", "a"), ("t1", "2", "b"), ("t2", "9", "b"), ("t2", "10", "c"), ("t2", "2", "a"), ("t3", "1", "a"), ("t3", "2", "c"), ("t3", "3", "b")], "trip_id string, stop_sequence string, stop_id string"),
    }
    assert rows(fe.representative_trips(feed["stop_times"], feed["trips"]), "trip_id") == [("t2",)]
    pat = fe.stop_patterns(feed)
    alts = fe.nearest_alternative(pat, fe.feed_stops(feed))
    assert rows(alts, "stop_id", "alt_id", "m") == [("a", "b", 111), ("b", "c", 56), ("c", "b", 56)]
    stops = mk([("a",), ("z",)], "id string")
    assert rows(fe.enrich_stops(stops, fe.stop_summary(pat, alts), feed["stops"]), "id", "code", "in_feed") == [("a", "1", True), ("z", "1z", False)]


def test_resolver_tiers(spark):
    local = pl.local_index(spark.createDataFrame([(1, "16TH ST / MISSION ST", 3770000, -12240000), (2, "16th & Mission", 3770001, -12240000), (3, "MAIN ST", 0, 0)], "pos int, name string, lat_e5 int, lng_e5 int"), "pos")
    assert rows(local, "key", "count") == [("16 mission", 2)]
    city = pl.local_index(spark.createDataFrame([(1, "OAK ST / ELM AVE", 3770040, -12240000), (2, "OAK ST / ELM AVE / PINE", 0, 0)], "pos int, name string, lat_e5 int, lng_e5 int"), "pos")
    q = spark.createDataFrame([("Mission and 16th St",), ("oak",), ("Elm & Oak",), ("no where",), ("pine elm",)], "q string")
    got = {r["q"]: (r["status"], r["name"], r["near_name"]) for r in pl.resolve_corners(q, "q", local, city).collect()}
    assert got["Mission and 16th St"][0] == "local" and got["oak"][0] == "need-two" and got["no where"][0] == "none"
    assert got["Elm & Oak"] == ("city", "OAK ST / ELM AVE", "16TH ST / MISSION ST")
    assert got["pine elm"][:2] == ("city", "OAK ST / ELM AVE / PINE")


def test_corner_index_folds_permutations(spark):
    p = spark.createDataFrame([(1, "06TH ST", "MISSION ST", "37.1", "-122"), (2, "MISSION ST", "6TH ST", "37.2", "-122"), (3, "A ST", "A AVE", "1", "1"), (4, "B", " ", "1", "1"), (5, "C", "D", "x", "1")], "pos int, street_1 string, street_2 string, lat string, lng string")
    assert rows(pl.corner_index(p, "pos"), "pair_key", "pos", "lat_e5") == [("6 x mission", 1, 3710000)]


def test_stop_search(spark):
    s = spark.createDataFrame([("4567", "14567", "Market St & 5th St", "", "", True, False), ("4568", "14568", "Mission & 5th", "", "", False, True), ("45", "1045", "Oak", None, None, False, False)], "id string, code string, name string, on string, at string, shelter boolean, listed boolean")
    got = {}
    q = spark.createDataFrame([("14567",), ("4568",), ("5th m",), ("mar 5",), ("the",), ("zzz",)], "q string")
    for r in pl.search_stops(q, s).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    assert sorted(got["5th m"]) == [(1, "4568"), (2, "4567")]         # the listed stop ranks first
    assert got["14567"] == [(1, "4567")] and got["4568"] == [(1, "4568")] and got["mar 5"] == [(1, "4567")]
    assert "zzz" not in got and "the" in got


def test_ids_continue_after_the_highest(spark):
    new = spark.createDataFrame([(1, "Central", "2024-01-02"), (2, "Central", "2024-01-01"), (3, "Nowhere", "2024-01-01")], "id int, district string, created string")
    issued = spark.createDataFrame([("CEN007",), ("CEN998",), ("NOR001",), ("CEN-1a2b",)], "intervention_id string")
    assert rows(re.next_ids(new, issued, fixed.ID_PREFIXES, ["created", "id"]), "id", "intervention_id") == [(1, "CEN1000"), (2, "CEN999"), (3, "OTH001")]


def test_change_log(spark):
    rec = spark.createDataFrame([(1, "open_in_progress", "a", None, "2024-01-01"), (2, "open_in_progress", "b", None, "2024-01-01"), (3, "open_in_progress", "c", "2023-12-31", "2024-01-01")], "id int, status string, notes string, end_date string, last_edited string")
    ch = spark.createDataFrame([(1, "2024-02-01", "close", None, None), (1, "2024-02-03", "patch", None, "z"), (2, "2024-02-01", "delete", None, None), (3, "2024-02-01", "close", None, None), (3, "2024-02-02", "reopen", None, None)], "id int, at string, op string, status string, notes string")
    assert rows(re.apply_changes(rec, ch, ["status", "notes"]), "id", "status", "notes", "end_date", "last_edited") == [
        (1, "closed_completed", "z", "2024-02-01", "2024-02-03"), (3, "open_in_progress", "c", None, "2024-02-02")]


def test_validation_collects_every_error(spark):
    bad = spark.createDataFrame([("", None, "nope", "Mars", "x", ["a", " "], ["http://ok"])], "intervention string, person_submitted string, email string, district string, status string, levers array<string>, links array<string>")
    r = re.validate_records(bad).first()
    assert r["errors"] == ["title required", "name required", "email not valid", "district required", "status not valid"] and r["levers"] == ["a"]


def test_systematic_sample(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("x"))
    got = [r[0] for r in rows(sa.systematic_sample(df, 100, [F.col("x")]))]
    assert got == [int(i * 1003 / 100) for i in range(100)]
    assert sa.systematic_sample(df, 2000, [F.col("x")]).count() == 1003


def test_snapshot_states(spark):
    o = spark.createDataFrame([("a", 10), ("b", 0), ("c", 5), ("e", 7)], "k string, n long")
    n = spark.createDataFrame([("a", 15), ("b", 2), ("d", 1), ("e", 7)], "k string, n long")
    got = {r["k"]: (r["state"], r["cliff"]) for r in qu.snapshot_diff(o, n, ["k"]).collect()}
    assert got == {"a": ("changed", True), "b": ("new activity", True), "c": ("gone", False), "d": ("new", False), "e": ("same", False)}


def star(rnd, x, y, r, n):
    pts = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, r * (0.4 + 0.6 * rnd.random())
        pts.append((x + d * math.cos(a), y + d * math.sin(a)))
    return pts


def inside(pts, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(pts, pts[-1:] + pts[:-1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("size", [200, 1000, 20000])
def test_polygons_equal_brute_force(spark, size):
    rnd = random.Random(size)
    feats = []
    for i in range(8):
        cx, cy = -122.4 + rnd.random() * 0.1, 37.7 + rnd.random() * 0.1
        feats.append((f"D{i}", [star(rnd, cx, cy, 0.03, 9), star(rnd, cx, cy, 0.008, 5)]))
    edges = lambda pts: [(a[0], a[1], b[0], b[1]) for a, b in zip(pts, pts[-1:] + pts[:-1])]
    data = [(d, i, 0, role, edges(p)) for i, (d, ps) in enumerate(feats) for role, p in zip(("outer", "hole"), ps)]
    rings = spark.createDataFrame(data, "district string, feature_order int, part int, role string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    pts = [(i, 3766000 + rnd.randrange(18000), -12244000 + rnd.randrange(18000)) for i in range(1500)]
    df = spark.createDataFrame(pts, "id int, lat_e5 int, lng_e5 int")
    for holes in (False, True):
        want = {}
        for i, la, lo in pts:
            x, y = lo / 1e5, la / 1e5
            want[i] = next((d for d, (o, h) in feats if inside(o, x, y) and not (holes and inside(h, x, y))), "UNKNOWN")
        got = {r["id"]: r["district"] for r in sp.assign_polygon(df, rings, holes=holes, size=size).collect()}
        assert got == want


def test_polygons_beyond_the_broadcast_bound_are_joined_plainly(spark, monkeypatch):
    square = [(0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 0.0), (0.0, 1.0, 1.0, 1.0)]
    rings = spark.createDataFrame([("A", 0, 0, "outer", square)], "district string, feature_order int, part int, role string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    pts = spark.range(0, 600).select("id", F.when(F.col("id") % 3 == 0, 50000).otherwise(F.col("id") * 500).cast("int").alias("lat_e5"), F.when(F.col("id") % 7 != 0, 50000).alias("lng_e5"))
    want = rows(sp.assign_polygon(pts, rings, size=20000), "id", "district")
    monkeypatch.setattr(sp, "POLYGON_INDEX_ROWS", 0)
    joined = sp.assign_polygon(pts, rings, size=20000)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()
    assert rows(joined, "id", "district") == want and ("A" in {d for _, d in want}) and ("UNKNOWN" in {d for _, d in want})


RING = "district string, feature_order int, part int, role string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def test_polygon_index_grows_with_edges_not_with_columns(spark):
    """A saw 40 columns wide with 400 teeth: entries of the index are those of met cells, not edges times columns."""
    teeth = [(k / 100, 0.5 + 0.3 * (k % 2)) for k in range(401)]
    ring = [*teeth, (4.0, 0.05), (0.0, 0.05)]
    edges = [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    rings = spark.createDataFrame([("A", 0, 0, "outer", edges)], RING)
    index = sp.polygon_index(rings, size=10000).select(F.explode("parts").alias("p")).select(
        F.coalesce(F.size("p.outer.edges"), F.lit(0)).alias("edges"), F.coalesce(F.size(F.filter("p.outer.ys", lambda y: y < 9)), F.lit(0)).alias("ends")
    ).persist()
    edge_cells = 400 * 4 * 3 + 2 * 10 + 45
    assert index.agg(F.sum("edges")).first()[0] < edge_cells < 400 * 4 * 40 / 2
    assert index.agg(F.sum("ends")).first()[0] < 2 * 400 and index.count() <= 41 * 10
    rnd = random.Random(2)
    pts = [(i, rnd.randrange(-1000, 90000), rnd.randrange(-1000, 401000)) for i in range(3000)]
    pts += [(3000 + i, round(y * 1e5), round(x * 1e5)) for i, (x, y) in enumerate(teeth)]      # ends themselves

    def inside(y, x):
        y, x = y / 1e5, x / 1e5
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1 + fixed.EDGE_EPSILON) + x1 for x1, y1, x2, y2 in edges) % 2 == 1

    df = spark.createDataFrame(pts, "id int, lat_e5 int, lng_e5 int")
    for size in (10000, 3300, 250000):
        got = {r.id for r in sp.assign_polygon(df, rings, size=size).where("district = 'A'").collect()}
        assert got == {i for i, lat, lng in pts if inside(lat, lng)}


def test_written_tables_may_be_empty(spark):
    from placetime.functions.ranks import global_rank, materialize

    empty = spark.range(0).select("id", F.lit("x").alias("k")).where("id > 5")
    assert materialize(empty, "t").count() == 0
    assert global_rank(empty, [F.col("id")]).count() == 0
    assert ho.classify_cells(materialize(ho.cell_cube(ho.located(cells(spark, {1: (1, 1)}), ["Z"])), "c"), WIN, 2.0).count() == 0

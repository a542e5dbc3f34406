"""Rules that must hold at any size: no cap, no switch, no order left to chance."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from placetime.functions.joins import is_small, lookup_join
from placetime.operators import concentration as co
from placetime.operators import evaluate as ev
from placetime.operators import places as pl
from placetime.operators import rollup as ru
from placetime.operators import sampling as sa
from placetime.operators import spatial as sp
from placetime.plans import registry_queries as rq
from placetime.plans import tables as t
from placetime.sources import events as se
from placetime.sources import registry as rg


@pytest.mark.parametrize("limit", [2, 1000])
def test_lookup_join_takes_maps_on_both_sides_of_the_bound(spark, limit):
    big = spark.createDataFrame([(k % 7, {"a": str(k)}) for k in range(50)], "k int, detail map<string,string>")
    small = spark.createDataFrame([(k, {"n": k}) for k in range(5)], "k int, more map<string,int>")
    got = lookup_join(big, small, ["k"], rows=limit)
    assert got.count() == 50 and got.where("more is null").count() == sum(k % 7 > 4 for k in range(50))


def test_size_bound_is_in_bytes_too(spark):
    df = spark.createDataFrame([("x" * 5000,)] * 4, "s string")
    assert is_small(df) and not is_small(df, size=10_000) and not is_small(df, rows=3)


def test_month_masks_keep_every_month(spark):
    months = spark.range(150).select(F.lit(1).alias("id"), F.lit("a").alias("signal"), F.expr("add_months(date'2010-01-01', cast(id as int))").alias("period"), F.lit(1).alias("n"))
    for start in ("2010-01-01", "2015-06-01"):
        masks = co.month_mask(months, start, "2030-01-01")
        assert rows(co.masked_months(masks), "id", "signal", "months") == [(1, "a", 150)]
        assert masks.count() >= 3


def test_onset_keeps_interventions_before_the_history(spark):
    pins = spark.createDataFrame([(1, "2022-06-01"), (2, "2024-06-01")], "intervention int, d string").select("intervention", F.col("d").cast("date").alias("date"))
    daily = spark.createDataFrame([(2, "2024-01-05", 3)], "intervention int, d string, n long").select("intervention", F.col("d").cast("date").alias("day"), "n")
    got = rows(ev.detect_onset(daily, pins, "2023-01-01"), "intervention", "method", "start")
    assert [(r[0], r[1], str(r[2])) for r in got] == [(1, "fallback", "2023-01-01"), (2, "fallback", "2024-03-03")]


def test_sample_takes_the_stated_positions(spark):
    n = 1000
    df = spark.range(n).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id / 7 as int))").alias("ts"))
    for size in (1, 7, 400, 1000, 5000):
        got = {r.id for r in sa.systematic_sample(df, size, [F.col("ts"), F.col("id")], F.col("ts").cast("date")).collect()}
        assert got == {i * n // size for i in range(size)}


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_in_two_steps(spark, k):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 4001).alias("v"), F.create_map(F.lit("a"), "id").alias("m"))
    got = [(r.g, r["rank"], r.v) for r in ru.ranked(df, k, ["g"], [F.desc("v")]).collect()]
    values = {g: sorted((i * 7919 % 4001 for i in range(g, 4000, 2)), reverse=True)[:k] for g in (0, 1)}
    assert sorted(got) == sorted((g, i + 1, v) for g in (0, 1) for i, v in enumerate(values[g]))


STOPS = "id string, code string, name string, on string, at string, shelter boolean, listed boolean"


def test_search_by_street_type_alone_lists_the_best_stops(spark):
    stops = spark.createDataFrame([("1000", "11000", "Main St", None, None, True, False), ("1001", "11001", "Oak Ave", None, None, False, True), ("1002", "11002", "Elm", None, None, False, False)], STOPS)
    q = spark.createDataFrame([("st",), ("ma",), ("main oak",), ("e",)], "q string")
    assert rows(pl.search_stops(q, stops), "q", "rank", "id") == [("e", 1, "1002"), ("ma", 1, "1000"), ("st", 1, "1001"), ("st", 2, "1000"), ("st", 3, "1002")]


def test_searches_stop_reading_at_their_last_hit(spark, monkeypatch):
    """Words of half of the stops, a rare word beside a frequent one, words that never meet: as by testing every stop."""
    import random

    rnd = random.Random(4)
    data = []
    for i in range(1500):
        names = ["Main" if i % 2 else "Oak", "Pine" if i % 3 else "Elm", f"Q{i % 97}", "Mason" if i % 500 == 7 else ""]
        data.append((str(10000 + i), str(90000 + i), " & ".join(n for n in names if n), None, None, rnd.random() < 0.3, rnd.random() < 0.2))
    stops = spark.createDataFrame(data, STOPS)
    texts = ["main pine", "oak pi", "main oak", "mas main", "q96 oak", "p m", "elm main q5", "zz main"]
    read = []
    monkeypatch.setattr(pl, "SEARCH_BLOCK", 8)
    real = pl.materialize
    monkeypatch.setattr(pl, "materialize", lambda df, label: read.append(label) or real(df, label))
    got = {}
    for r in pl.search_stops(spark.createDataFrame([(x,) for x in texts], "q string"), stops, k=5).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))

    def best(q):
        fits = [d for d in data if all(any(w.lower().startswith(t) for w in d[2].split(" & ")) for t in q.split())]
        bonus = {d[0]: 0.5 * d[6] + 0.1 * d[5] for d in data}
        return list(enumerate([d[0] for d in sorted(fits, key=lambda d: (-bonus[d[0]], d[0]))][:5], 1))

    assert {q: sorted(v) for q, v in got.items()} == {q: best(q) for q in texts if best(q)}
    assert read.count("search-hits") > 3          # "main oak" reads its list to the end
    read.clear()
    pl.search_stops(spark.createDataFrame([("main pine",), ("oak pi",)], "q string"), stops, k=5).count()
    assert read.count("search-hits") <= 3         # words that often meet are read to the fifth hit


def test_a_token_in_half_of_the_entries_joins_linearly(spark):
    entries = spark.range(2000).select(F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "main").otherwise("oak"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("key"), F.col("id").alias("pos"))
    index = entries.select("key", "pos", F.col("key").alias("name"), F.lit(1).alias("lat_e5"), F.lit(1).alias("lng_e5"), F.lit(False).alias("is_hotspot"), F.split("key", " ").alias("tokens"))
    q = pl.tokenized_queries(spark.createDataFrame([("main",), ("main x4",), ("oak x4",), ("x5 oak",), ("nowhere",)], "q string"), "q")
    got = {r.qkey: r.name for r in pl.match_corner(q, index).collect()}
    assert got == {"main": "main x0", "main x4": "main x4", "oak x5": "oak x5"}


def test_lever_survivors_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    tables = {"raw_911": rq.raw_calls(spark, sf), "raw_311": rq.raw_requests(spark, sf), "raw_incidents": rq.raw_incidents(spark, sf), "raw_ems": rq.raw_ems(spark, sf)}
    seen = []
    for n in (1, 8):
        twice = {k: v.unionByName(v).repartition(n) for k, v in tables.items()}
        got = se.lever_events(twice, rg.LEVERS)
        seen.append(sorted(map(str, got.select(*sorted(got.columns)).collect())))
    assert seen[0] == seen[1] and seen[0]


def test_filters_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tagged = rg.tag_signals(events, {"a": F.col("o_orderpriority") == "1-URGENT", "b": F.col("o_orderpriority") == "2-HIGH"})
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters:")[1]
    assert "1-URGENT" in pushed and "2-HIGH" in pushed
    assert t.SIGNALS


def test_sample_of_one_hot_bucket_orders_keys_in_parts(spark, monkeypatch):
    """Nine tenths of the rows on one day: no part holds more than a small share, and only keys are put in order."""
    seen = []
    real = sa.global_rank

    def watched(rows, order, out):
        placed = real(rows, order, out)
        parts = rows.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
        seen.append((rows.columns, max(r["count"] for r in parts) / rows.count()))
        return placed
    monkeypatch.setattr(sa, "global_rank", watched)
    n = 4000
    day = F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id") % 7)
    df = spark.range(n).select("id", day.alias("day"), F.lit("x" * 50).alias("wide"))
    got = {(r.day, r.id) for r in sa.systematic_sample(df, 50, [F.col("day"), F.col("id")], F.col("day")).collect()}
    every = sorted((r.day, r.id) for r in df.collect())
    assert got == {every[i * n // 50] for i in range(50)}
    ((columns, share),) = seen
    assert "wide" not in columns and share < 0.25


def test_ring_counts_pair_positions_once_whatever_the_keys(spark):
    import random

    from placetime.operators import spatial as sp

    rnd = random.Random(4)
    events = spark.createDataFrame([(rnd.choice("abc"), rnd.randrange(3), 3700000 + rnd.randrange(600), -12200000 + rnd.randrange(600)) for _ in range(800)], "signal string, m int, lat_e5 int, lng_e5 int")
    targets = spark.createDataFrame([(k, 3700000 + rnd.randrange(0, 600, 40), -12200000 + rnd.randrange(0, 600, 40)) for k in range(60)], "id int, lat_e5 int, lng_e5 int")
    got = sp.stop_and_ring_counts(events, targets, ["signal", "m"], 60, 150)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins_with_cells = [line for line in plan.splitlines() if "Join" in line and "_gy" in line]
    assert len(joins_with_cells) == 1 and "Window" not in plan
    pairs = sp.near_pairs(events.withColumn("e", F.monotonically_increasing_id()), targets.select("id", F.col("lat_e5").alias("t_lat"), F.col("lng_e5").alias("t_lng")), 150, 150).collect()
    want, nearest = {}, {}
    for p in pairs:
        nearest[p.e] = min(nearest.get(p.e, (1e9, 0)), (p.d2, p.id))
    for p in pairs:
        own = want.setdefault((p.id, p.signal, p.m), [0, 0])
        own[0] += p.d2 <= 3600 and nearest[p.e] == (p.d2, p.id)
        own[1] += p.d2 > 3600
    assert {(r.id, r.signal, r.m): [r.stop, r.ring] for r in got.collect()} == {k: v for k, v in want.items() if any(v)}


def test_numbers_within_keys_come_from_ranges(spark):
    """Seven tenths of the rows in one key, null keys and null orders: positions as in one sorted list, one shuffle of the rows, nothing written."""
    from placetime.functions import ranks

    key = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("k"), F.col("id") % 13))
    df = spark.range(2000).select(key.alias("key"), F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(50))).alias("a"), "id")
    numbered = ranks.number_within(df, ["key"], ["a", "id"], size="size")
    got = {r.id: (r.pos, r["size"]) for r in numbered.collect()}
    lists = {}
    for r in sorted(df.collect(), key=lambda r: (r.a is not None, r.a or 0, r.id)):
        lists.setdefault(r.key, []).append(r.id)
    assert got == {i: (k, len(ids)) for ids in lists.values() for k, i in enumerate(ids)}
    ranges = df.select("key", ranks.range_number(df, F.struct("key", "a", "id")).alias("r")).groupBy("key", "r").count()
    assert ranges.where("key = 'hot'").count() > 1 and ranges.agg(F.max("count")).first()[0] < 1000
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "placetime-rank" not in plan
    assert rows(ranks.number_within(df.limit(0), ["key"], ["a", "id"]), "id") == []
    assert rows(ranks.number_within(df.where("id = 3"), ["key"], ["a", "id"]), "id", "pos") == [(3, 0)]


def test_running_counts_without_keys_need_no_single_task(spark):
    from placetime.functions import ranks
    from placetime.operators import settling as stl

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.pmod(F.hash("id"), F.lit(700))).when(F.col("id") % 2 > 0, 5).alias("lag"))
    counted = ranks.value_counts(df, [], "lag")
    values = sorted(r.lag for r in df.collect() if r.lag is not None)
    want = [(v, values.count(v), sum(x <= v for x in values), len(values)) for v in sorted(set(values))]
    assert rows(counted, "lag", "c", "cum", "n") == want
    ranges = counted.select(ranks.range_number(counted, F.struct("lag")).alias("r")).groupBy("r").count()
    assert ranges.count() > 1 and ranges.agg(F.max("count")).first()[0] < len(want) / 2
    assert ranks.value_counts(df.where("lag < 0"), [], "lag").count() == 0
    late = stl.late_at_percentile(df, []).first()
    at = values[min(len(values), int(len(values) * 90 / 100) + 1) - 1]
    assert tuple(late) == (at, sum(v <= at for v in values), sum(v > at for v in values))
    curve = stl.lag_cdf(df, [], days=120).orderBy("k").collect()
    assert [r.k for r in curve] == list(range(121)) and abs(curve[60].f - sum(v <= 60 for v in values) / len(values)) < 1e-6
    far = spark.createDataFrame([(200,), (300,)], "lag int")
    assert {r.f for r in stl.lag_cdf(far, [], days=120).collect()} == {0.0}


def test_windows_of_one_circle_are_counted_once_and_from_running_totals(spark):
    """Counts on circles equal the counts a pin, odd windows included, and no join pairs the days with the windows."""
    import datetime as dt
    import random

    rnd = random.Random(4)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    counts = {(s, lever, k): rnd.randint(1, 5) for s in (1, 2) for lever in "ab" for k in rnd.sample(range(700), 200)}
    windows = [(i, rnd.choice((1, 2, 3)), rnd.choice("ab"), day(rnd.randrange(-20, 720)), *sorted(day(rnd.randrange(-20, 720)) for _ in range(2))) for i in range(60)]
    windows += [(90, 1, "a", day(5), day(9), day(3)), (91, 1, "a", None, day(3), day(400)), (92, None, "a", day(5), day(3), day(9)), (93, 1, "a", day(5), None, day(9))]
    daily = spark.createDataFrame([(s, lever, day(k), n) for (s, lever, k), n in counts.items()], "circle int, lever string, day date, n long")
    w = spark.createDataFrame(windows, "id int, circle int, lever string, date date, start date, end date")
    held = lambda c, l, lo, hi: sum(n for (s, v, k), n in counts.items() if s == c and v == l and lo and hi and lo <= day(k) <= hi)
    found = ev.before_after(daily, w, ("circle", "lever"))
    want = []
    for i, c, lever, date, lo, hi in windows:
        pre = held(c, lever, lo, min(hi, date - dt.timedelta(1))) if date else 0
        want.append((i, pre, held(c, lever, lo, hi) - pre))
    assert rows(found, "id", "pre", "post") == sorted(want)
    bars = ev.bucket_series(daily, w.where("id < 60"), ("circle", "lever"))
    assert rows(bars.groupBy("id").agg(F.sum("n").alias("n"))) == [(i, held(c, l, lo, hi)) for i, c, l, _, lo, hi in windows[:60]]


def test_neighbours_and_images_equal_brute_force_at_any_density(spark):
    """Sparse and crowded places, shared positions, ties: the radius that a point looks at changes no result."""
    import math
    import random

    rnd = random.Random(6)
    at = lambda: (3770000 + int(abs(rnd.gauss(0, 1)) ** 3 * 300), -12252000 + int(abs(rnd.gauss(0, 1)) ** 3 * 300))
    stops = [(i, *at()) for i in range(150)] + [(200 + i, 3770000, -12252000) for i in range(6)] + [(300, 3790000, -12252000), (301, None, None)]
    images = [(i, *at(), f"20{rnd.randint(10, 24)}-03-0{rnd.randint(1, 3)}", rnd.random() < 0.5) for i in range(400)]
    images += [(900, 3790000, -12252000, None, False), (901, 3770000, -12252000, None, False)]
    s = spark.createDataFrame(stops, "id int, lat_e5 int, lng_e5 int")
    im = spark.createDataFrame(images, "id int, lat_e5 int, lng_e5 int, captured string, pano boolean").withColumn("captured", F.col("captured").cast("date"))

    def d2(a, b):
        dy, dx = (a[0] - b[0]) * 1.1132, (a[1] - b[1]) * 1.1132 * math.cos(math.radians(a[0] / 100000))
        return dy * dy + dx * dx

    import datetime as dt

    placed = [p for p in stops if p[1]]
    near = []
    for i, *a in placed:
        for rank, (_, j) in enumerate(sorted((d2(a, b), j) for j, *b in placed if j != i and d2(a, b) <= 640000)[:3]):
            near.append((i, j, rank + 1))
    assert rows(sp.knn(s, s, 3, 800), "id", "nb_id", "rank") == sorted(near)
    best = []
    for i, *a in placed:
        scored = [
            (c is None, (dt.date(2024, 6, 1) - dt.date.fromisoformat(c)).days / 365.25 + math.sqrt(d2(a, (y, x))) / 40 + 1.5 * p if c else 0.0, j)
            for j, y, x, c, p in images if d2(a, (y, x)) <= 250 * 250
        ]
        if scored:
            best.append((i, min(scored)[2]))
    assert rows(sp.nearest_image(s, im, "2024-06-01", 250), "id", "image_id") == sorted(best)


@pytest.mark.parametrize("holes", [True, False])
def test_large_polygon_index_meets_each_position_once(spark, monkeypatch, holes):
    """Beyond the broadcast bound the districts are the same, points without a position included, and of parts with the
    same rings one is kept."""
    quad = lambda y, x, h: [(x + a * h, y + b * h, x + c * h, y + d * h) for a, b, c, d in ((-1, -1, -1, 1), (1, -1, -1, -1), (1, 1, 1, -1), (-1, 1, 1, 1))]
    sites = [(37.7, -122.5), (37.7, -122.5), (37.7005, -122.4996), (37.7, -122.5)]
    rings = [(f"B{k}", k, 0, "outer", quad(y, x, 0.000405)) for k, (y, x) in enumerate(sites)] + [("B3", 3, 0, "hole", quad(*sites[3], 0.000155))]
    r = spark.createDataFrame(rings, "district string, feature_order int, part int, role string, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    p = spark.createDataFrame([(k, 3770000 + (k * 7) % 120 - 45, -12250000 + (k * 11) % 130 - 45) for k in range(300)] * 2 + [(900, None, 3), (901, 3770000, None)], "id int, lat_e5 int, lng_e5 int")
    want = rows(sp.assign_polygon(p, r, holes, size=200), "id", "district")
    monkeypatch.setattr(sp, "POLYGON_INDEX_ROWS", 0)
    got = sp.assign_polygon(p.withColumn("district", F.lit("old")), r, holes, size=200)
    assert rows(got, "id", "district") == want and {d for _, d in want} == {"B0", "B2", "UNKNOWN"}
    assert sp._first_of_equal_parts(r).select("feature_order").distinct().count() == 3

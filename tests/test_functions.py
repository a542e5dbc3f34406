import pytest
from helpers import rows
from pyspark.sql import functions as F

from placetime.functions import fixed, geo, numbers, ranks, text as tx, timekeys as tk
from placetime.functions.joins import lookup_join


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_time_of_day_edges(spark):
    hours = [None, 5, 6, 11, 12, 17, 18, 19, 20, 21, 22, 0]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    got = {r[0]: (r[1], r[2], r[3]) for r in df.select(
        "h", tk.tod_bucket(F.col("h")), tk.tod_granular(F.col("h")), tk.tod_granular(F.col("h"), None)).collect()}
    assert got[None] == ("night", "night", None)
    assert got[5][:2] == ("night", "night") and got[6][:2] == ("day", "morning")
    assert got[19][:2] == ("day", "evening") and got[20][:2] == ("night", "evening")
    assert got[21][:2] == ("night", "evening") and got[22][:2] == ("night", "night")
    assert got[17][1] == "afternoon" and got[12][1] == "afternoon"


def test_granular_buckets_cover_each_hour_once():
    hours = [h for hs in fixed.GRANULAR_HOURS.values() for h in hs]
    assert sorted(hours) == list(range(24))


@pytest.mark.parametrize("day, monday", [
    ("2024-12-31", "2024-12-30"), ("2025-01-01", "2024-12-30"), ("2021-01-03", "2020-12-28"), ("2024-01-01", "2024-01-01"),
])
def test_week_starts_on_monday_across_years(spark, day, monday):
    assert str(one(spark, w=tk.week_start(F.lit(day)))["w"]) == monday


def test_month_arithmetic(spark):
    d = F.lit("2024-03-31").cast("date")
    r = one(spark, a=tk.months_back(d, 1), b=tk.month_end_after(F.lit("2024-01-01").cast("date"), 1), c=tk.month_length(d),
            e=tk.months_between_ym(F.lit("2023-11"), F.lit("2025-02")), f=tk.day_offset(d, "2024-03-01"))
    assert (str(r["a"]), str(r["b"]), r["c"], r["e"], r["f"]) == ("2024-02-01", "2024-02-29", 31, 15, 30)


def test_wall_clock_ignores_session_zone(spark):
    df = spark.createDataFrame([("2024-01-01 05:30:00",)], "s string").select(tk.ntz(F.col("s")).alias("t"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = df.select(F.hour("t").alias("h"), F.unix_seconds(tk.instant(F.col("t"))).alias("u"), tk.wall_clock(tk.instant(F.col("t"))).cast("string").alias("w")).first()
            assert (r["h"], r["u"], r["w"]) == (5, 1704087000, "2024-01-01 05:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rounding_flavours(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(numbers.half_up(F.col("x"))).collect()] == [1, 2, 3, 0, -1]
    assert [r[0] for r in df.select(numbers.half_even(F.col("x"))).collect()] == [0, 2, 2, 0, -2]


def test_cells_round_ties_upward(spark):
    df = spark.createDataFrame([(3778450,), (3778350,), (-12241450,), (3778449,)], "e int")
    assert [r[0] for r in df.select(geo.cell(F.col("e"))).collect()] == [37785, 37784, -122414, 37784]


@pytest.mark.parametrize("raw, key", [
    ("16th & Mission", "16 mission"), ("16TH ST / MISSION ST", "16 mission"), ("06TH ST", "6"), ("O'Farrell St and Jones", "farrell jones o"),
    ("MAIN ST \\ 1ST AVE", "1 main"), ("00 Way", "0"), ("", ""), (None, ""), ("Stanyan Street", "stanyan"), ("2nd 02ND 2", "2"),
])
def test_street_tokens(spark, raw, key):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(tx.token_key(tx.street_tokens(F.col("s")))).first()[0] == key


def test_location_labels(spark):
    df = spark.createDataFrame([("EDDY ST \\ HYDE ST",), (" 150 MAIN ST, SPRINGFIELD, CA 9",), ("INTERSECTION EDDY ST, HYDE ST, SPRINGFIELD, CA",), ("A\\B",)], "s string")
    assert [r[0] for r in df.select(tx.clean_location(F.col("s"))).collect()] == ["EDDY ST / HYDE ST", "150 MAIN ST", "INTERSECTION EDDY ST", "A / B"]
    assert [r[0] for r in df.select(tx.strip_city_tail(F.col("s"), "SPRINGFIELD")).collect()] == ["EDDY ST / HYDE ST", "150 MAIN ST", "EDDY ST, HYDE ST", "A / B"]


def test_token_match_is_two_valued(spark):
    df = spark.createDataFrame([("Drug Sales",), (None,), ("none",)], "s string")
    assert [r[0] for r in df.select(tx.token_any([F.col("s")], ["DRUG"])).collect()] == [True, False, False]


def test_basis_and_codes_and_links(spark):
    df = spark.createDataFrame([("Missed servicing; CBD",), ("CBDX",), (None,)], "s string")
    assert [r[0] for r in df.select(tx.basis_types(F.col("s"))).collect()] == [["contractor", "cbd"], ["unstated"], ["unstated"]]
    codes = spark.createDataFrame([("14567",), ("24567",), ("1456",), ("145678",)], "c string")
    assert [r[0] for r in codes.select(tx.parse_stop_code(F.col("c"))).collect()] == ["4567", None, None, None]
    links = spark.createDataFrame([([" https://a ", "ftp://b", "HTTP://c"],)], "l array<string>")
    assert links.select(tx.well_formed_links(F.col("l"))).first()[0] == ["https://a", "HTTP://c"]
    assert spark.createDataFrame([("a.org\n http://b ,",)], "l string").select(tx.parse_links(F.col("l"))).first()[0] == ["https://a.org", "http://b"]


def test_query_param_is_decoded(spark):
    df = spark.createDataFrame([("https://h/p/?what=More+light%20here&dp=drug",)], "u string")
    assert df.select(tx.query_param(F.col("u"), "what"), tx.query_param(F.col("u"), "no")).first()[:] == ("More light here", None)


@pytest.mark.parametrize("values, p50, p90", [(list(range(1, 11)), 6, 10), ([4], 4, 4), ([1, 1, 1, 9], 1, 9)])
def test_nearest_rank(spark, values, p50, p90):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v int")
    counts = ranks.value_counts(df, ["k"], "v")
    r = counts.groupBy("k").agg(*ranks.nearest_rank(counts, ["k"], "v", p50=50, p90=90)).first()
    assert (r["p50"], r["p90"]) == (p50, p90)


def test_global_rank_matches_sort(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("x"), (F.col("id") % 3).alias("k"))
    got = rows(ranks.global_rank(df, [F.col("k"), F.col("x")]), "rank", "k", "x")
    want = sorted(((i % 3), (i * 7919) % 5000) for i in range(5000))
    assert got == [(i, *w) for i, w in enumerate(want)]


def test_rank_within_hot_and_null_keys(spark):
    df = spark.range(0, 300).select(F.when(F.col("id") % 3 != 0, "hot").alias("k"), "id")
    got = rows(ranks.rank_within(df, ["k"], [F.col("id")]), "k", "pos", "id")
    hot = [r for r in got if r[0] == "hot"]
    assert [r[1] for r in hot] == list(range(200)) and [r[2] for r in hot] == sorted(r[2] for r in hot)
    assert sorted(r[1] for r in got if r[0] is None) == list(range(100))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast(spark, how):
    big = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("k"))
    small = spark.range(0, 20).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    assert rows(lookup_join(big, small, ["k"], how, rows=0), "id", "k", "v") == rows(lookup_join(big, small, ["k"], how), "id", "k", "v")


def test_labels(spark):
    d = F.lit("2026-05-03").cast("date")
    r = one(spark, a=tk.month_label(d), b=tk.day_label(d), c=tk.short_month_label(d), e=tk.hour_label(F.lit(0)), f=tk.hour_label(F.lit(13)))
    assert tuple(r) == ("May 2026", "5/3", "May '26", "12a", "1p")


def test_granularity_bounds(spark):
    s = F.lit("2024-01-01").cast("date")
    got = [one(spark, g=tk.granularity(s, F.date_add(s, n)))["g"] for n in (74, 75, 539, 540)]
    assert got == ["day", "week", "week", "month"]


def test_shared_dir_prefers_the_configured_folder(spark):
    assert ranks.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

import json
import os

import pytest
from helpers import rows
from pyspark.sql import functions as F

from placetime.operators import quality
from placetime.sources import events as ev, predicates as pr, readers as rd, registry as rg, sinks as sk


def raw(spark):
    data = [
        (1, "a", None), (2, "a", "2024-01-02 00:00:00"),            # undated copy comes first
        (3, "b", "2024-01-03 00:00:00"), (4, "b", "2024-01-01 00:00:00"),
        (5, None, "2024-01-05 00:00:00"), (6, None, "2024-01-06 00:00:00"), (7, None, None),
        (8, "c", None),
    ]
    df = spark.createDataFrame(data, "seq int, id string, t string")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz"))


def test_dedup_policies(spark):
    got = {p: [r[0] for r in rows(ev.dedup_first(raw(spark), "id", ["seq"], "ts", p), "seq")] for p in ev.DEDUP_POLICIES}
    assert got["id_first"] == [3, 5, 6]          # a's undated first copy swallows its dated one
    assert got["dated_first"] == [2, 3, 5, 6]
    assert got["null_once"] == [3, 5]


def test_dedup_prunes_inside_map_tasks(spark):
    plan = ev.dedup_first(raw(spark), "id", ["seq"], "ts")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") >= 2


def test_dedup_hot_id(spark):
    df = spark.range(0, 9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("2024-01-01").cast("date").alias("d"))
    assert ev.dedup_first(df, "k", ["-id"], "d").where("k = 'hot'").collect()[0]["id"] == 8997


def test_empty_input(spark):
    empty = raw(spark).where("false")
    assert ev.dedup_first(empty, "id", ["seq"], "ts").count() == 0


def test_complement_is_null_safe(spark):
    df = spark.createDataFrame([("x",), ("Paraphernalia",), (None,)], "incident_description string")
    other = rg.complement(pr.All(()), rg.PARAPHERNALIA_TEXT, rg.DEALER_TEXT)()
    assert [r[0] for r in df.select(other).collect()] == [True, False, True]


def test_tagging_gives_each_matching_signal_once(spark):
    df = spark.createDataFrame([("HOMELESS COMPLAINT", "HSOC", None), ("SIT/LIE ENFORCEMENT", "Y", None), ("HOMELESS COMPLAINT", "N", "dup")],
                               "call_type_final_desc string, onview_flag string, dup_cad_number string")
    tags = {s.key: s.where() for s in rg.UNHOUSED.on("raw_911")}
    assert rows(rg.tag_signals(df, tags), "signal") == [("cfs_homeless",), ("hsoc",)]


def test_lever_registry_is_complete():
    assert len(rg.LEVERS) == 14 and len(rg.LEVERS["homeless_presence"]) == 2


def test_registry_drift_is_found(spark):
    bad = quality.registry_conflicts({"drug": rg.DRUG.signals, "unhoused": rg.UNHOUSED.signals, "districts": rg.DISTRICTS.signals, "stops": rg.STOPS.signals}, spark)
    assert rows(bad, "entity", "detail") == [("needles", "districts,drug")]


def test_normalizers(spark):
    calls = spark.createDataFrame(
        [("1", "2024-01-05T10:11:12.000", ("Point", [-122.4, 37.7]), None, "SIT", None, "orig"), ("2", None, None, "A", "", "fin", "orig")],
        "cad_number string, received_datetime string, intersection_point struct<type:string,coordinates:array<double>>, intersection_name string, call_type_final_desc string, call_type_final_notes string, call_type_original_notes string")
    got = rows(ev.normalize_calls(calls), "id", "ym", "place", "lat_e5", "lng_e5", "notes")
    assert got == [("1", "2024-01", "(unknown location)", 3770000, -12240000, "SIT — orig"), ("2", None, "A", None, None, "fin")]
    reqs = spark.createDataFrame([("9", "2024-02-01T00:00:00", "37.5", "bad", "a_b_c", "1 MAIN")], "service_request_id string, requested_datetime string, lat string, long string, service_details string, address string")
    assert rows(ev.normalize_requests(reqs), "lat_e5", "lng_e5", "notes") == [(3750000, None, "a b c")]
    ems = spark.createDataFrame([("7", "2024-02-01T00:00:00", "Medical", "Serious", "X", None)], "call_number string, received_dttm string, call_type string, call_type_group string, address string, case_location struct<type:string,coordinates:array<double>>")
    assert rows(ev.normalize_ems(ems), "notes", "lat_e5") == [("Medical — Serious", None)]


def test_origin_is_no_coordinate(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (3770000, -12240000)], "a int, b int")
    lat, lng = ev.drop_origin(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(lat, lng).collect()] == [(None, None), (0, 5), (3770000, -12240000)]


def test_levers_without_an_id_keep_exact_copies(spark):
    row = ("c1", "2024-01-05T10:00:00", ("Point", [-122.4, 37.7]), "A", "SUSPICIOUS PERSON", "drug", None, "N", None)
    schema = ("cad_number string, received_datetime string, intersection_point struct<type:string,coordinates:array<double>>, intersection_name string, "
              "call_type_final_desc string, call_type_final_notes string, call_type_original_notes string, onview_flag string, dup_cad_number string")
    crisis = ("c2", *row[1:4], "MENTALLY DISTURBED", *row[5:])
    calls = spark.createDataFrame([row, row, crisis, crisis], schema)
    got = ev.lever_events({"raw_911": calls}, rg.LEVERS).groupBy("lever").count()
    assert rows(got) == [("drug", 2), ("mental_health", 1)]


def test_portal_json_array_and_lines(spark, tmp_path):
    recs = [{"cad_number": "1", "intersection_point": {"type": "Point", "coordinates": [-122.41, 37.78]}}, {"cad_number": "2"}]
    (tmp_path / "a.json").write_text(json.dumps(recs))
    df = rd.read_portal_json(spark, str(tmp_path / "a.json"), rd.SCHEMAS["raw_911"], multiline=True)
    lat, lng = ev.point_coords(F.col("intersection_point"))
    assert rows(df.select("cad_number", lat.alias("a"), lng.alias("b"))) == [("1", 3778000, -12241000), ("2", None, None)]


def test_tsv_short_rows_and_trimming(spark, tmp_path):
    (tmp_path / "l.tsv").write_text(" Stop ID \tLocation\tBoardings\n 14567 \tMain \n\"1\tx\t y \n")
    df = rd.read_tsv(spark, str(tmp_path / "l.tsv"))
    assert df.columns == ["Stop ID", "Location", "Boardings"]
    assert rows(df) == [('"1', "x", "y"), ("14567", "Main", "")]


def test_geojson_rings(spark, tmp_path):
    sq = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    geo = {"type": "FeatureCollection", "features": [
        {"properties": {"district": "A"}, "geometry": {"type": "Polygon", "coordinates": [sq(0, 0, 4), sq(1, 1, 1)]}},
        {"properties": {"district": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[sq(10, 0, 1)], [sq(20, 0, 1)]]}},
        {"properties": {"district": "C"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]}
    (tmp_path / "d.geojson").write_text(json.dumps(geo))
    r = rd.read_geojson_rings(spark, str(tmp_path / "d.geojson"))
    assert rows(r, "district", "feature_order", "part", "role") == [("A", 0, 0, "hole"), ("A", 0, 0, "outer"), ("B", 1, 0, "outer"), ("B", 1, 1, "outer")]
    from placetime.operators.spatial import assign_polygon
    pts = spark.createDataFrame([(1, 50000, 50000), (2, 150000, 150000), (3, 50000, 2050000), (4, 900000, 900000)], "id int, lat_e5 int, lng_e5 int")
    big = {"size": 100000}
    assert rows(assign_polygon(pts, r, **big), "id", "district") == [(1, "A"), (2, "A"), (3, "B"), (4, "UNKNOWN")]
    assert rows(assign_polygon(pts, r, holes=True, **big), "id", "district") == [(1, "A"), (2, "UNKNOWN"), (3, "B"), (4, "UNKNOWN")]


def test_feed_with_byte_order_mark(spark, tmp_path):
    for n, cols in rd.FEED_SCHEMAS.items():
        (tmp_path / f"{n}.txt").write_text("﻿" + ",".join(cols) + "\n" + ",".join(f"{n}{i}" for i in range(len(cols))) + "\n")
    feed = rd.read_feed(spark, str(tmp_path))
    assert feed["stops"].first()["stop_id"] == "stops0" and feed["trips"].columns == list(rd.FEED_SCHEMAS["trips"])


def test_fallback(spark, tmp_path):
    snap = spark.createDataFrame([("1",)], "id string")
    assert not rd.path_exists(spark, str(tmp_path / "none"))
    assert rd.with_fallback(None, snap, "new", "old").first()["feed_as_of"] == "old"
    assert rd.with_fallback(snap, snap, "new", "old").first()["feed_as_of"] == "new"


def test_dictionary_codes_what_is_asked(spark):
    many = spark.range(300).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    got = sk.dictionary_encode(many, ["c"])
    assert got.columns == ["c", "c_code"]
    assert [r.c for r in got.orderBy("c_code").collect()] == sorted(f"v{k}" for k in range(300))


def test_dictionary_codes_follow_sorted_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert rows(sk.dictionary_encode(df, ["c"])) == [("", 0), ("a", 1), ("b", 2), ("b", 2)]


def test_private_columns_stay_private(spark):
    df = spark.createDataFrame([("1", "m@x.org", "n")], "id string, email string, basis string")
    assert sk.public_projection(df).columns == ["id"]
    assert quality.leaked_columns(sk.public_projection(df), sk.PRIVATE_COLUMNS, spark).count() == 0
    assert quality.leaked_columns(df, sk.PRIVATE_COLUMNS, spark).count() == 2


def test_shard_keys(spark):
    df = spark.createDataFrame([("7",), ("345",), ("6789",), ("16789",)], "id string")
    assert [r[0] for r in df.select(sk.shard_key()).collect()] == ["00", "03", "67", "16"]


def test_series_roundtrip_and_slices(spark, tmp_path):
    s = spark.createDataFrame([("a", "x", "2024-01-01", 1), ("a", "x", "2024-02-01", 2), ("b", "x", "2024-01-01", 3)], "signal string, label string, period string, n long")
    arrays = sk.series_arrays(s, ["signal", "label"])
    assert rows(arrays, "signal", "values") == [("a", [1, 2]), ("b", [3])]
    sk.write_once(s, str(tmp_path / "s"), ["signal"])
    sl = rd.read_slice(spark, str(tmp_path / "s"), signal="a")
    assert sl.count() == 2 and "PartitionFilters: [isnotnull(signal" in sl._jdf.queryExecution().toString()


def test_read_signal_pushes_filters(spark, tmp_path):
    spark.createDataFrame([("Fraud", "2024-01-01", "1", "x")], "incident_category string, incident_date string, incident_id string, other string").write.parquet(str(tmp_path / "r"))
    from dataclasses import replace
    sig = replace(rg.HOMEPAGE["fraud"], select=("incident_id",))
    df = rd.read_signal(spark.read.parquet(str(tmp_path / "r")), sig, "2023-01-01")
    plan = df._jdf.queryExecution().toString()
    assert df.count() == 1 and "EqualTo(incident_category,Fraud)" in plan and "other" not in plan.split("ReadSchema")[1]


def test_shards_take_later_loads(spark, tmp_path):
    """A load rewrites its own shards only, repeats without effect, and a slice reads one folder."""
    path = str(tmp_path / "shards")
    make = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    files = lambda: {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("shard=")}
    assert sk.update_shards(make([1, 2, 150, 3000, None], "a"), path) == ["00", "01", "30", None]
    first = files()
    for _ in range(2):
        assert sk.update_shards(make([150, 151], "b"), path) == ["01"]
        again = files()
        assert {d for d in again if again[d] != first[d]} == {"shard=01"}
        back = spark.read.schema("id long, v string, shard string").parquet(path)
        assert rows(back) == rows(spark.createDataFrame([(1, "a", "00"), (2, "a", "00"), (150, "b", "01"), (151, "b", "01"), (3000, "a", "30"), (None, "a", None)], back.schema))
    assert sk.update_shards(make([None], "c"), path) == [None] and sk.update_shards(make([], "d"), path) == []
    back = spark.read.schema("id long, v string, shard string").parquet(path)
    assert rows(back.where("id IS NULL"), "v") == [("c",)] and back.count() == 6
    with pytest.raises(ValueError, match="columns"):
        sk.update_shards(make([1], "a").withColumn("w", F.lit(1)), path)
    part = rd.read_slice(spark, path, shard="30")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and rows(part, "id") == [(3000,)]

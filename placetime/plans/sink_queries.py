"""Events cleaning and sinks; written outputs are read back from the shared folder."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timekeys as tk
from ..functions.ranks import materialize, run_dir
from ..operators import rollup as ru
from ..operators import sampling as sa
from ..operators import spatial as sp
from ..sources import events as ev
from ..sources import readers as rd
from ..sources import registry as rg
from ..sources import sinks as sk
from . import tables as t
from .catalog import query
from .rollup_queries import _corners, _monthly


def _dedup_sql(policy: str) -> str:
    rows = "(SELECT * FROM raw WHERE ts IS NOT NULL)" if policy == "dated_first" else "raw"
    part = "id" if policy == "null_once" else "id, CASE WHEN id IS NULL THEN arrival END"
    return f"kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY arrival) AS r FROM {rows}) WHERE r = 1 AND ts IS NOT NULL)"


def _dedup(policy):
    def run(spark, sf):
        return ev.dedup_first(t.raw_points(spark, sf), "id", ["arrival"], "ts", policy).select("id", "arrival", F.col("ts").cast("date").cast("string").alias("day"))
    return run


for _p in ev.DEDUP_POLICIES:
    query(f"dedup_{_p}", f"WITH {t.RAW_POINTS}, {_dedup_sql(_p)} SELECT id, arrival, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM kept")(_dedup(_p))


def _kept(spark, sf):
    return sp.assign_polygon(ev.dedup_first(t.raw_points(spark, sf), "id", ["arrival"], "ts"), t.rings(spark, sf))


_KEPT = f"{t.RAW_POINTS}, {_dedup_sql('id_first')}, k AS (SELECT arrival AS id, id AS rid, lat_e5, lng_e5, ts, signal FROM kept), {t.assigned_sql('k', False)}"


@query("assignment_report", f"""WITH {_KEPT}, p AS (SELECT district, count(*) AS n FROM assigned GROUP BY ALL)
SELECT district, n, (SELECT count(*) FROM raw) AS rows, (SELECT count(id) - count(DISTINCT id) FROM raw) AS duplicates, (SELECT count(*) FROM assigned) AS kept,
  (SELECT count(*) FROM assigned WHERE lat_e5 IS NULL) AS no_coord, (SELECT count(*) FROM raw) - (SELECT count(id) - count(DISTINCT id) FROM raw) - (SELECT count(*) FROM assigned) AS undated FROM p""")
def assignment_report(spark, sf):
    return ev.assignment_report(t.raw_points(spark, sf), _kept(spark, sf), "id", "ts")


@query("time_keys", f"""WITH {t.POINTS} SELECT id, CAST(day AS VARCHAR) AS day, strftime(ts, '%Y-%m') AS ym, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, hour,
  CAST(date_diff('day', DATE '2023-01-01', day) AS INTEGER) AS day_idx, CASE WHEN hour >= 6 AND hour < 20 THEN 'day' ELSE 'night' END AS bucket,
  strftime(ts, '%b %Y') AS month_text, CAST(CASE WHEN hour % 12 = 0 THEN 12 ELSE hour % 12 END AS VARCHAR) || CASE WHEN hour < 12 THEN 'a' ELSE 'p' END AS hour_text,
  CAST(day(last_day(day)) AS INTEGER) AS month_days, CAST(CAST(date_trunc('month', day) - INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS two_back, CAST(last_day(day + INTERVAL 3 MONTH) AS VARCHAR) AS end3,
  CAST(CAST(ts - INTERVAL 28 DAY AS DATE) AS VARCHAR) AS four_weeks FROM pts""")
def time_keys(spark, sf):
    p = ev.time_keys(t.points(spark, sf).select("id", "ts"), "ts")
    d = F.col("day")
    return p.select(
        "id", d.cast("string").alias("day"), "ym", F.col("week").cast("string").alias("week"), "hour", "day_idx",
        tk.tod_bucket(F.col("hour")).alias("bucket"), tk.month_label(F.col("ts")).alias("month_text"), tk.hour_label(F.col("hour")).alias("hour_text"),
        tk.month_length(d).alias("month_days"), tk.months_back(d, 2).cast("string").alias("two_back"),
        tk.month_end_after(d, 3).cast("string").alias("end3"), tk.minus_weeks(F.col("ts"), 4).cast("date").cast("string").alias("four_weeks"),
    )


@query("history_filter", f"WITH {t.POINTS} SELECT id, signal FROM pts WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'")
def history_filter(spark, sf):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-08", "2024-01-22"))
    return t.points(spark, sf).where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("id", "signal")


_TAGS_SQL = """SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN gate AND (p1 OR p2) THEN 'named' END, CASE WHEN gate AND NOT p1 AND NOT p2 THEN 'other' END, CASE WHEN st = 'F' THEN 'closed' END], lambda x: x IS NOT NULL)) AS signal
FROM (SELECT o_orderkey, o_orderstatus AS st, o_orderstatus <> 'P' AS gate, coalesce(contains(upper(txt), 'URGENT'), false) AS p1, coalesce(contains(upper(txt), 'HIGH'), false) AS p2
  FROM (SELECT *, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS txt FROM orders))"""


def _tagged(spark, sf):
    o = t.table(spark, sf, "orders").withColumn("txt", F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderpriority")))
    gate = F.col("o_orderstatus") != "P"
    a, b = (tx.token_any([F.col("txt")], [w]) for w in ("URGENT", "HIGH"))
    tags = {"named": gate & (a | b), "other": rg.complement(gate, a, b), "closed": F.col("o_orderstatus") == "F"}
    return rg.tag_signals(o, tags)


@query("tag_signals", f"{_TAGS_SQL}")
def tag_signals(spark, sf):
    return _tagged(spark, sf).select(F.col("o_orderkey").alias("id"), "signal")


@query("complement_class", f"SELECT signal, count(*) AS n FROM ({_TAGS_SQL}) GROUP BY ALL")
def complement_class(spark, sf):
    return ru.counts_by(_tagged(spark, sf), ["signal"])


@query("union_across_break", f"""WITH {t.RAW_POINTS}, u AS (SELECT * FROM raw WHERE (signal = 'error' AND ts < TIMESTAMP '2024-01-15') OR (signal IN ('error', 'view') AND ts >= TIMESTAMP '2024-01-15')),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, CASE WHEN id IS NULL THEN arrival END ORDER BY arrival) AS r FROM u) WHERE r = 1)
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM k GROUP BY ALL""")
def union_across_break(spark, sf):
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    old = (F.col("signal") == "error") & (F.col("ts") < split)
    new = F.col("signal").isin("error", "view") & (F.col("ts") >= split)
    rows = ev.dedup_first(t.raw_points(spark, sf).where(old | new), "id", ["arrival"], "ts")
    return ru.counts_by(rows, [F.col("ts").cast("date").cast("string").alias("day")])


@query("union_sources", f"""WITH {t.RAW_POINTS}, src AS (SELECT 'calls' AS source, id, arrival, ts FROM raw WHERE signal IN ('error', 'view') UNION ALL SELECT 'requests', id, arrival, ts FROM raw WHERE signal IN ('view', 'click'))
SELECT source, id, arrival FROM (SELECT *, row_number() OVER (PARTITION BY source, id, CASE WHEN id IS NULL THEN arrival END ORDER BY arrival) AS r FROM src WHERE ts IS NOT NULL) WHERE r = 1""")
def union_sources(spark, sf):
    raw = t.raw_points(spark, sf)
    parts = {"calls": raw.where("signal in ('error', 'view')"), "requests": raw.where("signal in ('view', 'click')")}
    return ev.union_sources(parts, "id", ["arrival"], "ts").select("source", "id", "arrival")


@query("series_sink", f"WITH {t.SERIES} SELECT signal, label, array_to_string(list(n ORDER BY idx), ',') AS vals, strftime(min(period), '%Y-%m') AS start FROM s GROUP BY signal, label")
def series_sink(spark, sf):
    path = run_dir(spark, "series")
    sk.write_series(_monthly(spark, sf), path)
    back = spark.read.schema("signal string, label string, values array<bigint>, start date").json(path)
    return back.select("signal", "label", F.array_join("values", ",").alias("vals"), F.date_format("start", "yyyy-MM").alias("start"))


@query("lazy_slices", f"WITH {t.SERIES} SELECT label, CAST(sum(n) AS BIGINT) AS total FROM s WHERE signal = '2-HIGH' GROUP BY label")
def lazy_slices(spark, sf):
    path = run_dir(spark, "slices")
    sk.write_once(_monthly(spark, sf), path, ["signal"])
    return rd.read_slice(spark, path, signal="2-HIGH").groupBy("label").agg(F.sum("n").alias("total"))


@query("points_sink", f"""WITH {t.POINTS}, {t.assigned_sql('pts', False)} SELECT signal, lat_e5, lng_e5, CAST(date_diff('day', DATE '2023-01-01', day) AS INTEGER) AS day_idx, CAST(list_position({list(t.DISTRICTS)}, district) - 1 AS INTEGER) AS district_idx,
  CASE WHEN hour >= 6 AND hour < 20 THEN 0 ELSE 1 END AS tod_code, CAST(day AS VARCHAR) AS day, district FROM assigned WHERE district IN {t.IN_DISTRICTS}""")
def points_sink(spark, sf):
    path = run_dir(spark, "points")
    sk.write_points(sp.assign_polygon(t.points(spark, sf), t.rings(spark, sf)), path, t.DISTRICTS)
    back = sk.decode_points(spark.read.parquet(path), t.DISTRICTS, "2023-01-01")
    return back.withColumn("day", F.col("day").cast("string"))


@query("sharded_sink", "SELECT substr(CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END, 1, 2) AS shard, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer GROUP BY ALL")
def sharded_sink(spark, sf):
    path = run_dir(spark, "shards")
    sk.write_sharded(t.stops(spark, sf), path)
    back = spark.read.schema("id bigint, shard string").parquet(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("shard_update", """SELECT substr(CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END, 1, 2) AS shard,
  count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids, CAST(count(*) FILTER (WHERE shard = '01') AS BIGINT) AS late, shard = '01' AS rewritten FROM customer GROUP BY ALL""")
def shard_update(spark, sf):
    """A second load brings new and changed rows of one shard: it alone is rewritten, and the table equals one full build."""
    path = run_dir(spark, "shards")
    every = t.stops(spark, sf).select("id", "name", F.lit("first").alias("load"))
    late = sk.shard_key() == "01"
    sk.write_sharded(every.where(~late | (F.col("id") % 2 == 0)), path)
    stored = lambda: spark.read.schema("id bigint, name string, load string, shard string").parquet(path)
    file = F.max("_metadata.file_name")
    before = materialize(stored().groupBy("shard").agg(file.alias("file")), "shard-files")
    sk.update_shards(every.where(late).withColumn("load", F.lit("second")), path)
    after = stored().groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count_if(F.col("load") == "second").alias("late"), file.alias("_file")
    )
    return after.join(before, "shard", "left").select("shard", "n", "ids", "late", (~F.col("file").eqNullSafe(F.col("_file"))).alias("rewritten"))


@query("dictionary_encode", f"""WITH {t.POINTS}, a AS (SELECT DISTINCT name FROM pts), b AS (SELECT DISTINCT signal FROM pts), ca AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS c FROM a), cb AS (SELECT signal, row_number() OVER (ORDER BY signal) - 1 AS c FROM b)
SELECT id, ca.c AS name_code, cb.c AS signal_code FROM pts JOIN ca USING (name) JOIN cb USING (signal)""")
def dictionary_encode(spark, sf):
    d = sk.dictionary_encode(t.points(spark, sf).select("id", "name", "signal"), ["name", "signal"])
    return d.select("id", "name_code", "signal_code")


@query("provenance", f"""WITH {t.INCIDENTS} SELECT signal, goal, count(id) AS records FROM (SELECT unnest({t.SIGNAL_LIST[:-1]}, 'unused']) AS signal, unnest(['up','up','down','down','down','down']) AS goal) LEFT JOIN inc USING (signal) GROUP BY ALL""")
def provenance(spark, sf):
    goals = dict.fromkeys(t.SIGNALS[:2], "up")
    reg = rg.Registry(tuple(
        rg.Signal(s, "incidents", lambda s=s: F.col("signal") == s, "id", "day", goal=goals.get(s, "down")) for s in (*t.SIGNALS, "unused")
    ))
    return sk.provenance(t.incidents(spark, sf), reg).select("signal", "goal", "records")


@query("reproduced_query", f"WITH {t.INCIDENTS} SELECT ym AS month, count(*) AS reports FROM inc WHERE signal = '2-HIGH' AND district = 'ASIA' GROUP BY ALL")
def reproduced_query(spark, sf):
    t.incidents(spark, sf).createOrReplaceTempView("placetime_incidents")
    text = sk.reproduce_sql("placetime_incidents", "signal = '2-HIGH'", "day", district="ASIA")
    return spark.sql(text).select(F.date_format("month", "yyyy-MM").alias("month"), "reports")


@query("corner_map", f"""WITH {t.INCIDENTS}, m AS (SELECT district, name AS corner, ym, count(*) AS n FROM inc GROUP BY ALL)
SELECT district, corner, array_to_string(list(ym || '=' || CAST(n AS VARCHAR) ORDER BY ym), ' ') AS m, CAST(sum(n) AS BIGINT) AS total FROM m GROUP BY ALL""")
def corner_map(spark, sf):
    c = sk.corner_map(_corners(spark, sf))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return c.select("district", "corner", F.array_join(shown, " ").alias("m"), "total")


@query("public_projection", "SELECT c_custkey AS id, c_name AS name FROM customer")
def public_projection(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("x@example.org").alias("email"), F.lit("n").alias("basis"))
    return sk.public_projection(c)


@query("geojson_rings", f"""WITH {t.STOPS}, q AS (SELECT id, 'outer' AS role, 40.5::DOUBLE AS h, lat_e5, lng_e5 FROM stops UNION ALL SELECT id, 'hole', 15.5, lat_e5, lng_e5 FROM stops WHERE shelter)
SELECT 'B' || CAST(id AS VARCHAR) AS district, role, 4 AS edges, round((lng_e5 - h) / 100000.0, 7) AS west, round((lat_e5 + h) / 100000.0, 7) AS north FROM q""")
def geojson_rings(spark, sf):
    """Blocks written as GeoJSON, one collection per line, and read back."""
    path = run_dir(spark, "geojson")
    ring = F.struct((F.col("role") == "hole").alias("hole"), F.transform("edges", lambda e: F.array(e["x1"], e["y1"])).alias("xy"))
    feats = t.blocks(spark, sf).groupBy("district").agg(        # at most two rings per block
        F.transform(F.array_sort(F.collect_list(ring)), lambda r: r["xy"]).alias("coordinates")
    )
    feature = F.struct(
        F.struct("district").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), "coordinates").alias("geometry"),
    )
    feats.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value")).write.text(path)
    r = rd.read_geojson_rings(spark, path, multiline=False)
    return r.select(
        "district", "role", F.size("edges").alias("edges"),
        F.round(F.array_min(F.transform("edges", lambda e: e["x1"])), 7).alias("west"),
        F.round(F.array_max(F.transform("edges", lambda e: e["y2"])), 7).alias("north"),
    )


@query("portal_json", f"""WITH {t.POINTS} SELECT id, lat_e5, lng_e5, CAST(day AS VARCHAR) AS day, 'SUSPICIOUS — ' || signal AS notes, name AS place FROM pts""")
def portal_json(spark, sf):
    """Events written as portal rows (text scalars, GeoJSON points) and normalised again."""
    path = run_dir(spark, "portal")
    p = t.points(spark, sf)
    p.select(
        F.col("id").cast("string").alias("cad_number"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("received_datetime"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col("lng_e5") / 100000.0, F.col("lat_e5") / 100000.0).alias("coordinates")).alias("intersection_point"),
        F.col("name").alias("intersection_name"), F.lit("SUSPICIOUS").alias("call_type_final_desc"), F.col("signal").alias("call_type_final_notes"),
    ).write.json(path)
    back = ev.normalize_calls(rd.read_portal_json(spark, path, rd.SCHEMAS["raw_911"]))
    return back.select(F.col("id").cast("long").alias("id"), "lat_e5", "lng_e5", F.col("day").cast("string").alias("day"), "notes", "place")


@query("tsv_rows", "SELECT c_custkey AS id, c_name AS name, '' AS note FROM customer")
def tsv_rows(spark, sf):
    path = run_dir(spark, "tsv")
    t.table(spark, sf, "customer").select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias(" id "), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("note")
    ).write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).csv(path)
    return rd.read_tsv(spark, path).select(F.col("id").cast("long").alias("id"), "name", "note")


@query("feed_csv", """SELECT 'stops' AS file, CAST(s_suppkey AS VARCHAR) AS id, s_name AS detail, 1 AS n FROM supplier
UNION ALL SELECT 'routes', CAST(n_nationkey AS VARCHAR), n_name, 1 FROM nation
UNION ALL SELECT 'trips', CAST(o_orderkey AS VARCHAR), CAST(o_custkey % 25 AS VARCHAR), 1 FROM orders
UNION ALL SELECT 'stop_times', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(count(*) AS INTEGER) FROM lineitem GROUP BY l_orderkey, l_suppkey
UNION ALL SELECT 'feed_info', r_name, r_name, 1 FROM region""")
def feed_csv(spark, sf):
    """All files of a feed written and read back."""
    folder = run_dir(spark, "feed")
    text = lambda c, name: F.col(c).cast("string").alias(name)
    files = {
        "stops": t.table(spark, sf, "supplier").select(text("s_name", "stop_name"), text("s_suppkey", "stop_id")),
        "routes": t.table(spark, sf, "nation").select(text("n_nationkey", "route_id"), text("n_name", "route_short_name")),
        "trips": t.table(spark, sf, "orders").select(text("o_orderkey", "trip_id"), (F.col("o_custkey") % 25).cast("string").alias("route_id")),
        "stop_times": t.table(spark, sf, "lineitem").select(text("l_orderkey", "trip_id"), text("l_suppkey", "stop_id"), text("l_linenumber", "stop_sequence")),
        "feed_info": t.table(spark, sf, "region").select(text("r_name", "feed_version")),
    }
    for name, rows in files.items():
        rows.write.option("header", True).csv(f"{folder}/{name}.txt")
    feed = rd.read_feed(spark, folder)
    shown = {
        "stops": ("stop_id", "stop_name"), "routes": ("route_id", "route_short_name"), "trips": ("trip_id", "route_id"),
        "stop_times": ("trip_id", "stop_id"), "feed_info": ("feed_version", "feed_version"),
    }
    parts = [
        feed[name].select(F.lit(name).alias("file"), F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("detail"))
        for name, (a, b) in shown.items()
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("file", "id", "detail").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("reference_points", f"WITH {t.STOPS} SELECT CAST(id AS VARCHAR) AS id, lat_e5, lng_e5, shelter, id % 4 = 0 AS accessible FROM stops WHERE id % 23 <> 0")
def reference_points(spark, sf):
    k = F.col("id")
    raw = t.stops(spark, sf).select(
        k.cast("string").alias("stopid"), F.col("name").alias("stopname"), F.when(k % 23 != 0, (F.col("lat_e5") / 100000.0).cast("string")).alias("latitude"),
        (F.col("lng_e5") / 100000.0).cast("string").alias("longitude"), F.when(F.col("shelter"), "1").otherwise("0").alias("shelter"), F.lit(None).cast("string").alias("data_as_of"),
        F.when(k % 4 == 0, "1").alias("accessibilitymask"), F.col("on").alias("onstreet"), F.col("at").alias("atstreet"), F.lit("").alias("position"), F.lit("").alias("supervisor_district"),
    )
    return rd.reference_points(raw).select("id", "lat_e5", "lng_e5", "shelter", "accessible")


@query("fallback_feed", """SELECT 'absent' AS fresh, c_custkey AS id, '2024-05-01' AS feed_as_of FROM customer
UNION ALL SELECT 'present', c_custkey + 1000000, '2024-06-01' FROM customer""")
def fallback_feed(spark, sf):
    """Once without a fresh feed and once with one."""
    committed = t.stops(spark, sf).select("id")
    absent, present = run_dir(spark, "absent"), run_dir(spark, "fresh")
    committed.select((F.col("id") + 1000000).alias("id")).write.parquet(present)

    def feed(path: str, name: str):
        primary = spark.read.schema(committed.schema).parquet(path) if rd.path_exists(spark, path) else None
        return rd.with_fallback(primary, committed, "2024-06-01", "2024-05-01").select(F.lit(name).alias("fresh"), "id", "feed_as_of")

    return feed(absent, "absent").unionByName(feed(present, "present"))


# -- recent windows and samples ------------------------------------------------------------------
@query("recent_window", f"WITH {t.POINTS} SELECT id, signal FROM pts WHERE ts >= (SELECT max(ts) FROM pts) - INTERVAL 14 DAY")
def recent_window(spark, sf):
    return sa.recent_window(t.points(spark, sf), 2).select("id", "signal")


@query("hour_brush", f"WITH {t.POINTS} SELECT signal, hour, count(*) AS n FROM pts WHERE hour IN (7, 8, 22) GROUP BY ALL")
def hour_brush(spark, sf):
    return ru.counts_by(sa.hour_brush(t.points(spark, sf), [7, 8, 22]), ["signal", "hour"])


@query("tod_filter", f"WITH {t.POINTS} SELECT 'night' AS choice, signal, count(*) AS n FROM pts WHERE hour < 6 OR hour >= 20 GROUP BY ALL UNION ALL SELECT 'chips', signal, count(*) FROM pts WHERE hour BETWEEN 6 AND 11 OR hour BETWEEN 18 AND 21 GROUP BY ALL")
def tod_filter(spark, sf):
    p = t.points(spark, sf)
    a = ru.counts_by(sa.tod_filter(p, "night"), [F.lit("night").alias("choice"), "signal"])
    return a.unionByName(ru.counts_by(sa.tod_filter(p, ["morning", "evening"], page="night"), [F.lit("chips").alias("choice"), "signal"]))


@query("recent_flag", f"WITH {t.INCIDENTS} SELECT id, day >= DATE '2001-05-01' AS recent FROM inc")
def recent_flag(spark, sf):
    return t.incidents(spark, sf).select("id", sa.recent_flag(F.col("day"), t.AS_OF).alias("recent"))


@query("systematic_sample", f"""WITH {t.POINTS}, r AS (SELECT id, row_number() OVER (ORDER BY ts, id) - 1 AS p, count(*) OVER () AS n FROM pts),
i AS (SELECT CAST(floor(k * n / 400) AS BIGINT) AS p FROM (SELECT unnest(range(400)) AS k, (SELECT count(*) FROM pts) AS n)) SELECT id FROM r WHERE p IN (SELECT p FROM i)""")
def systematic_sample(spark, sf):
    return sa.systematic_sample(t.points(spark, sf).select("id", "ts"), 400, [F.col("ts"), F.col("id")], F.col("ts").cast("date")).select("id")

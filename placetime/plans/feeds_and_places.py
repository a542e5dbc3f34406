"""Transit feed, cross-street index, corner and stop search, text helpers."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ranks import materialize
from ..operators import feed as fe
from ..operators import places as pl
from . import tables as t
from .catalog import query

# -- transit feed: order lines as stop times, orders as trips, suppliers as stops --------------


def _feed(spark, sf):
    k = F.col("s_suppkey")
    lat, lng = t.hashed(k, 6007, 50021)
    o, l = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    return {
        "stops": t.table(spark, sf, "supplier").select(
            k.cast("string").alias("stop_id"), F.col("s_name").alias("stop_name"),
            F.concat(F.lit("1"), k.cast("string")).alias("stop_code"), F.lit("1").alias("wheelchair_boarding"),
            (lat / 100000.0).cast("string").alias("stop_lat"), (lng / 100000.0).cast("string").alias("stop_lon"),
        ),
        "routes": o.select("o_orderpriority").distinct().select(
            F.col("o_orderpriority").alias("route_id"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.substring("o_orderpriority", 1, 1)).alias("route_short_name"),
            F.col("o_orderpriority").alias("route_long_name"),
        ),
        "trips": o.select(
            F.col("o_orderkey").cast("string").alias("trip_id"), F.col("o_orderpriority").alias("route_id"),
            F.col("o_orderstatus").alias("direction_id"), (F.col("o_custkey") % 7).cast("string").alias("shape_id"),
        ),
        "stop_times": l.select(
            F.col("l_orderkey").cast("string").alias("trip_id"),
            (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("string").alias("stop_sequence"),
            F.col("l_suppkey").cast("string").alias("stop_id"),
        ).distinct(),
    }


_FEED = f"""fstops AS (SELECT s_suppkey AS id, {t.hashed_sql('s_suppkey', 6007, 50021)} FROM supplier),
stt AS (SELECT DISTINCT l_orderkey AS trip, l_linenumber * 1000000 + l_partkey AS seq, l_suppkey AS stop FROM lineitem),
len AS (SELECT trip, count(*) AS stops FROM stt GROUP BY trip),
tr AS (SELECT o_orderkey AS trip, o_orderpriority AS route_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderpriority ELSE substr(o_orderpriority, 1, 1) END AS route,
  o_orderstatus AS direction_id, o_custkey % 7 AS shape, stops FROM orders JOIN len ON len.trip = o_orderkey),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id, shape ORDER BY stops DESC, CAST(trip AS VARCHAR)) AS r FROM tr) WHERE r = 1),
pat AS (SELECT stt.trip, seq, stop, route, direction_id, lag(stop) OVER w AS prev_stop, lead(stop) OVER w AS next_stop FROM stt JOIN best ON best.trip = stt.trip WINDOW w AS (PARTITION BY stt.trip ORDER BY seq, CAST(stop AS VARCHAR))),
al AS (SELECT DISTINCT stop, route, direction_id, unnest([prev_stop, next_stop]) AS alt FROM pat),
ad AS (SELECT al.*, sqrt({t.d2_sql('a', 'b')}) AS d FROM al JOIN fstops a ON a.id = al.stop JOIN fstops b ON b.id = al.alt WHERE alt IS NOT NULL),
alts AS (SELECT stop, route, direction_id, alt, CAST(round_even(d, 0) AS BIGINT) AS m FROM (SELECT *, row_number() OVER (PARTITION BY stop, route, direction_id ORDER BY d, CAST(alt AS VARCHAR)) AS r FROM ad) WHERE r = 1)"""


@query("representative_trips", f"WITH {_FEED} SELECT route_id, direction_id, CAST(shape AS VARCHAR) AS shape_id, CAST(trip AS VARCHAR) AS trip_id, stops FROM best")
def representative_trips(spark, sf):
    f = _feed(spark, sf)
    return fe.representative_trips(f["stop_times"], f["trips"]).select("route_id", "direction_id", "shape_id", "trip_id", "stops")


@query("stop_patterns", f"WITH {_FEED} SELECT CAST(trip AS VARCHAR) AS trip_id, CAST(seq AS INTEGER) AS seq, CAST(stop AS VARCHAR) AS stop_id, route, direction_id, CAST(prev_stop AS VARCHAR) AS prev_stop, CAST(next_stop AS VARCHAR) AS next_stop FROM pat")
def stop_patterns(spark, sf):
    return fe.stop_patterns(_feed(spark, sf)).select("trip_id", "seq", "stop_id", "route", "direction_id", "prev_stop", "next_stop")


def _alts(spark, sf):
    f = _feed(spark, sf)
    patterns = materialize(fe.stop_patterns(f), "patterns")
    return patterns, fe.nearest_alternative(patterns, fe.feed_stops(f)), f


@query("nearest_alternative", f"WITH {_FEED} SELECT CAST(stop AS VARCHAR) AS stop_id, route, direction_id, CAST(alt AS VARCHAR) AS alt_id, m FROM alts")
def nearest_alternative(spark, sf):
    return _alts(spark, sf)[1]


@query("order_routes", f"""WITH {_FEED}, r AS (SELECT stop, array_to_string(list(route ORDER BY length(route), route), ' ') AS routes FROM (SELECT DISTINCT stop, route FROM pat) GROUP BY stop),
a AS (SELECT stop, array_to_string(list(CAST(m AS VARCHAR) || ':' || CAST(alt AS VARCHAR) ORDER BY m, route, direction_id), ' ') AS alts FROM alts GROUP BY stop)
SELECT CAST(r.stop AS VARCHAR) AS stop_id, routes, coalesce(alts, '') AS alts FROM r LEFT JOIN a ON a.stop = r.stop""")
def order_routes(spark, sf):
    patterns, alts, _ = _alts(spark, sf)
    s = fe.stop_summary(patterns, alts)
    shown = F.transform("alts", lambda a: F.concat(a["m"].cast("string"), F.lit(":"), a["alt_id"]))
    return s.select("stop_id", F.array_join("routes", " ").alias("routes"), F.coalesce(F.array_join(shown, " "), F.lit("")).alias("alts"))


@query("left_enrich_stops", f"""WITH {_FEED}, {t.STOPS}, r AS (SELECT stop, count(DISTINCT route) AS n FROM pat GROUP BY stop)
SELECT CAST(s.id AS VARCHAR) AS id, '1' || CAST(s.id AS VARCHAR) AS code, r.stop IS NOT NULL AS in_feed, coalesce(n, 0) AS n_routes FROM stops s LEFT JOIN r ON r.stop = s.id""")
def left_enrich_stops(spark, sf):
    patterns, alts, f = _alts(spark, sf)
    stops = t.stops(spark, sf).select(F.col("id").cast("string").alias("id"), "shelter")
    e = fe.enrich_stops(stops, fe.stop_summary(patterns, alts), f["stops"])
    return e.select("id", "code", "in_feed", F.coalesce(F.size("routes"), F.lit(0)).cast("long").alias("n_routes"))


# -- street tokens and the corner index ----------------------------------------------------------
_SUFFIX = "['st','street','ave','avenue','blvd','boulevard','dr','drive','ct','court','ln','lane','pl','place','ter','terrace','way','hwy','highway','rd','road','plz','plaza','row','aly','alley','cir','circle']"


def tokens_sql(c: str) -> str:
    w = f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w <> 'and')"
    w = f"list_transform({w}, lambda w: regexp_replace(w, '^(\\d+)(st|nd|rd|th)$', '\\1'))"
    w = f"list_transform({w}, lambda w: regexp_replace(w, '^0+(\\d+)$', '\\1'))"
    return f"list_filter({w}, lambda w: NOT list_contains({_SUFFIX}, w))"


def key_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct({tokens_sql(c)})), ' ')"


@query("street_tokens", f"SELECT page_id, {key_sql('url')} AS token_key, len(list_distinct({tokens_sql('url')})) AS n FROM pages")
def street_tokens(spark, sf):
    tok = tx.street_tokens(F.col("url"))
    return t.table(spark, sf, "pages").select("page_id", tx.token_key(tok).alias("token_key"), F.size(tok).cast("long").alias("n"))


@query("document_tokens", f"SELECT doc_id, md5({key_sql('text')}) AS token_md5 FROM documents")
def document_tokens(spark, sf):
    tok = tx.street_tokens(F.col("text"))
    return t.table(spark, sf, "documents").select("doc_id", F.md5(tx.token_key(tok).cast("binary")).alias("token_md5"))


def _pairs(spark, sf):
    """Cross-street permutations from customers: numbered streets with and without padding
    against named ones, both ways round, some rows unusable."""
    k = F.col("c_custkey")
    num = F.concat(F.lpad((k % 60).cast("string"), 2, "0"), F.lit("TH ST"))
    named = F.concat("c_mktsegment", F.lit(" "), (k % 8).cast("string"), F.when(k % 2 == 0, " AVE").otherwise(" BLVD"))
    lat, lng = t.hashed(k, 6007, 50021)
    return t.table(spark, sf, "customer").select(
        k.alias("pos"),
        F.when(k % 41 == 0, " ").when(k % 3 == 0, named).otherwise(num).alias("street_1"),
        F.when(k % 43 == 0, named).when(k % 3 == 0, num).otherwise(named).alias("street_2"),
        F.when(k % 47 != 0, (lat / 100000.0).cast("string")).alias("lat"), (lng / 100000.0).cast("string").alias("lng"),
    )


_PAIRS = f"""pr0 AS (SELECT c_custkey AS pos, printf('%02dTH ST', c_custkey % 60) AS num, c_mktsegment || ' ' || CAST(c_custkey % 8 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN ' AVE' ELSE ' BLVD' END AS named,
  {t.hashed_sql('c_custkey', 6007, 50021)} FROM customer),
pr AS (SELECT pos, trim(CASE WHEN pos % 41 = 0 THEN ' ' WHEN pos % 3 = 0 THEN named ELSE num END) AS s1, CASE WHEN pos % 43 = 0 THEN named WHEN pos % 3 = 0 THEN num ELSE named END AS s2,
  CASE WHEN pos % 47 <> 0 THEN lat_e5 END AS lat_e5, lng_e5 FROM pr0),
pk AS (SELECT *, {key_sql('s1')} AS k1, {key_sql('s2')} AS k2 FROM pr),
us AS (SELECT *, least(k1, k2) || ' x ' || greatest(k1, k2) AS pair_key FROM pk WHERE k1 <> '' AND k2 <> '' AND k1 <> k2 AND lat_e5 IS NOT NULL),
city0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY pos) AS r FROM us) WHERE r = 1)"""


@query("corner_index", f"WITH {_PAIRS} SELECT pair_key, pos, s1 AS street_1, s2 AS street_2, lat_e5, lng_e5 FROM city0")
def corner_index(spark, sf):
    return pl.corner_index(_pairs(spark, sf), "pos")


@query("street_dictionary", f"WITH {_PAIRS}, n AS (SELECT s1 AS street FROM city0 UNION SELECT s2 FROM city0) SELECT street, row_number() OVER (ORDER BY street) - 1 AS code FROM n")
def street_dictionary(spark, sf):
    return pl.street_dictionary(pl.corner_index(_pairs(spark, sf), "pos"))


def _city(spark, sf):
    named = pl.corner_index(_pairs(spark, sf), "pos").select(
        "pos", F.concat("street_1", F.lit(" / "), "street_2").alias("name"), "lat_e5", "lng_e5"
    )
    return pl.local_index(named, "pos")


_CITY = f"""{_PAIRS}, city1 AS (SELECT pos, s1 || ' / ' || s2 AS name, lat_e5, lng_e5 FROM city0),
city2 AS (SELECT *, {key_sql('name')} AS key FROM city1),
city AS (SELECT key, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(lat_e5, pos) AS lat_e5, arg_min(lng_e5, pos) AS lng_e5, count(*) AS cnt, string_split(key, ' ') AS toks
  FROM city2 WHERE len(string_split(key, ' ')) >= 2 GROUP BY key)"""


def _local_entries(spark, sf):
    k = F.col("id")
    named = F.concat(
        (k % 60).cast("string"), F.lit("th St & "),
        F.element_at(F.array(*[F.lit(s) for s in ("Automobile", "Building", "Furniture", "Household", "Machinery")]), (k % 5 + 1).cast("int")),
        F.lit(" "), (k % 8).cast("string"),
    )
    return t.points(spark, sf).select(
        k.alias("pos"), F.when(k % 17 == 0, "MAIN ST").otherwise(named).alias("name"), "lat_e5", "lng_e5"
    )


_LOCAL = f"""{t.POINTS}, le AS (SELECT id AS pos, CASE WHEN id % 17 = 0 THEN 'MAIN ST' ELSE CAST(id % 60 AS VARCHAR) || 'th St & ' || ['Automobile','Building','Furniture','Household','Machinery'][CAST(id % 5 + 1 AS INTEGER)] || ' ' || CAST(id % 8 AS VARCHAR) END AS name,
  lat_e5, lng_e5 FROM pts),
lk AS (SELECT *, {key_sql('name')} AS key FROM le),
local AS (SELECT key, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(lat_e5, pos) AS lat_e5, arg_min(lng_e5, pos) AS lng_e5, count(*) AS cnt, string_split(key, ' ') AS toks
  FROM lk WHERE len(string_split(key, ' ')) >= 2 GROUP BY key)"""


@query("local_index", f"WITH {_LOCAL} SELECT key, pos, name, lat_e5, lng_e5, cnt AS count FROM local")
def local_index(spark, sf):
    return pl.local_index(_local_entries(spark, sf), "pos").select("key", "pos", "name", "lat_e5", "lng_e5", "count")


def _queries(spark, sf):
    """Search texts from parts: two streets, one street, or a street no corner has."""
    k = F.col("p_partkey")
    seg = F.element_at(F.array(*[F.lit(s) for s in ("automobile", "building", "furniture", "household", "machinery", "nowhere")]), (k % 6 + 1).cast("int"))
    return t.table(spark, sf, "part").select(
        k.alias("qid"),
        F.when(k % 11 == 0, seg).otherwise(F.concat((k % 60).cast("string"), F.lit("th & "), seg, F.when(k % 2 == 0, F.concat(F.lit(" "), (k % 8).cast("string"))).otherwise(""))).alias("q"),
    )


_QUERIES = f"""qs AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 11 = 0 THEN seg ELSE CAST(p_partkey % 60 AS VARCHAR) || 'th & ' || seg || CASE WHEN p_partkey % 2 = 0 THEN ' ' || CAST(p_partkey % 8 AS VARCHAR) ELSE '' END END AS q
  FROM (SELECT p_partkey, ['automobile','building','furniture','household','machinery','nowhere'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS seg FROM part)),
qk AS (SELECT *, {key_sql('q')} AS qkey FROM qs), qt AS (SELECT *, string_split(qkey, ' ') AS toks FROM qk)"""


def _match_sql(index: str, out: str, source: str = "qt") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT q.qkey, i.key, i.name, i.lat_e5, i.lng_e5, CASE WHEN i.key = q.qkey THEN 2 ELSE 1 END AS score,
  row_number() OVER (PARTITION BY q.qkey ORDER BY CASE WHEN i.key = q.qkey THEN 2 ELSE 1 END DESC, i.pos) AS r
  FROM (SELECT DISTINCT qkey, toks FROM {source}) q JOIN {index} i ON list_has_all(i.toks, q.toks)) WHERE r = 1)"""


@query("match_intersection", f"WITH {_CITY}, {_QUERIES}, {_match_sql('city', 'mt')} SELECT qkey, score, name, lat_e5, lng_e5 FROM mt")
def match_intersection(spark, sf):
    q = pl.tokenized_queries(_queries(spark, sf), "q")
    m = pl.match_corner(q, materialize(_city(spark, sf), "city-index"))
    return m.select("qkey", "score", "name", "lat_e5", "lng_e5")


def _hotspot_index(spark, sf):
    local = materialize(pl.local_index(_local_entries(spark, sf), "pos"), "local-index")
    hot = local.where("count >= 6").withColumn("is_hotspot", F.lit(True))
    return pl.hotspot_first_index(hot, local)


@query("match_hotspot_first", f"""WITH {_LOCAL}, {_QUERIES}, sc AS (SELECT q.qkey, i.name, i.cnt >= 6 AS hot, CASE WHEN i.key = q.qkey THEN CASE WHEN i.cnt >= 6 THEN 4 ELSE 3 END WHEN i.cnt >= 6 THEN 2 ELSE 1 END AS score, i.pos, i.key
  FROM (SELECT DISTINCT qkey, toks FROM qt) q JOIN local i ON list_has_all(i.toks, q.toks))
SELECT qkey, score, name, hot AS is_hotspot FROM (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, pos, key) AS r FROM sc) WHERE r = 1""")
def match_hotspot_first(spark, sf):
    q = pl.tokenized_queries(_queries(spark, sf), "q")
    return pl.match_corner(q, _hotspot_index(spark, sf), hotspot_aware=True).select("qkey", "score", "name", "is_hotspot")


@query("resolve_intersection", f"""WITH {_LOCAL}, {_CITY}, {_QUERIES}, {_match_sql('local', 'ml', '(SELECT * FROM qt WHERE len(toks) >= 2)')}, {_match_sql('city', 'mc', '(SELECT * FROM qt WHERE len(toks) >= 2)')},
cm AS (SELECT mc.qkey AS id, mc.* FROM mc WHERE qkey NOT IN (SELECT qkey FROM ml)), {t.assigned_sql('cm', True)},
nr AS (SELECT a.qkey, l.name, sqrt(power((radians(l.lng_e5 / 100000.0) - radians(a.lng_e5 / 100000.0)) * cos(radians((l.lat_e5 / 100000.0 + a.lat_e5 / 100000.0) / 2)), 2) + power(radians(l.lat_e5 / 100000.0) - radians(a.lat_e5 / 100000.0), 2)) * 6371000 AS m, l.pos
  FROM assigned a JOIN local l ON abs(l.lat_e5 - a.lat_e5) <= 100 AND abs(l.lng_e5 - a.lng_e5) <= 120 WHERE a.district = 'AMERICA'),
nn AS (SELECT qkey, arg_min(name, m) AS near_name FROM nr WHERE m <= 80 GROUP BY qkey)
SELECT qid, CASE WHEN len(toks) < 2 THEN 'need-two' WHEN ml.qkey IS NOT NULL THEN 'local' WHEN a.qkey IS NULL THEN 'none' WHEN a.district = 'AMERICA' THEN 'city' ELSE 'out-of-district' END AS status,
  coalesce(ml.name, a.name) AS name, near_name, near_name IS NOT NULL AS nearby FROM qt LEFT JOIN ml ON ml.qkey = qt.qkey LEFT JOIN assigned a ON a.qkey = qt.qkey AND ml.qkey IS NULL LEFT JOIN nn ON nn.qkey = qt.qkey""")
def resolve_intersection(spark, sf):
    local = pl.local_index(_local_entries(spark, sf), "pos")
    r = pl.resolve_corners(_queries(spark, sf), "q", local, _city(spark, sf), t.rings(spark, sf), "AMERICA")
    return r.select("qid", "status", "name", "near_name", "nearby")


# -- stop search -----------------------------------------------------------------------------------
def _stop_queries(spark, sf):
    k = F.col("p_partkey")
    q = (
        F.when(k % 3 == 0, F.lpad((k % 900).cast("string"), 4, "0"))
        .when(k % 3 == 1, F.concat(F.lit("st"), (k % 40).cast("string"), F.lit(" & ave"), (k % 25).cast("string")))
        .otherwise(F.concat(F.lit("Ave"), (k % 3).cast("string")))
    )
    return t.table(spark, sf, "part").select(q.alias("q"))


def _search_stops(spark, sf):
    s = t.stops(spark, sf)
    return s.select(
        F.lpad(F.col("id").cast("string"), 4, "0").alias("id"), "code", "name", F.lit("").alias("on"), F.lit("").alias("at"),
        "shelter", (F.col("id") % 5 == 0).alias("listed"),
    )


_NAMEWORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains(['st','ave','blvd','and','the','way'], w))"


@query("search_stops", f"""WITH {t.STOPS}, st AS (SELECT lpad(CAST(id AS VARCHAR), 4, '0') AS sid, '1' || lpad(CAST(id AS VARCHAR), 4, '0') AS code, shelter, id % 5 = 0 AS listed, {_NAMEWORDS.replace('{c}', 'name')} AS words FROM stops),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey % 900 AS VARCHAR), 4, '0') WHEN p_partkey % 3 = 1 THEN 'st' || CAST(p_partkey % 40 AS VARCHAR) || ' & ave' || CAST(p_partkey % 25 AS VARCHAR)
  ELSE 'Ave' || CAST(p_partkey % 3 AS VARCHAR) END AS q FROM part),
qq AS (SELECT q, regexp_full_match(q, '\\d{{4,5}}') AS num, {_NAMEWORDS.replace('{c}', 'q')} AS toks FROM q),
hits AS (SELECT q, sid AS id, 0.0::DOUBLE AS score FROM qq JOIN st ON num AND (sid = q OR code = q OR starts_with(sid, q))
  UNION ALL SELECT q, sid, len(toks) + CASE WHEN listed THEN 0.5 ELSE 0 END + CASE WHEN shelter THEN 0.1::DOUBLE ELSE 0 END FROM qq JOIN st ON NOT num AND len(toks) > 0
  AND len(list_filter(toks, lambda tk: len(list_filter(words, lambda w: starts_with(w, tk))) > 0)) = len(toks))
SELECT q, id, round(score, 4) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, length(id), id) AS r FROM hits) WHERE r <= 12""")
def search_stops(spark, sf):
    r = pl.search_stops(_stop_queries(spark, sf), _search_stops(spark, sf))
    return r.select("q", "id", F.round("score", 4).alias("score"), "rank")


# -- text helpers over whole columns -------------------------------------------------------------
@query("clean_location", """WITH x AS (SELECT doc_id, replace(replace(trim(source || ' \\ ' || substr(lang, 1, 2) || ', ' || 'SPRINGFIELD, CA ' || CAST(n_chars AS VARCHAR)), ' \\ ', ' / '), '\\', ' / ') AS s FROM documents)
SELECT doc_id, trim(split_part(s, ',', 1)) AS label, trim(regexp_replace(s, ',?\\s*SPRINGFIELD\\b.*$', '', 'i')) AS live FROM x""")
def clean_location(spark, sf):
    raw = F.concat("source", F.lit(" \\ "), F.substring("lang", 1, 2), F.lit(", SPRINGFIELD, CA "), F.col("n_chars").cast("string"))
    return t.table(spark, sf, "documents").select(
        "doc_id", tx.clean_location(raw).alias("label"), tx.strip_city_tail(raw, "SPRINGFIELD").alias("live")
    )


@query("basis_types", """SELECT doc_id, CASE WHEN len(l) = 0 THEN 'unstated' ELSE array_to_string(l, ',') END AS basis FROM (SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(text, 'missed servicing', 'i') THEN 'contractor' END, CASE WHEN regexp_matches(text, '\\bCBD\\b|Partnership|TNDC', 'i') THEN 'cbd' END,
  CASE WHEN regexp_matches(text, 'State of California|Highway Patrol|General Services', 'i') THEN 'state' END, CASE WHEN regexp_matches(text, 'Mayor', 'i') THEN 'mayor' END], lambda x: x IS NOT NULL) AS l FROM documents)""")
def basis_types(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.array_join(tx.basis_types(F.col("text")), ",").alias("basis"))


@query("text_tokens_any", """SELECT conv_id, turn, coalesce(contains(upper(text), 'CODE') OR contains(upper(text), 'TH') , false) AS hit FROM conversations""")
def text_tokens_any(spark, sf):
    return t.table(spark, sf, "conversations").select("conv_id", "turn", tx.token_any([F.col("text")], ["CODE", "TH"]).alias("hit"))


@query("stop_codes", """SELECT c_custkey AS id, CASE WHEN regexp_full_match(code, '1\\d{4}') THEN substr(code, 2) END AS stop, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title,
  nullif(substr(trim(c_name), 1, 12), '') AS cut, replace(upper(c_name), '''', '') AS folded FROM (SELECT *, CAST(9000 + c_custkey * 3 AS VARCHAR) AS code FROM customer)""")
def stop_codes(spark, sf):
    code = (F.col("c_custkey") * 3 + 9000).cast("string")
    return t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), tx.parse_stop_code(code).alias("stop"), tx.first_upper(F.col("c_mktsegment")).alias("title"),
        tx.truncated(F.col("c_name"), 12).alias("cut"), tx.fold_street(F.col("c_name")).alias("folded"),
    )


@query("canon_district", """SELECT upper(coalesce(r_name, '')) AS district, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def canon_district(spark, sf):
    c, n, r = (t.table(spark, sf, x) for x in ("customer", "nation", "region"))
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.initcap("r_name")).otherwise(F.col("r_name"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.groupBy(tx.canon_district(mixed).alias("district")).agg(F.count(F.lit(1)).alias("n"))

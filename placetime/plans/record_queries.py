"""Intervention records built from suppliers, orders as their change log."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records as re
from . import tables as t
from .catalog import query

_RD = ["Central", "Northern", "Mission", "Tenderloin", "Richmond"]
_RD_SQL = "['Central','Northern','Mission','Tenderloin','Richmond']"


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _records(spark, sf):
    k = F.col("s_suppkey")
    lat, lng = t.hashed(k, 6007, 50021)
    legacy = k % 3 == 0
    url = F.concat(
        F.lit("https://maps.example.org/hypothesis/?what=More+lights%20at%20stop"), k.cast("string"),
        F.lit("&dp="), _pick(k, ["drug", "overflow", "graffiti"]), F.lit("&date=2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"),
        F.lit("&lat="), (lat / 100000.0).cast("string"), F.lit("&lng="), (lng / 100000.0).cast("string"),
    )
    none = F.lit(None)
    return t.table(spark, sf, "supplier").select(
        k.alias("id"), F.when(~legacy, F.col("s_name")).alias("intervention"),
        F.when(~legacy, F.array(_pick(k, ["noise", "dumping", "hazard"]))).alias("levers"),
        F.when(legacy, url).alias("url"), F.when(k % 4 != 0, _pick(k, ["open_in_progress", "closed_completed", "closed", "at_risk_on_hold"])).alias("status"),
        F.when(~legacy, "2024-03-01").alias("start_date"), none.cast("string").alias("end_date"),
        F.when(k % 5 == 0, _pick(k, _RD)).alias("district"), none.cast("double").alias("lat"), none.cast("double").alias("lng"),
        none.cast("double").alias("radius"), F.concat(F.lit("p"), k.cast("string"), F.lit("@example.org")).alias("email"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd").alias("created"),
        none.cast("string").alias("last_edited"),
    )


_RECORDS = f"""rec0 AS (SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS legacy, s_name, {t.hashed_sql('s_suppkey', 6007, 50021)},
  CASE WHEN s_suppkey % 4 <> 0 THEN ['open_in_progress','closed_completed','closed','at_risk_on_hold'][CAST(s_suppkey % 4 + 1 AS INTEGER)] END AS st,
  CASE WHEN s_suppkey % 5 = 0 THEN {_RD_SQL}[CAST(s_suppkey % 5 + 1 AS INTEGER)] END AS stored, strftime(DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER), '%Y-%m-%d') AS created FROM supplier),
rec AS (SELECT id, CASE WHEN legacy THEN 'More lights at stop' || CAST(id AS VARCHAR) ELSE s_name END AS intervention,
  CASE WHEN legacy THEN ['drug','overflow','graffiti'][CAST(id % 3 + 1 AS INTEGER)] ELSE ['noise','dumping','hazard'][CAST(id % 3 + 1 AS INTEGER)] END AS dp,
  coalesce(st, 'open_in_progress') AS status, CASE WHEN legacy THEN '2024-02-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') ELSE '2024-03-01' END AS start_date,
  stored, created, CASE WHEN legacy THEN lat_e5 END AS lat_e5, CASE WHEN legacy THEN lng_e5 END AS lng_e5 FROM rec0)"""


@query("interventions_projection", f"""WITH {_RECORDS}, {t.assigned_sql('rec', False, 'Other')} SELECT id, intervention, dp AS lever, status, start_date, coalesce(stored, district) AS district,
  created AS last_edited, lat_e5 / 100000.0 AS lat FROM assigned""")
def interventions_projection(spark, sf):
    p = re.public_records(_records(spark, sf), t.rings(spark, sf))
    return p.select("id", "intervention", F.array_join("levers", ",").alias("lever"), "status", "start_date", "district", "last_edited", "lat")


@query("tracker_rows", f"""WITH {_RECORDS} SELECT id, intervention, CASE dp WHEN 'drug' THEN 'Drug-related complaints' WHEN 'overflow' THEN 'Overflowing trash cans' WHEN 'dumping' THEN 'Illegal dumping'
  WHEN 'hazard' THEN 'Health-hazard waste' ELSE upper(substr(dp, 1, 1)) || substr(dp, 2) END AS target_kr, status FROM rec WHERE NOT starts_with(status, 'closed')""")
def tracker_rows(spark, sf):
    rows = re.visible_rows(re.table_rows(re.public_records(_records(spark, sf))))
    return rows.select("id", "intervention", "target_kr", "status")


@query("stale_evaluations", """SELECT o_orderkey AS id, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-07-15') > 30 AS stale FROM orders""")
def stale_evaluations(spark, sf):
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), re.stale(F.col("o_orderdate").cast("date"), "2001-07-15").alias("stale"))


def _forms(spark, sf):
    k = F.col("c_custkey")
    return t.table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 13 != 0, F.concat(F.lit("  "), F.when(k % 17 == 0, F.repeat("c_name", 40)).otherwise(F.col("c_name")))).alias("intervention"),
        F.when(k % 7 != 0, F.col("c_name")).otherwise(F.lit(" ")).alias("person_submitted"),
        F.when(k % 5 == 0, "not an address").when(k % 5 == 1, F.concat(k.cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(k % 11 != 0, _pick(k, _RD)).alias("district"), F.when(k % 6 != 0, _pick(k, ["open_in_progress", "closed_completed", "done"])).alias("status"),
        F.transform(F.sequence(F.lit(0), (k % 14).cast("int")), lambda i: F.when(i % 4 == 3, F.lit(" ")).otherwise(F.concat(F.lit("l"), i.cast("string")))).alias("levers"),
        F.array(F.lit(" https://a.example.org/x "), F.lit("ftp://b"), F.col("c_name")).alias("links"), F.repeat("c_mktsegment", 40).alias("owner"),
    )


@query("validate_interventions", """WITH f AS (SELECT c_custkey AS id, trim(CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 17 = 0 THEN repeat(c_name, 40) ELSE c_name END ELSE '' END) AS title,
  c_custkey % 7 = 0 AS no_name, c_custkey % 5 = 0 AS bad_mail, coalesce(CASE WHEN c_custkey % 11 <> 0 THEN ['Central','Northern','Mission','Tenderloin','Richmond'][CAST(c_custkey % 5 + 1 AS INTEGER)] END, '') AS d,
  coalesce(CASE WHEN c_custkey % 6 <> 0 THEN ['open_in_progress','closed_completed','done'][CAST(c_custkey % 3 + 1 AS INTEGER)] END, 'open_in_progress') AS st,
  len(list_filter(range(CAST(c_custkey % 14 + 1 AS BIGINT)), lambda i: i % 4 <> 3)) AS nl, substr(repeat(c_mktsegment, 40), 1, 200) AS owner, length(repeat(c_mktsegment, 40)) > 200 AS long FROM customer)
SELECT id, array_to_string(list_filter([CASE WHEN title = '' THEN 'title required' END, CASE WHEN length(title) > 500 THEN 'title too long' END, CASE WHEN no_name THEN 'name required' END,
  CASE WHEN bad_mail THEN 'email not valid' END, CASE WHEN d NOT IN ('Central','Northern','Mission','Tenderloin','Other') THEN 'district required' END,
  CASE WHEN st NOT IN ('open_in_progress','closed_completed','at_risk_on_hold') THEN 'status not valid' END, CASE WHEN nl > 10 THEN 'too many levers' END,
  CASE WHEN long THEN 'text too long' END], lambda x: x IS NOT NULL), ';') AS errors, least(nl, 10) AS n_levers, nl AS n_levers_whole, 'https://a.example.org/x' AS links, owner FROM f""")
def validate_interventions(spark, sf):
    v = re.validate_records(_forms(spark, sf))
    return v.select("id", F.array_join("errors", ";").alias("errors"), F.size("levers").cast("long").alias("n_levers"), F.size("levers_whole").cast("long").alias("n_levers_whole"), F.array_join("links", ",").alias("links"), "owner")


@query("validate_links", """WITH u AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '' WHEN page_id % 6 = 1 THEN replace(url, '://', ':') WHEN page_id % 6 = 2 THEN url
  ELSE regexp_replace(url, '[?#].*', '') || '?what=x%20y' END AS url FROM pages),
p AS (SELECT *, regexp_extract(url, '^https?://[^/?#]+') AS site, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM u)
SELECT page_id, CASE WHEN url = '' THEN 'required' WHEN site = '' THEN 'not valid' WHEN NOT regexp_matches(site, '^https?://(www|m|blog)[.]th[a-z]+[.]example[.](com|net|org)$') THEN 'other site'
  WHEN NOT contains(path, '/en/') THEN 'other page' WHEN NOT contains(url, '?what=') THEN 'no intervention' END AS problem FROM p""")
def validate_links(spark, sf):
    """The pages' URLs, some emptied, broken or given the parameter; hosts of one family count as the own site."""
    k, url = F.col("page_id") % 6, F.col("url")
    pages = t.table(spark, sf, "pages").select("page_id", (
        F.when(k == 0, "").when(k == 1, F.replace(url, F.lit("://"), F.lit(":"))).when(k == 2, url)
        .otherwise(F.concat(F.regexp_replace(url, "[?#].*", ""), F.lit("?what=x%20y")))
    ).alias("url"))
    return pages.select("page_id", re.validate_links(F.col("url"), r"^https?://(www|m|blog)[.]th[a-z]+[.]example[.](com|net|org)$", "/en/").alias("problem"))


@query("sequence_ids", f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS created, CASE o_orderpriority WHEN '1-URGENT' THEN 'CEN' WHEN '2-HIGH' THEN 'NOR' WHEN '3-MEDIUM' THEN 'MIS' WHEN '4-NOT SPECIFIED' THEN 'TEN' ELSE 'OTH' END AS prefix FROM orders),
iss AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'CEN' WHEN 1 THEN 'NOR' ELSE 'MIS' END AS prefix, max(s_suppkey + 1) AS last FROM supplier GROUP BY ALL),
n AS (SELECT id, prefix, row_number() OVER (PARTITION BY prefix ORDER BY created, id) AS pos FROM o)
SELECT id, prefix || CASE WHEN coalesce(last, 0) + pos < 1000 THEN lpad(CAST(coalesce(last, 0) + pos AS VARCHAR), 3, '0') ELSE CAST(coalesce(last, 0) + pos AS VARCHAR) END AS intervention_id FROM n LEFT JOIN iss USING (prefix)""")
def sequence_ids(spark, sf):
    from ..functions.fixed import ID_PREFIXES

    names = {"1-URGENT": "Central", "2-HIGH": "Northern", "3-MEDIUM": "Mission", "4-NOT SPECIFIED": "Tenderloin"}
    district = F.lit("Somewhere else")
    for k, v in names.items():
        district = F.when(F.col("o_orderpriority") == k, v).otherwise(district)
    new = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), district.alias("district"))
    k = F.col("s_suppkey")
    text = (k + 1).cast("string")
    issued = t.table(spark, sf, "supplier").select(
        F.concat(_pick(k, ["CEN", "NOR", "MIS"]), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0"))).alias("intervention_id")
    )
    return re.next_ids(new, issued, ID_PREFIXES, ["created", "id"]).select("id", "intervention_id")


@query("apply_changes", """WITH rec AS (SELECT c_custkey AS id, 'open_in_progress' AS status, c_mktsegment AS notes, CAST(NULL AS VARCHAR) AS end_date, TIMESTAMP '1994-01-01' AS last_edited FROM customer),
ch AS (SELECT o_custkey AS id, o_orderdate + to_microseconds(o_orderkey) AS ts, CASE WHEN o_totalprice > 480000 THEN 'delete' WHEN o_orderstatus = 'F' THEN 'close' WHEN o_orderstatus = 'O' THEN 'reopen' ELSE 'patch' END AS op, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS notes FROM orders),
l AS (SELECT id, max(ts) AS ts, bool_or(op = 'delete') AS gone, arg_max(op, ts) FILTER (WHERE op IN ('close', 'reopen')) AS st, arg_max(CASE WHEN op = 'close' THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE '-' END, ts) FILTER (WHERE op IN ('close', 'reopen')) AS e,
  arg_max(notes, ts) FILTER (WHERE notes IS NOT NULL) AS notes FROM ch GROUP BY id)
SELECT rec.id, CASE l.st WHEN 'close' THEN 'closed_completed' WHEN 'reopen' THEN 'open_in_progress' ELSE rec.status END AS status, coalesce(l.notes, rec.notes) AS notes, nullif(coalesce(e, '-'), '-') AS end_date,
  strftime(greatest(rec.last_edited, coalesce(l.ts, rec.last_edited)), '%Y-%m-%d') AS last_edited FROM rec LEFT JOIN l USING (id) WHERE NOT coalesce(gone, false)""")
def apply_changes(spark, sf):
    records = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("open_in_progress").alias("status"), F.col("c_mktsegment").alias("notes"),
        F.lit(None).cast("string").alias("end_date"), F.lit("1994-01-01").cast("timestamp_ntz").alias("last_edited"),
    )
    st = F.col("o_orderstatus")
    micros = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") / 1000000).cast("decimal(18,6)"))
    changes = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), (F.col("o_orderdate") + micros).alias("at"),
        F.when(F.col("o_totalprice") > 480000, "delete").when(st == "F", "close").when(st == "O", "reopen").otherwise("patch").alias("op"),
        F.lit(None).cast("string").alias("status"), F.when(st == "P", F.col("o_orderpriority")).alias("notes"),
    )
    a = re.apply_changes(records, changes, ["status", "notes"])
    return a.withColumn("last_edited", F.date_format("last_edited", "yyyy-MM-dd"))


@query("newest_first", "SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def newest_first(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").cast("string").alias("created"))
    return re.newest_first(o, 40)


@query("union_records", f"""WITH {_RECORDS} SELECT 'curated' AS origin, c_name AS intervention, c_mktsegment AS owner, CAST(NULL AS VARCHAR) AS status FROM customer
UNION ALL SELECT 'saved', intervention, NULL, status FROM rec""")
def union_records(spark, sf):
    curated = t.table(spark, sf, "customer").select(F.lit("curated").alias("origin"), F.col("c_name").alias("intervention"), F.col("c_mktsegment").alias("owner"))
    saved = re.public_records(_records(spark, sf)).select(F.lit("saved").alias("origin"), "intervention", "status")
    return re.union_records(curated, saved).select("origin", "intervention", "owner", "status")


@query("parse_links", """SELECT page_id, 'https://' || host || ',' || url AS links FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)""")
def parse_links(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    text = F.concat(host, F.lit("\n ,"), F.col("url"), F.lit(" "))
    return t.table(spark, sf, "pages").select("page_id", F.array_join(tx.parse_links(text), ",").alias("links"))

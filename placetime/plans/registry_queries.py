"""The named signals over portal-shaped tables derived from events, documents and order lines."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluate as ev
from ..operators import quality as qu
from ..operators import rollup as ru
from ..sources import events as se
from ..sources import predicates as pr
from ..sources import registry as rg
from ..sources import sinks as sk
from . import tables as t
from .catalog import query


def _pick(key, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _pick_sql(key, values):
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST({key} % {len(values)} + 1 AS INTEGER)]"


_TYPES = ["SUSPICIOUS PERSON", "SIT/LIE ENFORCEMENT", "HOMELESS COMPLAINT", "BLOCKED SIDEWALK", "MENTALLY DISTURBED", "MENTALLY DIST CRIT", "TRESPASSER"]
_FLAGS = ["N", "HSOC", "Y", None]
_NOTES = ["Possible drug sales", "male yelling", "meth pipe seen", None, "DEALER on corner", "loud music", "sales of goods"]
_SERVICES = ["Encampment", "Encampments", "General Request", "Street and Sidewalk Cleaning", "Graffiti", "Graffiti Public", "Noise Report", "Streetlights", "Graffiti Private", "Noise"]
_SUBTYPES = ["homeless_concerns", "garbage_and_debris", "Medical Waste", "Bulky Items", None, "Transit_Shelter_Platform", "HOMELESSNESS", "other"]
_DETAILS = ["needles_less_than_20", "Needles", "mattress", "Human or Animal Waste", "overflowing_can", None, "tire pile", "transit shelter glass", "oil spill", "syringe", "feces", "furniture"]
_CATS = ["Drug Offense", "Motor Vehicle Theft", "Larceny Theft", "Burglary", "Robbery", "Fraud"]
_SUBCATS = ["Larceny Theft - Shoplifting", "Burglary - Commercial", "Robbery - Commercial", "Robbery - Street", "Larceny - Other"]
_DESCS = ["Narcotics, For Sale", "Paraphernalia, Possession Of", "Dog, Bite or Attack", "Vehicle, Stolen, Auto", "Under Influence", "Vehicle, Stolen, Truck", None, "Drug Lab Apparatus, Possession", "Theft from Merchant or Library", "Vehicle, Stolen, Bus", "Marijuana, Cultivating/Planting"]
_RESOLUTIONS = ["Open or Active", "Cite or Arrest Adult", "Unfounded"]


def raw_calls(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    lat, lng = t.hashed(u, 7919, 104729)
    return t.table(spark, sf, "events").select(
        k.cast("string").alias("cad_number"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("received_datetime"),
        F.when(k % 31 != 0, F.struct(F.lit("Point").alias("type"), F.array(lng / 100000.0, lat / 100000.0).alias("coordinates"))).alias("intersection_point"),
        t.corner_name(u).alias("intersection_name"), _pick(k, _TYPES).alias("call_type_final_desc"),
        _pick(k + 2, _NOTES).alias("call_type_original_notes"), _pick(k * 3 + u, _NOTES).alias("call_type_final_notes"),
        _pick(k + u, _FLAGS).alias("onview_flag"), F.when(k % 13 == 0, F.lit("dup")).alias("dup_cad_number"),
    )


_CALLS = f"""rc AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, {_pick_sql('event_id', _TYPES)} AS ct, upper(coalesce({_pick_sql('(event_id + 2)', _NOTES)}, '')) AS n1, upper(coalesce({_pick_sql('(event_id * 3 + user_id)', _NOTES)}, '')) AS n2,
  {_pick_sql('(event_id + user_id)', _FLAGS)} AS flag, event_id % 13 = 0 AS dup,
  CASE WHEN event_id % 31 <> 0 THEN CAST({t.SOUTH} + (user_id * 7919) % {t.HEIGHT} AS INTEGER) END AS lat_e5, CASE WHEN event_id % 31 <> 0 THEN CAST({t.WEST} + (user_id * 104729) % {t.WIDTH} AS INTEGER) END AS lng_e5 FROM events),
cl AS (SELECT *, coalesce(flag IN ('N', 'HSOC'), false) AS comm, ct = 'SUSPICIOUS PERSON' AND (regexp_matches(n1, 'DRUG|DEALER|SALES|METH') OR regexp_matches(n2, 'DRUG|DEALER|SALES|METH')) AS drug FROM rc)"""


def raw_requests(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    lat, lng = t.hashed(k, 7919, 104729)
    return t.table(spark, sf, "events").select(
        k.cast("string").alias("service_request_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("requested_datetime"),
        (lat / 100000.0).cast("string").alias("lat"), (lng / 100000.0).cast("string").alias("long"),
        _pick(k, _SERVICES).alias("service_name"), _pick(k * 3 + u, _SUBTYPES).alias("service_subtype"), _pick(k * 7 + u, _DETAILS).alias("service_details"),
        F.concat(u.cast("string"), F.lit(" MAIN ST, SPRINGFIELD")).alias("address"),
    )


_REQUESTS = f"""rr AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, {_pick_sql('event_id', _SERVICES)} AS sn, coalesce({_pick_sql('(event_id * 3 + user_id)', _SUBTYPES)}, '') AS st, coalesce({_pick_sql('(event_id * 7 + user_id)', _DETAILS)}, '') AS sd,
  {t.hashed_sql('event_id', 7919, 104729)} FROM events),
rq AS (SELECT *, sn = 'Street and Sidewalk Cleaning' AS clean, lower(sd) AS ld, sn IN ('Encampment', 'Encampments') AS enc, sn = 'General Request' AND contains(lower(st), 'homeless') AS gen FROM rr)"""


def raw_incidents(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    lat, lng = t.hashed(k, 6007, 50021)
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    l = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        k.cast("string").alias("incident_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("incident_datetime"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("incident_date"),
        _pick(k, _CATS).alias("incident_category"), _pick(k * 3 + n, _SUBCATS).alias("incident_subcategory"), _pick(k + n * 2, _DESCS).alias("incident_description"),
        _pick(k + n, _RESOLUTIONS).alias("resolution"), F.when(n < 6, "Initial").otherwise("Supplement").alias("report_type_description"),
        t.corner_name(k).alias("intersection"), (lat / 100000.0).cast("string").alias("latitude"), (lng / 100000.0).cast("string").alias("longitude"),
    )


_INCIDENTS = f"""ri AS (SELECT l_orderkey AS id, CAST(o_orderdate AS DATE) AS day, {_pick_sql('l_orderkey', _CATS)} AS cat, {_pick_sql('(l_orderkey * 3 + l_linenumber)', _SUBCATS)} AS sub, {_pick_sql('(l_orderkey + l_linenumber * 2)', _DESCS)} AS descr,
  {_pick_sql('(l_orderkey + l_linenumber)', _RESOLUTIONS)} AS res, l_linenumber < 6 AS init, {t.hashed_sql('l_orderkey', 6007, 50021)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ic AS (SELECT *, cat = 'Drug Offense' AND init AND res = 'Cite or Arrest Adult' AS gate,
  coalesce(regexp_matches(upper(descr), 'FOR SALE|SALE|SALES|TRANSPORT|FURNISH|DELIV|MANUFACTUR|TRAFFIC|CULTIVAT|MAINTAIN PREMISE|MONEY OFFENSE|DRUG LAB APPARATUS'), false) AS deal, coalesce(contains(upper(descr), 'PARAPHERNALIA'), false) AS para FROM ri)"""


def _unique(*registries):
    return {s.key: s for r in registries for s in r.signals}


def _tag(df, signals):
    return rg.tag_signals(df, {k: s.filter for k, s in signals.items()})


@query("registry_calls", f"""WITH {_CALLS}, x AS (SELECT id, unnest(list_filter([CASE WHEN drug AND comm THEN 'cfs_drug' END, CASE WHEN ct = 'SIT/LIE ENFORCEMENT' AND comm AND NOT dup THEN 'cfs_sitlie' END,
  CASE WHEN ct = 'HOMELESS COMPLAINT' AND comm AND NOT dup THEN 'cfs_homeless' END, CASE WHEN flag = 'HSOC' AND NOT dup THEN 'hsoc' END,
  CASE WHEN ct IN ('SIT/LIE ENFORCEMENT', 'HOMELESS COMPLAINT') AND comm AND NOT dup THEN 'cfs_presence' END], lambda v: v IS NOT NULL)) AS signal FROM cl) SELECT id, signal FROM x""")
def registry_calls(spark, sf):
    signals = {k: s for k, s in _unique(rg.DRUG, rg.UNHOUSED, rg.STOPS).items() if s.table == "raw_911"}
    return _tag(raw_calls(spark, sf), signals).select(F.col("cad_number").cast("long").alias("id"), "signal")


@query("registry_requests", f"""WITH {_REQUESTS}, x AS (SELECT id, unnest(list_filter([CASE WHEN enc OR gen THEN 'encampment' END, CASE WHEN enc THEN 'encampment_only' END, CASE WHEN clean AND regexp_matches(ld, 'human|urine|fece') THEN 'waste' END,
  CASE WHEN clean AND regexp_matches(ld, 'needle|syringe') THEN 'needles' END, CASE WHEN regexp_matches(upper(st), 'TRANSIT_SHELTER|TRANSIT SHELTER') OR regexp_matches(upper(sd), 'TRANSIT_SHELTER|TRANSIT SHELTER') THEN 'shelter_maint' END,
  CASE WHEN clean AND ((st = 'garbage_and_debris' AND sd IN ('needles_less_than_20', 'needles_20_or_more')) OR (st = 'Medical Waste' AND sd = 'Needles')) THEN 'needles_exact' END], lambda v: v IS NOT NULL)) AS signal FROM rq) SELECT id, signal FROM x""")
def registry_requests(spark, sf):
    signals = {k: s for k, s in _unique(rg.DISTRICTS, rg.STOPS).items() if s.table == "raw_311"}
    tags = {k: s.filter for k, s in signals.items()}
    tags["needles_exact"] = rg.DRUG["needles"].filter
    return rg.tag_signals(raw_requests(spark, sf), tags).select(F.col("service_request_id").cast("long").alias("id"), "signal")


@query("registry_incidents", f"""WITH {_INCIDENTS}, x AS (SELECT id, strftime(day, '%Y-%m') AS month, unnest(list_filter([CASE WHEN gate AND deal THEN 'dealer_arrests' END, CASE WHEN gate AND para THEN 'paraphernalia' END, CASE WHEN gate AND NOT deal AND NOT para THEN 'other_drug_arrests' END,
  CASE WHEN sub = 'Larceny Theft - Shoplifting' THEN 'shoplifting' END, CASE WHEN sub IN ('Burglary - Commercial', 'Robbery - Commercial') THEN 'commercial' END, CASE WHEN cat = 'Motor Vehicle Theft' THEN 'vehicle' END,
  CASE WHEN cat = 'Fraud' THEN 'fraud' END, CASE WHEN descr = 'Dog, Bite or Attack' THEN 'dog_bites' END, CASE WHEN sub = 'Robbery - Street' THEN 'street_robbery' END], lambda v: v IS NOT NULL)) AS signal FROM ic)
SELECT signal, month, count(*) AS rows, count(DISTINCT id) AS incidents FROM x GROUP BY ALL""")
def registry_incidents(spark, sf):
    signals = {k: s for k, s in _unique(rg.DRUG, rg.THEFT, rg.HOMEPAGE).items() if s.table == "raw_incidents"}
    tagged = _tag(raw_incidents(spark, sf), signals)
    return tagged.groupBy("signal", F.substring("incident_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("incident_id").alias("incidents")
    )


@query("arrest_mix", f"""WITH {_INCIDENTS}, g AS (SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT CASE WHEN deal THEN id END) AS d, count(DISTINCT CASE WHEN para THEN id END) AS p, count(DISTINCT CASE WHEN NOT deal AND NOT para THEN id END) AS o FROM ic WHERE gate GROUP BY ALL)
SELECT 'arrest_mix' AS group_key, month, d + p + o AS n FROM g""")
def arrest_mix(spark, sf):
    signals = {k: rg.DRUG[k] for k in rg.DRUG.groups[0].members}
    rows = _tag(raw_incidents(spark, sf), signals)
    c = rows.groupBy("signal", F.substring("incident_date", 1, 7).alias("month")).agg(F.count_distinct("incident_id").alias("n"))
    from ..sources.sinks import group_members

    return ru.group_sum(c, group_members(rg.DRUG.groups, spark), ["month"])


@query("vehicle_types", f"""WITH {_INCIDENTS}, v AS (SELECT CASE descr WHEN 'Vehicle, Stolen, Auto' THEN 'auto' WHEN 'Vehicle, Stolen, Truck' THEN 'truck' WHEN 'Vehicle, Stolen, Bus' THEN 'other' END AS kind FROM ic WHERE cat = 'Motor Vehicle Theft')
SELECT coalesce(kind, 'untyped') AS kind, count(*) AS n FROM v GROUP BY ALL""")
def vehicle_types(spark, sf):
    rows = raw_incidents(spark, sf).where(rg.THEFT["vehicle"].where())
    mix = ru.type_mix(ru.map_category(rows, "incident_description", fixed.VEHICLE_TYPES), "kind", [])
    return mix.select("kind", "n")


@query("excluded_code_yearly", f"WITH {_INCIDENTS} SELECT CAST(year(day) AS VARCHAR) AS year, count(*) AS n FROM ic WHERE descr = 'Theft from Merchant or Library' GROUP BY ALL")
def excluded_code_yearly(spark, sf):
    cond = F.col("incident_description") == rg.LEGACY_THEFT_CODE
    return ru.counts_by(raw_incidents(spark, sf), [F.substring("incident_date", 1, 4).alias("year")], cond)


_LEVER_SQL = f"""WITH {_CALLS}, {_REQUESTS}, {_INCIDENTS}, e AS (
SELECT 'drug' AS lever, 0 AS source, id, day FROM cl WHERE drug AND comm
UNION ALL SELECT 'overflow', 0, id, day FROM rq WHERE clean AND contains(ld, 'overflow')
UNION ALL SELECT 'dumping', 0, id, day FROM rq WHERE clean AND (regexp_matches(ld, 'furniture|mattress|appliance|refriger|electronic|tire|illegal_dumping|illegal dumping|bulky') OR lower(st) = 'bulky items')
UNION ALL SELECT 'hazard', 0, id, day FROM rq WHERE clean AND regexp_matches(ld, 'human|urine|fece|needle|syringe|oil|hazard|medical|biohaz')
UNION ALL SELECT 'homeless_presence', 0, id, day FROM cl WHERE ct IN ('SIT/LIE ENFORCEMENT', 'BLOCKED SIDEWALK', 'HOMELESS COMPLAINT') AND comm AND NOT dup
UNION ALL SELECT 'homeless_presence', 1, id, day FROM rq WHERE enc
UNION ALL SELECT 'mental_health', 0, id, day FROM cl WHERE ct IN ('MENTALLY DISTURBED', 'MENTALLY DIST CRIT') AND comm AND NOT dup
UNION ALL SELECT 'encampments', 0, id, day FROM rq WHERE enc OR gen
UNION ALL SELECT 'graffiti', 0, id, day FROM rq WHERE starts_with(sn, 'Graffiti')
UNION ALL SELECT 'noise', 0, id, day FROM rq WHERE starts_with(sn, 'Noise')
UNION ALL SELECT 'lighting', 0, id, day FROM rq WHERE sn = 'Streetlights'
UNION ALL SELECT DISTINCT 'shoplifting', 0, id, day FROM ic WHERE sub = 'Larceny Theft - Shoplifting'
UNION ALL SELECT DISTINCT 'street_robbery', 0, id, day FROM ic WHERE sub = 'Robbery - Street'
UNION ALL SELECT DISTINCT 'commercial_burglary', 0, id, day FROM ic WHERE sub = 'Burglary - Commercial'
UNION ALL SELECT 'medical_emergencies', 0, id, day FROM cl WHERE ct = 'TRESPASSER' AND flag = 'N')"""


def raw_ems(spark, sf):
    c = raw_calls(spark, sf)
    first = (F.col("call_type_final_desc") == "TRESPASSER") & (F.col("onview_flag") == "N")
    return c.select(
        F.col("cad_number").alias("call_number"), F.col("received_datetime").alias("received_dttm"),
        F.when(F.col("call_type_final_desc") == "TRESPASSER", "Medical Incident").otherwise("Alarm").alias("call_type"),
        F.lit("Potentially Life-Threatening").alias("call_type_group"), F.when(first, 1).otherwise(2).alias("unit_sequence_in_call_dispatch"),
        F.col("intersection_name").alias("address"), F.col("intersection_point").alias("case_location"),
    )


def lever_events(spark, sf):
    return se.lever_events(_raw_tables(spark, sf), rg.LEVERS)


@query("lever_events", f"{_LEVER_SQL} SELECT lever, source, strftime(day, '%Y-%m') AS month, count(*) AS n FROM e GROUP BY ALL")
def lever_events_monthly(spark, sf):
    return ru.counts_by(lever_events(spark, sf), ["lever", "source", F.col("ym").alias("month")])


@query("signal_slice", f"""WITH {_INCIDENTS} SELECT id, cat AS category, CAST(day AS VARCHAR) AS day FROM ic WHERE sub IN ('Burglary - Commercial', 'Robbery - Commercial') AND day >= DATE '1999-01-01'""")
def signal_slice(spark, sf):
    """One signal since a history start, with only the columns it selects."""
    from dataclasses import replace

    from ..sources.readers import read_signal

    sig = replace(rg.THEFT["commercial"], select=("incident_id", "incident_category", "incident_date"))
    rows = read_signal(raw_incidents(spark, sf), sig, "1999-01-01")
    return rows.select(F.col("incident_id").cast("long").alias("id"), F.col("incident_category").alias("category"), F.substring("incident_date", 1, 10).alias("day"))


@query("lever_settling", f"{_LEVER_SQL}, b AS (SELECT lever, max(day) AS last FROM e GROUP BY lever) SELECT lever, CAST(last AS VARCHAR) AS last, date_diff('day', DATE '2001-09-01' - CAST(CASE WHEN lever IN ('shoplifting', 'street_robbery', 'commercial_burglary') THEN 62 ELSE 0 END AS INTEGER), last) > 0 AS settling FROM b")
def lever_settling(spark, sf):
    lag = F.lit(0)
    for k, sigs in rg.LEVERS.items():
        lag = F.when(F.col("lever") == k, max(s.settle_months for s in sigs)).otherwise(lag)
    last = lever_events(spark, sf).groupBy("lever").agg(F.max("day").alias("last"))
    return last.select("lever", F.col("last").cast("string").alias("last"), ev.settling_flag(F.col("last"), lag, "2001-09-01").alias("settling"))


HISTORY = "1998-06-01"


@query("lever_rows", f"{_LEVER_SQL} SELECT lever, source, CAST(id AS BIGINT) AS id, CAST(day AS VARCHAR) AS day FROM e WHERE day >= DATE '{HISTORY}'")
def lever_rows(spark, sf):
    """The events themselves, since a history start."""
    found = se.lever_events(_raw_tables(spark, sf), rg.LEVERS, HISTORY)
    return found.select("lever", "source", F.col("id").cast("long").alias("id"), F.col("day").cast("string").alias("day"))


def _raw_tables(spark, sf):
    return {"raw_911": raw_calls(spark, sf), "raw_311": raw_requests(spark, sf), "raw_incidents": raw_incidents(spark, sf), "raw_ems": raw_ems(spark, sf)}


_RAW_SQL = f"""raw_911 AS (SELECT {_pick_sql('event_id', _TYPES)} AS call_type_final_desc, {_pick_sql('(event_id + 2)', _NOTES)} AS call_type_original_notes,
  {_pick_sql('(event_id * 3 + user_id)', _NOTES)} AS call_type_final_notes, {_pick_sql('(event_id + user_id)', _FLAGS)} AS onview_flag, CASE WHEN event_id % 13 = 0 THEN 'dup' END AS dup_cad_number FROM events),
raw_311 AS (SELECT {_pick_sql('event_id', _SERVICES)} AS service_name, {_pick_sql('(event_id * 3 + user_id)', _SUBTYPES)} AS service_subtype, {_pick_sql('(event_id * 7 + user_id)', _DETAILS)} AS service_details FROM events),
raw_incidents AS (SELECT {_pick_sql('l_orderkey', _CATS)} AS incident_category, {_pick_sql('(l_orderkey * 3 + l_linenumber)', _SUBCATS)} AS incident_subcategory, {_pick_sql('(l_orderkey + l_linenumber * 2)', _DESCS)} AS incident_description,
  {_pick_sql('(l_orderkey + l_linenumber)', _RESOLUTIONS)} AS resolution, CASE WHEN l_linenumber < 6 THEN 'Initial' ELSE 'Supplement' END AS report_type_description FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_AUDITED = rg.Registry(tuple({s.key: s for r in (rg.DISTRICTS, rg.STOPS, rg.THEFT, rg.HOMEPAGE, rg.DRUG) for s in r.signals}.values()))


def _text(value):
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _audit_sql():
    """Every filter's text, and what DuckDB counts when it runs the same text."""
    rows = [(s, part, p.sql()) for s in _AUDITED.signals for part, p in [(None, s.filter), *s.components]]
    parts = [
        f"SELECT {_text(s.key)} AS signal, CAST({_text(part)} AS VARCHAR) AS component, {_text(s.table)} AS source, CAST({_text(s.caveat)} AS VARCHAR) AS caveat, {_text(text)} AS filter, count(*) AS records FROM {s.table} WHERE {text}"
        for s, part, text in rows
    ]
    return f"WITH {_RAW_SQL} " + " UNION ALL ".join(parts)


@query("provenance_filters", _audit_sql())
def provenance_filters(spark, sf):
    """Filter text, caveat and components of every signal, and the count that the text itself gives."""
    found = sk.audited(sk.provenance_filters(_AUDITED, spark), _raw_tables(spark, sf))
    return found.select("signal", "component", "source", "caveat", "filter", "records")


def _parity_pairs():
    sitlie, homeless = rg.UNHOUSED["cfs_sitlie"].filter, rg.UNHOUSED["cfs_homeless"].filter
    drug = rg.DRUG["cfs_drug"].filter
    return {
        "encampment": ("raw_311", rg.STOPS["encampment"].filter, rg.UNHOUSED["encampment"].filter),
        "cfs_presence": ("raw_911", rg.STOPS["cfs_presence"].filter, homeless | sitlie),
        "cfs_drug": ("raw_911", drug, pr.All(drug.terms[::-1])),
        "needles": ("raw_311", rg.DISTRICTS["needles"].filter, rg.DRUG["needles"].filter),
        "encampment_parts": ("raw_311", rg.UNHOUSED["encampment"].filter, pr.Any(tuple(p for _, p in rg.UNHOUSED["encampment"].components))),
    }


@query("filter_parity", f"""WITH {_CALLS}, {_REQUESTS}, n AS (SELECT clean AND regexp_matches(ld, 'needle|syringe') AS a,
  clean AND ((st = 'garbage_and_debris' AND sd IN ('needles_less_than_20', 'needles_20_or_more')) OR (st = 'Medical Waste' AND sd = 'Needles')) AS b FROM rq), k AS (
SELECT 'encampment' AS entity, true AS same_form, count(*) AS ours, count(*) AS theirs, 0 AS apart FROM rq WHERE enc OR gen
UNION ALL SELECT 'encampment_parts', true, count(*), count(*), 0 FROM rq WHERE enc OR gen
UNION ALL SELECT 'cfs_presence', true, count(*), count(*), 0 FROM cl WHERE ct IN ('SIT/LIE ENFORCEMENT', 'HOMELESS COMPLAINT') AND comm AND NOT dup
UNION ALL SELECT 'cfs_drug', true, count(*), count(*), 0 FROM cl WHERE drug AND comm
UNION ALL SELECT 'needles', false, count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (a <> b) FROM n) SELECT entity, same_form, ours, theirs, CAST(apart AS BIGINT) AS apart FROM k""")
def filter_parity(spark, sf):
    """Filters of one signal in several registries: one form wherever they should be, and the rows on which the rest differ."""
    return qu.filter_parity(_raw_tables(spark, sf), _parity_pairs())

"""Grid cells and their classes."""

from pyspark.sql import functions as F

from ..functions.ranks import materialize
from ..operators import hotspots as ho
from ..operators import quality as qu
from ..operators import rollup as ru
from . import tables as t
from .catalog import query

HOT, FLOOR, BAND = 0.3, 6, 0.35
BASELINE = {"base_lo": "1995-01-01", "base_hi": "1997-12-01"}
FIXED = [{"key": "now3", "lo": "2001-05-01", "hi": "2001-07-01", **BASELINE}]
MANY = FIXED + [
    {"key": "y2000", "lo": "2000-01-01", "hi": "2000-12-01", **BASELINE},
    {"key": "since_split", "lo": "1998-12-01", "hi": "2001-07-01", **BASELINE},
    {"key": "day_y2000", "lo": "2000-01-01", "hi": "2000-12-01", "slice": "day", **BASELINE},
    {"key": "night_y2000", "lo": "2000-01-01", "hi": "2000-12-01", "slice": "night", **BASELINE},
    {"key": "dusk_y2000", "lo": "2000-01-01", "hi": "2000-12-01", "slice": "morning+evening", **BASELINE},
]
_CELL = "CAST(floor((lat_e5 + 50) / 100.0) AS INTEGER) AS cy, CAST(floor((lng_e5 + 50) / 100.0) AS INTEGER) AS cx"
PLACED = f"""{t.INCIDENTS}, placed AS (SELECT *, {_CELL}, hour >= 6 AND hour < 20 AS is_day,
  CASE WHEN hour BETWEEN 6 AND 11 THEN 'morning' WHEN hour BETWEEN 12 AND 17 THEN 'afternoon'
  WHEN hour BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS gran FROM inc WHERE district IN {t.IN_DISTRICTS})"""
_COUNTS = """count(*) AS n, count(*) FILTER (WHERE is_day) AS "day", count(*) FILTER (WHERE NOT is_day) AS night,
  count(*) FILTER (WHERE gran = 'morning') AS g_morning, count(*) FILTER (WHERE gran = 'afternoon') AS g_afternoon,
  count(*) FILTER (WHERE gran = 'evening') AS g_evening, count(*) FILTER (WHERE gran = 'night') AS g_night"""
FACTS = f"""facts AS (SELECT signal, cy, cx, count(*) AS total, CAST(round(avg(lat_e5)) AS INTEGER) AS lat_e5,
  CAST(round(avg(lng_e5)) AS INTEGER) AS lng_e5, last(district ORDER BY ts, district) AS district FROM placed GROUP BY ALL HAVING count(*) >= {FLOOR})"""


def _placed(spark, sf):
    return ho.located(t.incidents(spark, sf), t.DISTRICTS)


def _cube(spark, sf):
    return ho.cell_cube(_placed(spark, sf))


def _classes(cube, windows):
    return ho.classify_cells(cube, windows, HOT, FLOOR, BAND)


def _written_cube(spark, sf):
    """The cube as a written table: the events are read once for all that derive from it."""
    return materialize(_cube(spark, sf), "cells")


@query("cells_monthly", f"WITH {PLACED} SELECT signal, cy, cx, ym AS month, {_COUNTS} FROM placed GROUP BY ALL")
def cells_monthly(spark, sf):
    m = ho.cells_monthly(_cube(spark, sf))
    return m.withColumn("month", F.date_format("period", "yyyy-MM")).drop("period")


@query("cells", f"WITH {PLACED}, {FACTS} SELECT signal, cy, cx, total, lat_e5, lng_e5, district FROM facts")
def cells(spark, sf):
    return ho.cell_facts(_cube(spark, sf), FLOOR)


@query("cell_names", f"""WITH {PLACED}, c AS (SELECT signal, cy, cx, name, count(*) AS c, min(ts) AS f FROM placed GROUP BY ALL)
SELECT signal, cy, cx, name FROM (SELECT *, row_number() OVER (PARTITION BY signal, cy, cx ORDER BY c DESC, f, name) AS r FROM c) WHERE r = 1""")
def cell_names(spark, sf):
    return ho.dominant_name(_placed(spark, sf))


@query("district_monthly", f"WITH {PLACED} SELECT signal, district, ym AS month, {_COUNTS} FROM placed GROUP BY ALL")
def district_monthly(spark, sf):
    m = ho.district_monthly(_cube(spark, sf))
    return m.withColumn("month", F.date_format("period", "yyyy-MM")).drop("period")


def _windows_sql(windows):
    rows = ", ".join(
        f"('{w['key']}', DATE '{w['lo']}', DATE '{w['hi']}', DATE '{w['base_lo']}', DATE '{w['base_hi']}', '{w['slice']}', {w['now_months']}, {w['pre_months']})"
        for w in ho.window_rows(windows)
    )
    return f"win AS (SELECT * FROM (VALUES {rows}) AS v(win, lo, hi, blo, bhi, slice, now_months, pre_months))"


_VALUE = """CASE slice WHEN 'all' THEN 1 WHEN 'day' THEN is_day::INT WHEN 'night' THEN (NOT is_day)::INT
  ELSE (gran IN ('morning', 'evening'))::INT END"""


def classes_sql(windows):
    sums = f"""CAST(sum({_VALUE}) FILTER (WHERE m BETWEEN blo AND bhi) AS BIGINT) AS pre, CAST(sum({_VALUE}) FILTER (WHERE m BETWEEN lo AND hi) AS BIGINT) AS now,
  count(*) FILTER (WHERE m BETWEEN lo AND hi AND is_day) AS now_day, count(*) FILTER (WHERE m BETWEEN lo AND hi AND NOT is_day) AS now_night"""
    return f"""{PLACED}, {FACTS}, {_windows_sql(windows)},
dc AS (SELECT signal, district, win, now_months, pre_months, {sums} FROM placed CROSS JOIN win GROUP BY ALL),
tide AS (SELECT signal, district, win, coalesce(pre, 0) AS pre, (coalesce(now, 0) / now_months::DOUBLE) AS d_now, (coalesce(pre, 0) / pre_months::DOUBLE) AS d_pre,
  CASE WHEN coalesce(pre, 0) > 0 THEN (coalesce(now, 0) / now_months::DOUBLE) / (coalesce(pre, 0) / pre_months::DOUBLE) ELSE 1 END AS tide FROM dc),
cc AS (SELECT p.signal, cy, cx, win, now_months, pre_months, {sums} FROM placed p CROSS JOIN win GROUP BY ALL),
j AS (SELECT signal, cy, cx, f.district, win, coalesce(cc.pre, 0) AS pre, coalesce(cc.now, 0) AS now, now_day, now_night,
  coalesce(cc.pre, 0) / pre_months::DOUBLE AS pre_rate, coalesce(cc.now, 0) / now_months::DOUBLE AS now_rate, t.tide
  FROM cc JOIN facts f USING (signal, cy, cx) JOIN tide t USING (signal, win) WHERE t.district = f.district),
cls AS (SELECT *, pre_rate * tide AS expected_rate, CASE WHEN pre + now < {FLOOR} OR NOT (pre_rate >= {HOT}::DOUBLE OR now_rate >= {HOT}::DOUBLE) THEN NULL
  WHEN now_rate >= {HOT}::DOUBLE AND pre_rate < {HOT}::DOUBLE THEN CASE WHEN now_rate > pre_rate * tide * 1.35::DOUBLE THEN 'emerged' END
  WHEN now_rate < pre_rate * tide * 0.65::DOUBLE THEN 'cooled' WHEN now_rate >= {HOT}::DOUBLE THEN 'persistent' END AS category FROM j)"""


_CLASS_COLS = """signal, cy, cx, district, win AS "window", pre, now, round(pre_rate, 6) AS pre_rate, round(now_rate, 6) AS now_rate,
  round(expected_rate, 6) AS expected_rate, round(tide, 6) AS tide, category,
  round(CASE WHEN now_day + now_night > 0 THEN now_night * 100::DOUBLE / (now_day + now_night) END, 6) AS night_pct"""


def _class_out(df):
    r = lambda c: F.round(c, 6).alias(c)
    return df.select("signal", "cy", "cx", "district", "window", "pre", "now", r("pre_rate"), r("now_rate"),
                     r("expected_rate"), r("tide"), "category", r("night_pct"))


@query("cell_classes", f"WITH {classes_sql(FIXED)} SELECT {_CLASS_COLS} FROM cls")
def cell_classes(spark, sf):
    return _class_out(_classes(_written_cube(spark, sf), FIXED))


@query("cell_classes_multiwindow", f"WITH {classes_sql(MANY)} SELECT {_CLASS_COLS} FROM cls")
def cell_classes_multiwindow(spark, sf):
    return _class_out(_classes(_written_cube(spark, sf), MANY))


@query("district_tide", f'WITH {classes_sql(MANY)} SELECT signal, district, win AS "window", round(d_pre, 6) AS d_pre, round(d_now, 6) AS d_now, round(tide, 6) AS tide FROM tide')
def district_tide(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    d = ho.district_tide(ho.district_monthly(_cube(spark, sf)), MANY)
    return d.select("signal", "district", "window", r("d_pre"), r("d_now"), r("tide"))


@query("category_counts", f"""WITH {classes_sql(MANY)}, c AS (SELECT * FROM cls WHERE category IS NOT NULL)
SELECT signal, win AS "window", district AS label, category, count(*) AS cells FROM c GROUP BY ALL
UNION ALL SELECT signal, win, 'Citywide', category, count(*) FROM c GROUP BY ALL""")
def category_counts(spark, sf):
    return ho.category_counts(_classes(_written_cube(spark, sf), MANY))


@query("night_share", f"""WITH {classes_sql(MANY)} SELECT signal, cy, cx, win AS "window",
  round(CASE WHEN now_day + now_night > 0 THEN now_night * 100::DOUBLE / (now_day + now_night) END, 6) AS night_pct FROM cls""")
def night_share(spark, sf):
    return _classes(_written_cube(spark, sf), MANY).select("signal", "cy", "cx", "window", F.round("night_pct", 6).alias("night_pct"))


@query("cell_breakdown", f"""WITH {PLACED}, c AS (SELECT signal, cy, cx, segment AS kind, count(*) AS n FROM placed WHERE gran IN ('morning', 'night') GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY signal, cy, cx ORDER BY n DESC, kind) AS INTEGER) AS rank FROM c),
k AS (SELECT * FROM r WHERE rank <= 3) SELECT signal, cy, cx, kind, n, rank, CAST(floor(n * 100::DOUBLE / sum(n) OVER (PARTITION BY signal, cy, cx) + 0.5) AS BIGINT) AS pct FROM k""")
def cell_breakdown(spark, sf):
    return ho.cell_breakdown(_placed(spark, sf), "segment", 3, ["morning", "night"])


@query("merge_signals", f"""WITH {PLACED}, g AS (SELECT 'serious' AS signal, cy, cx FROM placed WHERE signal IN ('1-URGENT', '2-HIGH'))
SELECT signal, cy, cx, count(*) AS total FROM g GROUP BY ALL HAVING count(*) >= {FLOOR}""")
def merge_signals(spark, sf):
    both = _placed(spark, sf).where(F.col("signal").isin("1-URGENT", "2-HIGH")).withColumn("signal", F.lit("serious"))
    return ho.cell_facts(ho.cell_cube(both), FLOOR).select("signal", "cy", "cx", "total")


_DAMAGED = "(cy + cx) % 7 = 0 AND category IS NOT NULL"
_ENTITY = "concat_ws('/', signal, CAST(cy AS VARCHAR), CAST(cx AS VARCHAR), win)"


@query("classifier_parity", f"""WITH {classes_sql(MANY)}, d AS (SELECT * FROM cls WHERE win = 'now3' AND {_DAMAGED})
SELECT 'class_mismatch' AS "check", {_ENTITY} AS entity, 'unsure vs ' || category AS detail FROM d
UNION ALL SELECT 'class_invariant', {_ENTITY}, 'unsure' FROM d""")
def classifier_parity(spark, sf):
    """A written classification with a few damaged cells against a fresh one: just these are reported."""
    keys = ["signal", "cy", "cx", "window"]
    cube = _written_cube(spark, sf)
    baked = materialize(_classes(cube, FIXED).withColumn("category", F.when(F.expr(_DAMAGED), "unsure").otherwise(F.col("category"))), "classes")
    fresh = _classes(cube, MANY)
    return qu.class_mismatch(baked, fresh.where("window = 'now3'"), keys).unionByName(qu.class_invariants(fresh, keys)).unionByName(
        qu.class_invariants(baked, keys)
    )


_GENERATED = qu.generated_windows(7, 50, "1998-01-01", "2001-07-01", BASELINE, ["all", "day", "night", "morning+evening"])
_PARTS = qu.halves(_GENERATED[:10])
_FUZZED = _GENERATED + [w for _, *two in _PARTS for w in two]
_WHOLE = [w["key"] for w in _FUZZED if w["slice"] == "all"]
_CATEGORY = "CASE WHEN abs(cy + cx) % 3 = 0 AND category IS NOT NULL THEN 'unsure' WHEN abs(cy + cx) % 3 = 1 AND category = 'emerged' THEN 'persistent' ELSE category END"
_NOW = "CASE WHEN abs(cy + cx) % 3 = 2 AND now > 0 THEN now - 1 ELSE now END"
_SIGNS = ", ".join(f"('{w['key']}', '{whole['key']}', {sign})" for whole, a, b in _PARTS for w, sign in ((whole, 1), (a, -1), (b, -1)))


@query("class_fuzz", f"""WITH {classes_sql(_FUZZED)}, d AS (SELECT *, {_CATEGORY} AS dcat, {_NOW} AS dnow FROM cls),
sums AS (SELECT signal, cy, cx, whole, sum(sign * dnow) AS off FROM d JOIN (VALUES {_SIGNS}) AS v(w, whole, sign) ON v.w = d.win GROUP BY ALL),
bad AS (SELECT 'class_mismatch' AS "check", win FROM d WHERE dcat IS DISTINCT FROM category
UNION ALL SELECT 'class_domain', win FROM d WHERE dcat = 'unsure'
UNION ALL SELECT 'class_persistent', win FROM d WHERE dcat = 'persistent' AND category = 'emerged'
UNION ALL SELECT 'class_floor', win FROM d WHERE dcat IS NOT NULL AND pre + dnow < {FLOOR}
UNION ALL SELECT 'class_split', win FROM d WHERE win IN ({", ".join(f"'{w}'" for w in _WHOLE)}) AND dnow <> now
UNION ALL SELECT 'floor_order', win FROM d WHERE pre + now >= {2 * FLOOR} AND dcat IS DISTINCT FROM category
UNION ALL SELECT 'window_sum', whole FROM sums WHERE off <> 0)
SELECT "check", win AS "window", count(*) AS cells FROM bad GROUP BY ALL""")
def class_fuzz(spark, sf):
    """Generated windows hold every rule; of a copy with damaged classes and counts, just the damage is reported."""
    keys = ["signal", "cy", "cx", "window"]
    cube = _written_cube(spark, sf)
    fresh = materialize(_classes(cube, _FUZZED), "classes")
    high = ho.classify_cells(cube, _FUZZED, HOT, 2 * FLOOR, BAND)
    damage = lambda df: df.withColumns({"category": F.expr(_CATEGORY), "now": F.expr(_NOW)})
    baked = damage(fresh)
    found = qu.class_mismatch(baked, fresh, keys).unionByName(qu.floor_order(fresh, damage(high), keys)).unionByName(qu.floor_order(fresh, high, keys))
    for classes in (fresh, baked):
        found = found.unionByName(qu.class_rules(classes, HOT, FLOOR, BAND, _WHOLE, keys)).unionByName(qu.window_sums(classes, _PARTS, keys))
    return found.groupBy("check", F.substring_index("entity", "/", -1).alias("window")).agg(F.count(F.lit(1)).alias("cells"))


@query("top_cells", f"""WITH {PLACED}, {FACTS} SELECT * FROM (SELECT signal, cy, cx, total,
  CAST(row_number() OVER (PARTITION BY signal ORDER BY total DESC, cy, cx) AS INTEGER) AS rank FROM facts) WHERE rank <= 10""")
def top_cells(spark, sf):
    f = ho.cell_facts(_cube(spark, sf), FLOOR).select("signal", "cy", "cx", "total")
    return ru.ranked(f, 10, ["signal"], [F.desc("total"), F.col("cy"), F.col("cx")])

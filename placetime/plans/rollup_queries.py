"""Rollups: monthly, weekly, time-of-day, groups, mixes, corners."""

from pyspark.sql import functions as F

from ..functions import timekeys as tk
from ..functions.joins import literal_rows
from ..functions.ranks import materialize
from ..operators import rollup as ru
from . import tables as t
from .catalog import query

IND = t.IN_DISTRICTS


def _monthly(spark, sf):
    return ru.dense_monthly(t.incidents(spark, sf), t.SIGNALS, t.DISTRICTS, t.LO, t.AS_OF)


def _both(spark, sf):
    """Monthly and weekly series from one daily cube, which is written once."""
    daily = materialize(ru.cube(t.incidents(spark, sf), F.col("day")), "daily")
    make = lambda unit: ru.dense_series(ru.recube(daily, unit), t.SIGNALS, t.DISTRICTS, t.LO, t.AS_OF, unit)
    return make("month"), make("week")


def _weekly(spark, sf):
    return ru.dense_weekly(t.incidents(spark, sf), t.SIGNALS, t.DISTRICTS, t.LO, t.AS_OF)


@query("monthly_by_district", f"WITH {t.SERIES} SELECT signal, label, month, idx, n FROM s")
def monthly_by_district(spark, sf):
    return _monthly(spark, sf).select("signal", "label", t.month(), "idx", "n")


@query("weekly_by_district", f"WITH {t.WEEKLY} SELECT signal, label, week, idx, n FROM w")
def weekly_by_district(spark, sf):
    return _weekly(spark, sf).select("signal", "label", F.col("period").cast("string").alias("week"), "idx", "n")


@query("sparse_monthly", f"""WITH {t.INCIDENTS}
SELECT signal, district AS label, ym AS month, count(*) AS n FROM inc WHERE district IN {IND} GROUP BY ALL
UNION ALL SELECT signal, 'Citywide', ym, count(*) FROM inc GROUP BY ALL""")
def sparse_monthly(spark, sf):
    c = ru.cube(t.incidents(spark, sf), tk.month_start(F.col("day")))
    return ru.by_label(c, t.DISTRICTS).select("signal", "label", t.month(), "n")


@query("monthly_distinct", f"""WITH {t.INCIDENTS}, l AS (SELECT signal, CASE WHEN district IN {IND} THEN district END AS d, ym,
  CASE WHEN hour >= 6 AND hour < 20 THEN 'day' ELSE 'night' END AS b, district, id
  FROM inc JOIN lineitem ON l_orderkey = id),
g AS (SELECT signal, district, ym, b, count(DISTINCT id) AS n FROM l GROUP BY ALL)
SELECT signal, district AS label, ym AS month, CAST(sum(n) AS BIGINT) AS n FROM g WHERE district IN {IND} GROUP BY ALL
UNION ALL SELECT signal, 'Citywide', ym, CAST(sum(n) AS BIGINT) FROM g GROUP BY ALL""")
def monthly_distinct(spark, sf):
    charges = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    rows = t.incidents(spark, sf).join(charges, "id")
    c = ru.distinct_cube(rows, "id", tk.month_start(F.col("day")))
    return ru.by_label(c, t.DISTRICTS).select("signal", "label", t.month(), "n")


@query("monthly_distinct_citywide", f"""WITH {t.INCIDENTS}, g AS (SELECT signal, ym AS month,
  CASE WHEN hour >= 6 AND hour < 20 THEN 'day' ELSE 'night' END AS bucket, count(DISTINCT id) AS n
  FROM inc JOIN lineitem ON l_orderkey = id GROUP BY ALL) SELECT * FROM g""")
def monthly_distinct_citywide(spark, sf):
    charges = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    rows = t.incidents(spark, sf).join(charges, "id")
    return ru.distinct_cube(rows, "id", tk.month_start(F.col("day")), ["signal"]).select(
        "signal", t.month(), "bucket", "n"
    )


@query("tod_split", f"""WITH {t.INCIDENTS} SELECT signal, district, ym AS month, count(*) AS total,
  count(*) FILTER (WHERE hour >= 6 AND hour < 20) AS day,
  count(*) FILTER (WHERE NOT (hour >= 6 AND hour < 20)) AS night FROM inc GROUP BY ALL""")
def tod_split(spark, sf):
    c = ru.cube(t.incidents(spark, sf), tk.month_start(F.col("day")))
    return ru.tod_split(c, ["signal", "district", "period"]).withColumn("month", F.date_format("period", "yyyy-MM")).drop("period")


@query("tod_series", f"""WITH {t.INCIDENTS}, b AS (SELECT *, CASE WHEN hour >= 6 AND hour < 20 THEN 'day' ELSE 'night' END AS bucket FROM inc)
SELECT signal, district AS label, ym AS month, bucket, count(*) AS n FROM b WHERE district IN {IND} GROUP BY ALL
UNION ALL SELECT signal, 'Citywide', ym, bucket, count(*) FROM b GROUP BY ALL""")
def tod_series(spark, sf):
    c = ru.cube(t.incidents(spark, sf), tk.month_start(F.col("day")))
    return ru.by_label(c, t.DISTRICTS, ["bucket"]).select("signal", "label", t.month(), "bucket", "n")


@query("tod_granular_split", f"""WITH {t.INCIDENTS} SELECT signal, district, count(*) AS total,
  count(*) FILTER (WHERE hour BETWEEN 6 AND 11) AS morning, count(*) FILTER (WHERE hour BETWEEN 12 AND 17) AS afternoon,
  count(*) FILTER (WHERE hour BETWEEN 18 AND 21) AS evening, count(*) FILTER (WHERE hour >= 22 OR hour < 6) AS night
  FROM inc GROUP BY ALL""")
def tod_granular_split(spark, sf):
    return ru.granular_split(t.incidents(spark, sf), ["signal", "district"])


@query("daily_to_weekly", f"""WITH {t.INCIDENTS}, d AS (SELECT signal, day, wk, count(DISTINCT custkey) AS n FROM inc GROUP BY ALL)
SELECT signal, CAST(wk AS VARCHAR) AS week, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY ALL""")
def daily_to_weekly(spark, sf):
    return ru.daily_to_weekly(t.incidents(spark, sf), "custkey", ["signal"]).select(
        "signal", F.col("period").cast("string").alias("week"), "n"
    )


_MEMBERS = [("serious", "1-URGENT"), ("serious", "2-HIGH"), ("minor", "4-NOT SPECIFIED"), ("minor", "5-LOW")]
_MEMBERS_SQL = "members AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{s}')" for g, s in _MEMBERS) + ") AS v(group_key, signal))"


@query("group_sum", f"""WITH {t.SERIES}, {_MEMBERS_SQL} SELECT group_key, label, month, CAST(sum(n) AS BIGINT) AS n
  FROM s JOIN members USING (signal) GROUP BY ALL""")
def group_sum(spark, sf):
    members = literal_rows(spark, _MEMBERS, "group_key string, signal string")
    g = ru.group_sum(_monthly(spark, sf), members, ["label", "period"])
    return g.select("group_key", "label", t.month(), "n")


@query("aggregate_series", f"""WITH {t.SERIES} SELECT 'front' AS signal, label, month, CAST(sum(n) AS BIGINT) AS n FROM s
  WHERE signal IN ('1-URGENT', '3-MEDIUM') GROUP BY ALL""")
def aggregate_series(spark, sf):
    a = ru.aggregate_series(_monthly(spark, sf), ["1-URGENT", "3-MEDIUM"], "front")
    return a.select("signal", "label", t.month(), "n")


@query("composition_share", f"""WITH {t.SERIES} SELECT signal, label, month, n,
  CAST(coalesce(floor(100.0::DOUBLE * n / nullif(sum(n) OVER (PARTITION BY label, month), 0) + 0.5), 0) AS BIGINT) AS pct
  FROM s WHERE signal IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def composition_share(spark, sf):
    c = ru.composition(_monthly(spark, sf), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return c.select("signal", "label", t.month(), "n", "pct")


@query("resolution_pivot", f"""WITH {t.INCIDENTS} SELECT signal, district, ym AS month, count(*) FILTER (WHERE resolution = 'O') AS reported,
  count(*) FILTER (WHERE resolution = 'F') AS arrests FROM inc GROUP BY ALL""")
def resolution_pivot(spark, sf):
    return ru.resolution_series(
        t.incidents(spark, sf), {"reported": "O", "arrests": "F"}, ["signal", "district", F.col("ym").alias("month")]
    )


@query("monthly_count_filtered", f"""WITH {t.INCIDENTS} SELECT district, ym AS month, count(*) AS n FROM inc
  WHERE signal = '1-URGENT' AND resolution = 'O' GROUP BY ALL""")
def monthly_count_filtered(spark, sf):
    cond = (F.col("signal") == "1-URGENT") & (F.col("resolution") == "O")
    return ru.monthly_count(t.incidents(spark, sf), cond, ["district", F.col("ym").alias("month")])


_TYPES = {"STANDARD": "auto", "SMALL": "motorcycle", "LARGE": "truck", "MEDIUM": "auto", "PROMO": "other"}
_TYPE_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"
_SOLD = f"""sold AS (SELECT l_returnflag AS flag, {_TYPE_CASE} AS kind FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _sold(spark, sf):
    l, p = t.table(spark, sf, "lineitem"), t.table(spark, sf, "part")
    j = l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_returnflag").alias("flag"), "p_type")
    return ru.map_category(j, "p_type", _TYPES)


@query("map_category", f"WITH {_SOLD} SELECT flag, kind, count(*) AS n FROM sold GROUP BY ALL")
def map_category(spark, sf):
    return ru.counts_by(_sold(spark, sf), ["flag", "kind"])


_MIX = f"""{_SOLD}, c AS (SELECT flag, kind, count(*) AS n FROM sold GROUP BY ALL),
mix AS (SELECT flag, coalesce(kind, 'untyped') AS kind, n, CAST(floor(0.5 + CASE WHEN kind IS NOT NULL
  THEN n * 100::DOUBLE / sum(CASE WHEN kind IS NOT NULL THEN n END) OVER (PARTITION BY flag)
  ELSE n * 100::DOUBLE / sum(n) OVER (PARTITION BY flag) END) AS BIGINT) AS pct FROM c)"""


@query("type_mix", f"WITH {_MIX} SELECT flag, kind, n, pct FROM mix")
def type_mix(spark, sf):
    return ru.type_mix(_sold(spark, sf), "kind", ["flag"])


@query("residual_last", f"""WITH {_MIX} SELECT flag, kind, n, pct, CAST(row_number() OVER (PARTITION BY flag
  ORDER BY kind = 'other', n DESC, kind) AS INTEGER) AS pos FROM mix""")
def residual_last(spark, sf):
    return ru.residual_last(ru.type_mix(_sold(spark, sf), "kind", ["flag"]), "kind", "other", ["flag"])


@query("hour_histogram", f"""WITH {t.POINTS}, c AS (SELECT signal, hour, count(*) AS n FROM pts GROUP BY ALL),
h AS (SELECT signal, CAST(hh AS INTEGER) AS hour, coalesce(n, 0) AS n FROM (SELECT DISTINCT signal FROM pts)
  CROSS JOIN (SELECT unnest(range(24)) AS hh) LEFT JOIN c USING (signal) WHERE c.hour = hh
  UNION ALL SELECT signal, CAST(hh AS INTEGER), 0 FROM (SELECT DISTINCT signal FROM pts) CROSS JOIN (SELECT unnest(range(24)) AS hh)
  WHERE (signal, CAST(hh AS INTEGER)) NOT IN (SELECT (signal, hour) FROM c))
SELECT signal, hour, CAST(n AS BIGINT) AS n, hour = first(hour) OVER (PARTITION BY signal ORDER BY n DESC, hour) AS is_peak,
  n / 4.0::DOUBLE AS per_week FROM h""")
def hour_histogram(spark, sf):
    return ru.hour_histogram(t.points(spark, sf), ["signal"], weeks=4)


_CORNERS = f"""{t.INCIDENTS}, r0 AS (SELECT district, name AS corner, ym,
  CASE WHEN ym >= '1995-06' THEN lat_e5 / 100000.0 END AS lat, CASE WHEN ym >= '1995-06' THEN lng_e5 / 100000.0 END AS lng FROM inc),
bm AS (SELECT district, corner, ym, count(*) AS n, max(lat) AS lat, max(lng) AS lng FROM r0 GROUP BY ALL),
spot AS (SELECT district, corner, arg_min(lat, ym) FILTER (WHERE lat IS NOT NULL) AS lat, arg_min(lng, ym) FILTER (WHERE lat IS NOT NULL) AS lng,
  CAST(sum(n) AS BIGINT) AS total FROM bm GROUP BY ALL HAVING count(lat) > 0),
corners AS (SELECT district, corner, ym, n, total, CAST(round(spot.lat * 100000) AS INTEGER) AS lat_e5,
  CAST(round(spot.lng * 100000) AS INTEGER) AS lng_e5 FROM bm JOIN spot USING (district, corner))"""


def _reports_with_corner(spark, sf):
    known = F.col("ym") >= "1995-06"
    return t.incidents(spark, sf).select(
        "district", F.col("name").alias("corner"), "ym",
        F.when(known, F.col("lat_e5") / 100000.0).alias("lat"), F.when(known, F.col("lng_e5") / 100000.0).alias("lng"),
    )


def _corners(spark, sf):
    return ru.corner_monthly(_reports_with_corner(spark, sf))


# max(lat), max(lng) are taken per month, then the first month's pair is kept
@query("corner_monthly", f"WITH {_CORNERS} SELECT district, corner, ym, n, total, lat_e5, lng_e5 FROM corners")
def corner_monthly(spark, sf):
    return _corners(spark, sf)


@query("corner_window_counts", f"""WITH {_CORNERS} SELECT district, corner,
  CAST(coalesce(sum(n) FILTER (WHERE ym BETWEEN '1998-01' AND '1999-06'), 0) AS BIGINT) AS n FROM corners GROUP BY ALL""")
def corner_window_counts(spark, sf):
    return ru.corner_window(_corners(spark, sf), "1998-01", "1999-06")


@query("corner_boxes", f"""WITH {_CORNERS} SELECT district, min(lat_e5) AS south, max(lat_e5) AS north, min(lng_e5) AS west,
  max(lng_e5) AS east, CAST(sum(n) AS BIGINT) AS n FROM corners GROUP BY ALL""")
def corner_boxes(spark, sf):
    return ru.corner_boxes(_corners(spark, sf))


@query("citywide_corners", f"""WITH {_CORNERS}, c AS (SELECT corner, CAST(sum(n) AS BIGINT) AS n FROM corners WHERE ym BETWEEN '1998-01' AND '1999-06' GROUP BY ALL)
SELECT corner, n FROM c""")
def citywide_corners(spark, sf):
    return ru.corner_window(_corners(spark, sf), "1998-01", "1999-06", keys=()).where("n > 0")


@query("top_corners", f"""WITH {t.INCIDENTS}, c AS (SELECT district, name AS corner, count(*) AS n FROM inc GROUP BY ALL)
SELECT * FROM (SELECT district, corner, n, CAST(row_number() OVER (PARTITION BY district ORDER BY n DESC, corner) AS INTEGER) AS rank FROM c) WHERE rank <= 7""")
def top_corners(spark, sf):
    return ru.top_corners(_reports_with_corner(spark, sf))


@query("ranked_corners", f"""WITH {_CORNERS}, c AS (SELECT district, corner, CAST(sum(n) AS BIGINT) AS n FROM corners
  WHERE ym BETWEEN '1998-01' AND '1999-06' GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY district ORDER BY n DESC, corner) AS INTEGER) AS rank,
  CAST(sum(n) OVER (PARTITION BY district) AS BIGINT) AS window_total FROM c)
SELECT district, corner, n, rank, window_total, CAST(floor(n * 100::DOUBLE / window_total + 0.5) AS BIGINT) AS pct FROM r WHERE rank <= 12""")
def ranked_corners(spark, sf):
    return ru.ranked_corners(_corners(spark, sf), "1998-01", "1999-06")


@query("break_audit", f"""WITH {t.INCIDENTS} SELECT district, ym AS month, count(*) FILTER (WHERE resolution = 'O' OR signal = '5-LOW') AS "union",
  count(*) FILTER (WHERE resolution = 'O') AS open_only, count(*) FILTER (WHERE signal = '5-LOW') AS low_only FROM inc GROUP BY ALL""")
def break_audit(spark, sf):
    parts = {"open_only": F.col("resolution") == "O", "low_only": F.col("signal") == "5-LOW"}
    a = ru.break_audit(t.incidents(spark, sf), parts, tk.month_start(F.col("day")), ["district"])
    return a.withColumn("month", F.date_format("period", "yyyy-MM")).drop("period")


@query("category_by_flag", f"WITH {t.REPORTS} SELECT signal, flag, count(*) AS n FROM rep GROUP BY ALL")
def category_by_flag(spark, sf):
    return ru.counts_by(t.reports(spark, sf), ["signal", "flag"])


@query("arrival_day_counts", f"WITH {t.REPORTS} SELECT CAST(load AS VARCHAR) AS load_day, count(*) AS n FROM rep GROUP BY ALL")
def arrival_day_counts(spark, sf):
    return ru.counts_by(t.reports(spark, sf), [F.col("load").cast("string").alias("load_day")])


@query("recent_months_table", f"""WITH {t.INCIDENTS} SELECT signal, district, count(*) FILTER (WHERE ym = '2001-05') AS "2001-05",
  count(*) FILTER (WHERE ym = '2001-06') AS "2001-06", count(*) FILTER (WHERE ym = '2001-07') AS "2001-07"
  FROM inc WHERE ym IN ('2001-05', '2001-06', '2001-07') GROUP BY ALL""")
def recent_months_table(spark, sf):
    return ru.recent_months_table(t.incidents(spark, sf), ["2001-05", "2001-06", "2001-07"], ["signal", "district"])


@query("excluded_category_yearly", f"""WITH {t.INCIDENTS} SELECT year(day) AS year, count(*) AS n FROM inc
  WHERE resolution = 'P' AND signal = '5-LOW' GROUP BY ALL""")
def excluded_category_yearly(spark, sf):
    rows = t.incidents(spark, sf)
    cond = (F.col("resolution") == "P") & (F.col("signal") == "5-LOW")
    return ru.counts_by(rows, [F.year("day").cast("long").alias("year")], cond)


_SCOPES = [
    {"scope": "asia_open_all", "district": "ASIA", "resolution": "O"},
    {"scope": "asia_open_urgent", "district": "ASIA", "resolution": "O", "signal": "1-URGENT"},
    {"scope": "asia_closed_all", "district": "ASIA", "resolution": "F"},
    {"scope": "citywide_open_all", "resolution": "O"},
]


def _scope_sql():
    rows = []
    for s in _SCOPES:
        cond = " AND ".join(f"{c} = '{s[c]}'" for c in ("district", "resolution", "signal") if c in s)
        rows.append(f"SELECT '{s['scope']}' AS scope, ym AS month, count(*) AS n FROM inc WHERE {cond} GROUP BY ALL")
    return " UNION ALL ".join(rows)


@query("scoped_subsets", f"WITH {t.INCIDENTS} {_scope_sql()}")
def scoped_subsets(spark, sf):
    rows = ru.scoped(t.incidents(spark, sf), _SCOPES, ["district", "resolution", "signal"])
    return ru.counts_by(rows, ["scope", F.col("ym").alias("month")])


@query("group_rows", """SELECT c_mktsegment AS segment, c_custkey AS id, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS BIGINT) AS pos,
  count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer""")
def group_rows(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    return ru.group_rows(c, "segment", ["id"])


@query("densify_sparse", f"""WITH {t.POINTS}, ax AS (SELECT CAST(unnest(generate_series(DATE '{t.EVENT_LO}', DATE '{t.EVENT_AS_OF}', INTERVAL 1 DAY)) AS DATE) AS d),
k AS (SELECT DISTINCT name, signal FROM pts), c AS (SELECT name, signal, day AS d, count(*) AS n FROM pts GROUP BY ALL)
SELECT name, signal, CAST(d AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k CROSS JOIN ax LEFT JOIN c USING (name, signal, d)""")
def densify_sparse(spark, sf):
    c = t.points(spark, sf).groupBy("name", "signal", F.col("day").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    lo, hi = (F.lit(x).cast("date") for x in (t.EVENT_LO, t.EVENT_AS_OF))
    c = materialize(c, "daily-places")
    d = ru.densify(c, c.select("name", "signal").distinct(), lo, hi, "day")
    return d.select("name", "signal", F.col("period").cast("string").alias("day"), "n")


@query("axis_pointers", f"""WITH {t.INCIDENTS}, m AS (SELECT max(day) AS d FROM inc)
SELECT strftime(date_trunc('month', d), '%Y-%m') AS current_partial, strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y-%m') AS latest_complete,
  strftime(date_trunc('month', d) - INTERVAL 2 MONTH, '%Y-%m') AS latest_settled,
  CAST(CAST(date_trunc('week', CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) - 7) AS DATE) AS VARCHAR) AS settled_week FROM m""")
def axis_pointers(spark, sf):
    m = t.incidents(spark, sf).agg(F.max("day").alias("d"))
    d = F.col("d")
    back = lambda n: F.date_format(tk.months_back(d, n), "yyyy-MM")
    return m.select(
        back(0).alias("current_partial"), back(1).alias("latest_complete"), back(2).alias("latest_settled"),
        ru.settled_week(tk.months_back(d, 2)).cast("string").alias("settled_week"),
    )

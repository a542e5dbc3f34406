"""Checks over the rollups; a passing check returns no rows, so each one also runs on a
damaged copy of its input."""

from pyspark.sql import functions as F

from ..functions.ranks import run_dir
from ..operators import hotspots as ho
from ..operators import quality as qu
from ..operators import rollup as ru
from ..sources import registry as rg
from ..sources import sinks as sk
from . import tables as t
from .catalog import query
from .hotspot_queries import FACTS, FLOOR, PLACED, _cube
from .rollup_queries import _both, _monthly
from .spatial_queries import _NB, _TOT, _neighbours, _totals

BOX = (t.SOUTH, t.WEST, t.NORTH, t.EAST)
_EMPTY = 'SELECT \'\' AS "check", \'\' AS entity, \'\' AS detail FROM region WHERE false'


@query("quality_pass", _EMPTY)
def quality_pass(spark, sf):
    """Every structural check on the real series: no violations."""
    m, w = _both(spark, sf)
    months = ru.date_axis(spark, t.LO, t.AS_OF)
    weeks = ru.date_axis(spark, t.LO, t.AS_OF, "week")
    checks = [
        qu.axis_gaps(months), qu.axis_gaps(weeks, "week"), qu.sparse_series(m, 80), qu.sparse_series(w, 347),
        qu.citywide_below_sum(m), qu.citywide_below_sum(w), qu.axis_prefix(months.where("idx < 70"), months),
        qu.split_mismatch(ru.granular_split(t.incidents(spark, sf), ["signal"]), ["morning", "afternoon", "evening", "night"], "total", ["signal"]),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _damaged(spark, sf):
    """Series with whole years lost, one negative value per signal and a Citywide that misses
    open incidents."""
    m = _monthly(spark, sf)
    year = F.year("period")
    low = (F.col("label") == "Citywide") & (F.month("period") == 3)
    return m.where(~((F.col("label") == "ASIA") & (year == 1996))).withColumn(
        "n", F.when((F.col("label") == "EUROPE") & (F.col("idx") == 5), -1).when(low, F.lit(0)).otherwise(F.col("n"))
    )


_DAMAGED = f"""{t.SERIES}, dm AS (SELECT signal, label, idx, period, CASE WHEN label = 'EUROPE' AND idx = 5 THEN -1 WHEN label = 'Citywide' AND month(period) = 3 THEN 0 ELSE n END AS n
  FROM s WHERE NOT (label = 'ASIA' AND year(period) = 1996))"""


@query("axis_checks", f"""WITH {_DAMAGED}, p AS (SELECT period, lead(period) OVER (ORDER BY period) AS nx FROM (SELECT DISTINCT period FROM dm WHERE label = 'ASIA'))
SELECT 'axis_gap' AS "check", CAST(period AS VARCHAR) AS entity, CAST(nx AS VARCHAR) AS detail FROM p WHERE nx <> period + INTERVAL 1 MONTH""")
def axis_checks(spark, sf):
    return qu.axis_gaps(_damaged(spark, sf).where("label = 'ASIA'").select("period").distinct())


@query("pointer_checks", f"""WITH {t.SERIES}, p AS (SELECT DISTINCT period FROM s), x AS (SELECT DISTINCT day AS period, 'day' || CAST(day AS VARCHAR) AS name FROM inc)
SELECT 'pointer_off_axis' AS "check", name AS entity, CAST(period AS VARCHAR) AS detail FROM x WHERE period NOT IN (SELECT period FROM p)""")
def pointer_checks(spark, sf):
    pointers = t.incidents(spark, sf).select("day").distinct().select(F.concat(F.lit("day"), F.col("day").cast("string")).alias("name"), F.col("day").alias("period"))
    return qu.off_axis(pointers, ru.date_axis(spark, t.LO, t.AS_OF))


@query("series_shape", f"""WITH {_DAMAGED}, g AS (SELECT signal, label, count(*) AS r, count(*) FILTER (WHERE n < 0) AS b FROM dm GROUP BY ALL)
SELECT 'series_shape' AS "check", signal || '/' || label AS entity, CAST(r AS VARCHAR) || ' ' || CAST(b AS VARCHAR) AS detail FROM g WHERE r <> 80 OR b > 0""")
def series_shape(spark, sf):
    return qu.sparse_series(_damaged(spark, sf), 80)


@query("citywide_ge_sum", f"""WITH {_DAMAGED}, g AS (SELECT signal, period, CAST(sum(n) FILTER (WHERE label = 'Citywide') AS BIGINT) AS c, CAST(sum(n) FILTER (WHERE label <> 'Citywide') AS BIGINT) AS p FROM dm GROUP BY ALL)
SELECT 'citywide_below_sum' AS "check", signal || '/' || CAST(period AS VARCHAR) AS entity, CAST(c AS VARCHAR) || ' < ' || CAST(p AS VARCHAR) AS detail FROM g WHERE c < p""")
def citywide_ge_sum(spark, sf):
    return qu.citywide_below_sum(_damaged(spark, sf))


@query("set_checks", f"""WITH {t.INCIDENTS}, a AS (SELECT DISTINCT district AS d FROM inc), b AS (SELECT DISTINCT r_name AS d FROM region WHERE r_regionkey > 0 UNION SELECT 'ATLANTIS')
SELECT 'set_equal' AS "check", d AS entity, 'missing right' AS detail FROM a WHERE d NOT IN (SELECT d FROM b) UNION ALL SELECT 'set_equal', d, 'missing left' FROM b WHERE d NOT IN (SELECT d FROM a)
UNION ALL SELECT 'set_subset', d, 'missing right' FROM a WHERE d NOT IN (SELECT d FROM b)""")
def set_checks(spark, sf):
    a = t.incidents(spark, sf).select("district")
    known = t.table(spark, sf, "region").where("r_regionkey > 0").select(F.col("r_name").alias("district"))
    b = known.unionByName(spark.range(1).select(F.lit("ATLANTIS").alias("district")))
    return qu.set_check(a, b, "district").unionByName(qu.set_check(a, b, "district", "subset"))


@query("axis_prefix", f"""WITH {t.SERIES}, p AS (SELECT DISTINCT idx, period FROM s), q AS (SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx FROM p WHERE period >= DATE '1999-01-01')
SELECT 'axis_prefix' AS "check", CAST(q.idx AS VARCHAR) AS entity, CAST(q.period AS VARCHAR) AS detail FROM q LEFT JOIN p USING (idx) WHERE q.period IS DISTINCT FROM p.period""")
def axis_prefix(spark, sf):
    full = _monthly(spark, sf).select("idx", "period").distinct()
    late = full.where("period >= date'1999-01-01'").withColumn("idx", F.col("idx") - 48)
    return qu.axis_prefix(late, full)


@query("cell_checks", f"""WITH {PLACED}, {FACTS}, c AS (SELECT signal, cy, cx, total, district, lat_e5, lng_e5, total + CASE WHEN total > 25 THEN 1 ELSE 0 END AS ms FROM facts),
v AS (SELECT 'months_over_total' AS "check", * FROM c WHERE ms > total UNION ALL SELECT 'bad_district', * FROM c WHERE district NOT IN ('AFRICA', 'ASIA', 'EUROPE') UNION ALL SELECT 'outside_box', * FROM c WHERE lat_e5 > {t.NORTH - 500})
SELECT "check", signal || '/' || CAST(cy AS VARCHAR) || '/' || CAST(cx AS VARCHAR) AS entity, district AS detail FROM v""")
def cell_checks(spark, sf):
    c = ho.cell_facts(_cube(spark, sf), FLOOR)
    c = c.withColumn("month_sum", F.col("total") + F.when(F.col("total") > 25, 1).otherwise(0)).withColumn("category", F.lit(None).cast("string"))
    return qu.bad_cells(c, ["AFRICA", "ASIA", "EUROPE"], (t.SOUTH - 1000, t.WEST - 1000, t.NORTH - 500, t.EAST + 1000))


@query("provenance_checks", f"WITH {t.INCIDENTS} SELECT 'no_records' AS \"check\", s AS entity, '0' AS detail FROM (SELECT unnest({t.SIGNAL_LIST[:-1]}, 'unused']) AS s) WHERE s NOT IN (SELECT signal FROM inc)")
def provenance_checks(spark, sf):
    reg = rg.Registry(tuple(rg.Signal(s, "incidents", lambda s=s: F.col("signal") == s, "id", "day") for s in (*t.SIGNALS, "unused")))
    return qu.empty_provenance(sk.provenance(t.incidents(spark, sf), reg))


@query("split_checks", f"""WITH {t.INCIDENTS} SELECT 'split_mismatch' AS "check", signal || '/' || district AS entity, CAST(count(*) AS VARCHAR) AS detail FROM inc GROUP BY signal, district
  HAVING count(*) FILTER (WHERE hour BETWEEN 6 AND 21) <> count(*)""")
def split_checks(spark, sf):
    g = ru.granular_split(t.incidents(spark, sf), ["signal", "district"])
    return qu.split_mismatch(g, ["morning", "afternoon", "evening"], "total", ["signal", "district"])


_OLD = f"""{t.REPORTS}, nw AS (SELECT signal, CAST(date_trunc('month', incident) AS DATE) AS period, count(*) AS n FROM rep GROUP BY ALL),
od AS (SELECT signal, CAST(date_trunc('month', incident) AS DATE) AS period, count(*) AS n FROM rep WHERE soon <= DATE '2001-05-10' GROUP BY ALL)"""


def _snapshots(spark, sf):
    """Committed = reports filed by a past day; rebuilt = all of them."""
    r = t.reports(spark, sf).withColumn("period", F.trunc("incident", "MM"))
    count = lambda df: df.groupBy("signal", "period").agg(F.count(F.lit(1)).alias("n"))
    return count(r.where("soon <= date'2001-05-10'")), count(r)


@query("reconcile", f"""WITH {_OLD}, j AS (SELECT od.signal, od.period, od.n AS baked, nw.n AS source, max(od.period) OVER (PARTITION BY od.signal) AS last FROM od JOIN nw ON od.signal = nw.signal AND od.period = nw.period),
p AS (SELECT *, abs(source - baked) / source::DOUBLE AS pct FROM j WHERE period <= DATE '2001-04-01')
SELECT signal, strftime(period, '%Y-%m') AS month, baked, source, source - baked AS diff, round(pct, 6) AS pct, pct <= CASE WHEN period > last - INTERVAL 4 MONTH THEN 0.02::DOUBLE ELSE 0.0 END AS ok FROM p""")
def reconcile(spark, sf):
    old, new = _snapshots(spark, sf)
    r = qu.reconcile(old, new, ["signal"], F.lit("2001-04-01").cast("date"))
    return r.select("signal", t.month(), "baked", "source", "diff", F.round("pct", 6).alias("pct"), "ok")


@query("snapshot_diff", f"""WITH {_OLD}, j AS (SELECT coalesce(od.signal, nw.signal) AS signal, coalesce(od.period, nw.period) AS period, od.n AS o, nw.n AS w FROM od FULL OUTER JOIN nw ON od.signal = nw.signal AND od.period = nw.period)
SELECT signal, strftime(period, '%Y-%m') AS month, o AS "old", w AS "new", CASE WHEN o IS NULL THEN 'new' WHEN w IS NULL THEN 'gone' WHEN o = 0 AND w <> 0 THEN 'new activity' WHEN o = w THEN 'same' ELSE 'changed' END AS state,
  round((w - o) / nullif(o, 0)::DOUBLE, 6) AS pct, coalesce(abs((w - o) / nullif(o, 0)::DOUBLE) > 0.4, false) AS cliff FROM j""")
def snapshot_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    d = qu.snapshot_diff(old, new, ["signal", "period"])
    return d.select("signal", t.month(), "old", "new", "state", F.round("pct", 6).alias("pct"), "cliff")


@query("stop_checks", f"""WITH {_TOT}, {_NB[_NB.index('nb AS'):]}, b AS (SELECT * FROM stops WHERE lat_e5 > {t.NORTH - 700})
SELECT 'outside_box' AS "check", CAST(id AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS detail FROM b
UNION ALL SELECT 'negative_total', CAST(id AS VARCHAR), CAST(t12 - 8 AS VARCHAR) FROM tot WHERE t12 < 8
UNION ALL SELECT 'sheltered_count', 'stops', CAST(count(*) FILTER (WHERE shelter) AS VARCHAR) FROM stops UNION ALL SELECT 'not_in_feed', 'stops', CAST(count(*) FILTER (WHERE id % 9 = 0) AS VARCHAR) FROM stops
UNION ALL SELECT 'not_in_shards', CAST(id AS VARCHAR), NULL FROM stops WHERE id % 31 = 0 UNION ALL SELECT 'private_column', 'email', 'present'""")
def stop_checks(spark, sf):
    """All gates of the stop table: some stops are left out of the shards, and a private column is left in."""
    stops = t.stops(spark, sf).withColumn("in_feed", F.col("id") % 9 != 0)
    totals = _totals(spark, sf).withColumn("t12", F.col("t12") - 8)
    box = (t.SOUTH - 1, t.WEST - 1, t.NORTH - 700, t.EAST + 1)
    path = run_dir(spark, "shards")
    sk.write_sharded(stops.where("id % 31 <> 0").select("id", "name"), path)
    shards = spark.read.schema("id bigint, name string, shard string").parquet(path)
    private = qu.leaked_columns(stops.withColumn("email", F.lit("a@b.org")), sk.PRIVATE_COLUMNS, spark)
    return qu.bad_stops(stops, _neighbours(spark, sf), totals, box, sheltered=(-2, -1)).unionByName(qu.shard_cover(stops, shards)).unionByName(private)


@query("cliff_flags", f"""WITH {t.SERIES}, p AS (SELECT *, lag(n) OVER (PARTITION BY signal, label ORDER BY idx) AS l FROM s)
SELECT signal, label, month, coalesce(abs((n - l)::DOUBLE / nullif(l, 0)) > 0.4, false) AS cliff FROM p""")
def cliff_flags(spark, sf):
    from ..operators import series as se

    s = se.compare_month(_monthly(spark, sf))
    return s.select("signal", "label", t.month(), qu.cliff_flag(F.col("vs_last")).alias("cliff"))

"""Reporting lag, completeness, cohorts."""

from pyspark.sql import functions as F

from ..functions import timekeys as tk
from ..functions.ranks import materialize
from ..operators import settling as st
from . import tables as t
from .catalog import query
from .rollup_queries import _monthly

AS_OF = t.AS_OF


def _soon(spark, sf):
    return st.lags(t.reports(spark, sf), "incident", "soon")


def _all_lags(spark, sf):
    return st.lags(t.reports(spark, sf), "incident", "report", st.reference_window(AS_OF))


def _stats_sql(source, keys, within, pcts, digits=0):
    """Percentile by position in the sorted lags: value number min(n, floor(p n / 100) + 1)."""
    k = ", ".join(keys) + (", " if keys else "")
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    ps = ", ".join(f"max(lag) FILTER (WHERE rn = least(n, CAST(floor({p} * n / 100.0) AS BIGINT) + 1)) AS p{p}_days" for p in pcts)
    rnd = "CAST(round_even(100 * (count(*) FILTER (WHERE lag <= {d})::DOUBLE / max(n)), 0) AS BIGINT)" if digits == 0 else \
        "round(count(*) FILTER (WHERE lag <= {d})::DOUBLE / max(n) * 100, 1)"
    ws = ", ".join(rnd.format(d=d) + f" AS within_{d}_pct" for d in within)
    return f"""SELECT {k}max(n) AS n, {ps}, {ws} FROM (SELECT {k}lag, row_number() OVER ({part}ORDER BY lag) AS rn,
  count(*) OVER ({part}) AS n FROM {source}) {'GROUP BY ' + ', '.join(keys) if keys else ''}"""


_SOON = f"{t.REPORTS}, lags AS (SELECT *, date_diff('day', incident, soon) AS lag FROM rep)"
_REF = f"""{t.REPORTS}, lags AS (SELECT *, date_diff('day', incident, report) AS lag FROM rep
  WHERE incident >= DATE '1999-08-01' AND incident < DATE '2000-08-01' AND report >= incident)"""


@query("lag_stats", f"WITH {_REF} {_stats_sql('lags', ['resolution'], (7, 30, 60), (50, 90))}")
def lag_stats(spark, sf):
    return st.lag_stats(_all_lags(spark, sf), ["resolution"])


@query("lag_stats_by_category", f"WITH {_SOON} {_stats_sql('lags', ['signal', 'flag'], (14, 30, 45, 60), (50, 90, 95), 1)}")
def lag_stats_by_category(spark, sf):
    return st.lag_stats(_soon(spark, sf), ["signal", "flag"], (14, 30, 45, 60), (50, 90, 95), decimals=1)


_CDF = f"""{_SOON}, h AS (SELECT signal, lag AS k, count(*) AS c FROM lags GROUP BY ALL),
tot AS (SELECT signal, sum(c) AS n FROM h GROUP BY ALL), gr AS (SELECT signal, n, CAST(kk AS INTEGER) AS k FROM tot CROSS JOIN (SELECT unnest(range(121)) AS kk)),
cdf AS (SELECT signal, gr.k, round(coalesce((SELECT sum(c) FROM h WHERE h.signal = gr.signal AND h.k <= gr.k), 0)::DOUBLE / n, 6) AS f FROM gr)"""


def _cdf(spark, sf):
    return materialize(st.lag_cdf(_soon(spark, sf), ["signal"]), "cdf")


@query("lag_cdf", f"WITH {_CDF} SELECT signal, k, f FROM cdf")
def lag_cdf(spark, sf):
    return st.lag_cdf(_soon(spark, sf), ["signal"])


_AGES = f"""ages AS (SELECT signal, m AS period, date_diff('day', last_day(m), DATE '{AS_OF}') AS delta, day(last_day(m)) AS dd
  FROM (SELECT DISTINCT signal FROM cdf) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS m)),
comp AS (SELECT a.signal, a.period, sum(f) / max(dd) AS completeness FROM (SELECT *, unnest(range(dd)) AS j FROM ages) a
  JOIN cdf c ON c.signal = a.signal AND c.k = least(a.delta + a.j, 120) GROUP BY ALL)"""


@query("month_completeness", f"WITH {_CDF}, {_AGES} SELECT signal, strftime(period, '%Y-%m') AS month, round(completeness, 6) AS completeness FROM comp")
def month_completeness(spark, sf):
    cdf = _cdf(spark, sf)
    months = tk.month_steps(F.lit("2001-01-01").cast("date"), F.lit("2001-07-01").cast("date"))
    ages = st.month_ages(cdf.select("signal").distinct().withColumn("period", F.explode(months)), AS_OF)
    c = st.month_completeness(cdf, ages, ["signal"])
    return c.select("signal", t.month(), F.round("completeness", 6).alias("completeness"))


def _grid_comp(deltas: str) -> str:
    return f"""gc AS (SELECT a.signal, a.delta, sum(f) / 30::DOUBLE AS completeness FROM (SELECT signal, delta, unnest(range(30)) AS j
  FROM (SELECT DISTINCT signal FROM cdf) CROSS JOIN (SELECT unnest({deltas}) AS delta)) a JOIN cdf c ON c.signal = a.signal AND c.k = least(a.delta + a.j, 120) GROUP BY ALL)"""


@query("missing_by_age", f"WITH {_CDF}, {_grid_comp('[0, 3, 6, 9, 12, 15, 18, 21, 25, 30, 37]')} SELECT signal, delta, round((1 - completeness) * 100, 4) AS missing_pct FROM gc")
def missing_by_age(spark, sf):
    m = st.missing_by_age(_cdf(spark, sf), ["signal"])
    return m.select("signal", "delta", F.round("missing_pct", 4).alias("missing_pct"))


@query("days_to_threshold", f"""WITH {_CDF}, {_grid_comp('range(90)')} SELECT signal, threshold, min(delta) FILTER (WHERE completeness >= threshold) AS days
  FROM gc CROSS JOIN (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, 0.9901::DOUBLE]) AS threshold) GROUP BY ALL""")
def days_to_threshold(spark, sf):
    return st.days_to_threshold(_cdf(spark, sf), ["signal"], (0.9, 0.95, 0.9901))


@query("settled_month", f"""WITH {_CDF}, {_AGES}, x AS (SELECT signal, max(completeness) FILTER (WHERE period = DATE '2001-07-01') AS a,
  max(completeness) FILTER (WHERE period = DATE '2001-06-01') AS b FROM comp GROUP BY ALL)
SELECT signal, '2001-07' AS latest_complete, round(a, 6) AS latest_completeness, CASE WHEN a >= 0.985 THEN '2001-07' ELSE '2001-06' END AS latest_settled,
  round(CASE WHEN a >= 0.985 THEN a ELSE b END, 6) AS settled_completeness, CASE WHEN a >= 0.985 THEN 0 ELSE 1 END AS settle_lag_months FROM x""")
def settled_month(spark, sf):
    s = st.settled_month(_cdf(spark, sf), ["signal"], AS_OF)
    return s.select(
        "signal", F.date_format("latest_complete", "yyyy-MM").alias("latest_complete"),
        F.round("latest_completeness", 6).alias("latest_completeness"),
        F.date_format("latest_settled", "yyyy-MM").alias("latest_settled"),
        F.round("settled_completeness", 6).alias("settled_completeness"), "settle_lag_months",
    )


_MONTHS, _DAYS = (0, 1, 2, 3), (0, 7, 14, 30, 45, 60, 90)


def _cohort_sql(grid, unit):
    hor = "last_day(m) + CAST(h AS INTEGER)" if unit == "day" else "last_day(m + to_months(CAST(h AS INTEGER)))"
    return f"""{t.REPORTS}, co AS (SELECT signal, CAST(date_trunc('month', incident) AS DATE) AS m, soon FROM rep),
mature AS (SELECT * FROM co WHERE date_diff('day', last_day(m), DATE '{AS_OF}') >= 180),
cc AS (SELECT signal, m, h, count(*) AS final, count(*) FILTER (WHERE soon <= {hor}) AS filed FROM mature CROSS JOIN (SELECT unnest({list(grid)}) AS h) GROUP BY ALL),
comp AS (SELECT *, filed / final::DOUBLE AS completion FROM cc)"""


def _completion(spark, sf, grid, unit):
    rows = st.cohorts(t.reports(spark, sf), "incident", "soon", AS_OF, ["signal"])
    return st.cohort_completion(rows, ["signal"], grid, unit)


@query("cohort_completion", f"WITH {_cohort_sql(_MONTHS, 'month')} SELECT signal, strftime(m, '%Y-%m') AS month, h, final, filed, round(completion, 6) AS completion FROM comp")
def cohort_completion(spark, sf):
    c = _completion(spark, sf, _MONTHS, "month")
    return c.select("signal", t.month("cohort"), "h", "final", "filed", F.round("completion", 6).alias("completion"))


@query("cohort_completion_days", f"WITH {_cohort_sql(_DAYS, 'day')} SELECT signal, strftime(m, '%Y-%m') AS month, h, final, filed, round(completion, 6) AS completion FROM comp")
def cohort_completion_days(spark, sf):
    c = _completion(spark, sf, _DAYS, "day")
    return c.select("signal", t.month("cohort"), "h", "final", "filed", F.round("completion", 6).alias("completion"))


def _summary_sql():
    pick = lambda p: f"round(max(completion) FILTER (WHERE rn = least(n, CAST(floor({p} * n / 100.0) AS BIGINT) + 1)), 4) AS p{p}"
    return f"""{_cohort_sql(_MONTHS, 'month')}, rk AS (SELECT *, row_number() OVER (PARTITION BY signal, h ORDER BY completion) AS rn,
  count(*) OVER (PARTITION BY signal, h) AS n FROM comp),
sm AS (SELECT signal, h, max(n) AS n, round(avg(completion), 4) AS mean, round(stddev_pop(completion), 4) AS sd, {pick(10)}, {pick(50)}, {pick(90)},
  round(min(completion), 4) AS "min", round(max(completion), 4) AS "max", round(1 / avg(completion), 4) AS uplift FROM rk GROUP BY signal, h)"""


def _summary(spark, sf):
    return st.cohort_summary(_completion(spark, sf, _MONTHS, "month"), ["signal"])


@query("cohort_summary", f"WITH {_summary_sql()} SELECT * FROM sm")
def cohort_summary(spark, sf):
    return _summary(spark, sf)


@query("completion_by_year", f"WITH {_cohort_sql(_MONTHS, 'month')} SELECT signal, CAST(year(m) AS INTEGER) AS year, h, count(*) AS cohorts, round(avg(completion), 4) AS mean FROM comp GROUP BY ALL")
def completion_by_year(spark, sf):
    return st.completion_by_year(_completion(spark, sf, _MONTHS, "month"), ["signal"])


@query("reporting_triangle", f"""WITH {_cohort_sql(_MONTHS, 'month')} SELECT signal, strftime(m, '%Y-%m') AS month, final,
  max(filed) FILTER (WHERE h = 0) AS h0, max(filed) FILTER (WHERE h = 1) AS h1, max(filed) FILTER (WHERE h = 2) AS h2, max(filed) FILTER (WHERE h = 3) AS h3
  FROM comp GROUP BY signal, m, final""")
def reporting_triangle(spark, sf):
    r = st.reporting_triangle(_completion(spark, sf, _MONTHS, "month"), ["signal"], _MONTHS)
    return r.select("signal", t.month("cohort"), "final", *[f"h{h}" for h in _MONTHS])


@query("confidence_verdict", f"""WITH {_summary_sql()} SELECT signal, mean, round(p90 - p10, 4) AS spread,
  CASE WHEN round(p90 - p10, 4) <= 0.05 THEN 'high' ELSE 'moderate' END AS level, round((uplift - 1) * 100, 1) AS expected_increase_pct FROM sm WHERE h = 1""")
def confidence_verdict(spark, sf):
    return st.confidence(_summary(spark, sf)).select("signal", "mean", "spread", "level", "expected_increase_pct")


@query("projected_final", f"""WITH {_summary_sql().replace('comp AS', 'comp AS')}, act AS (SELECT o_orderpriority AS signal, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT a.*, date_diff('month', period, DATE '2001-08-01') - 1 AS age FROM act a)
SELECT g.signal, strftime(period, '%Y-%m') AS month, g.n, CAST(age AS INTEGER) AS age, round(g.n * uplift, 4) AS projected FROM g JOIN sm ON sm.signal = g.signal AND sm.h = age""")
def projected_final(spark, sf):
    s = _monthly(spark, sf).where("label = 'Citywide' and n > 0").select("signal", "period", "n")
    p = st.projected_final(s, _summary(spark, sf), AS_OF, ["signal"])
    return p.select("signal", t.month(), "n", "age", F.round("projected", 4).alias("projected"))


@query("publication_delta", f"""WITH {t.REPORTS}, d AS (SELECT load, count(*) AS c FROM rep GROUP BY ALL), top AS (SELECT load, c FROM d ORDER BY c DESC, load LIMIT 1),
lags AS (SELECT date_diff('day', report, rep.load) AS lag FROM rep WHERE rep.load > (SELECT load FROM top) AND rep.load >= report)
SELECT st.*, CAST(top.load AS VARCHAR) AS reload_date, top.c AS reload_rows FROM ({_stats_sql('lags', [], (2, 7), (50, 90))}) st CROSS JOIN top""")
def publication_delta(spark, sf):
    p = st.publication_delta(t.reports(spark, sf), "report", "load")
    return p.withColumn("reload_date", F.col("reload_date").cast("string"))

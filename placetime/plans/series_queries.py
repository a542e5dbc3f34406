"""Metrics over the dense monthly and weekly series."""

from pyspark.sql import functions as F

from ..functions import timekeys as tk
from ..functions.joins import param_array
from ..functions.numbers import half_up
from ..operators import rollup as ru
from ..operators import series as se
from . import tables as t
from .catalog import query
from .rollup_queries import _both, _monthly, _weekly

W = "OVER (PARTITION BY signal, label ORDER BY idx)"


def _sum(k: int, back: int = 0) -> str:
    hi = f"{back} PRECEDING" if back else "CURRENT ROW"
    return (
        f"CASE WHEN idx >= {k - 1 + back} THEN sum(n) OVER (PARTITION BY signal, label ORDER BY idx "
        f"ROWS BETWEEN {k - 1 + back} PRECEDING AND {hi}) END"
    )


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST({a} - {b} AS DOUBLE) / {b} END"


BASE = "signal, label, month"


@query("yoy", f"WITH {t.SERIES}, y AS (SELECT *, lag(n, 12) {W} AS prior FROM s) SELECT {BASE}, n, prior, round({_pct('n', 'prior')}, 6) AS pct FROM y")
def yoy(spark, sf):
    return se.yoy(_monthly(spark, sf)).select("signal", "label", t.month(), "n", "prior", F.round("pct", 6).alias("pct"))


@query("trailing12", f"WITH {t.SERIES} SELECT {BASE}, CAST({_sum(12)} AS BIGINT) AS t12_sum, round(({_sum(12)}) / 12.0::DOUBLE, 6) AS t12_avg FROM s")
def trailing12(spark, sf):
    return se.trailing12(_monthly(spark, sf)).select("signal", "label", t.month(), "t12_sum", F.round("t12_avg", 6).alias("t12_avg"))


@query("trend12", f"""WITH {t.SERIES}, a AS (SELECT *, ({_sum(12)}) / 12.0::DOUBLE AS x, ({_sum(12, 12)}) / 12.0::DOUBLE AS y FROM s)
SELECT {BASE}, round(CASE WHEN y <> 0 THEN x END, 6) AS trend_now, round(CASE WHEN y <> 0 THEN y END, 6) AS trend_prev,
  round(CASE WHEN y <> 0 THEN (x - y) / y END, 6) AS trend_pct FROM a""")
def trend12(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return se.trend12(_monthly(spark, sf)).select("signal", "label", t.month(), r("trend_now"), r("trend_prev"), r("trend_pct"))


@query("trailing_yoy", f"""WITH {t.SERIES}, a AS (SELECT *, {_sum(12)} AS x, {_sum(12, 12)} AS y FROM s)
SELECT {BASE}, CAST(x AS BIGINT) AS t12, CAST(y AS BIGINT) AS t12_prior, round({_pct('x', 'y')}, 6) AS t12_pct FROM a""")
def trailing_yoy(spark, sf):
    return se.trailing_yoy(_monthly(spark, sf)).select("signal", "label", t.month(), "t12", "t12_prior", F.round("t12_pct", 6).alias("t12_pct"))


@query("prior_year_line", f"WITH {t.SERIES} SELECT {BASE}, n, lag(n, 12) {W} AS prior_year FROM s")
def prior_year_line(spark, sf):
    return se.prior_year_line(_monthly(spark, sf)).select("signal", "label", t.month(), "n", "prior_year")


@query("momentum", f"""WITH {t.SERIES}, a AS (SELECT *, {_sum(1)} AS a1, {_sum(1, 1)} AS b1, {_sum(3)} AS a3, {_sum(3, 3)} AS b3,
  {_sum(12)} AS a12, {_sum(12, 12)} AS b12 FROM s)
SELECT {BASE}, round({_pct('a1', 'b1')}, 6) AS mom_1, round({_pct('a3', 'b3')}, 6) AS mom_3, round({_pct('a12', 'b12')}, 6) AS mom_12 FROM a""")
def momentum(spark, sf):
    m = se.momentum(_monthly(spark, sf))
    return m.select("signal", "label", t.month(), *[F.round(f"mom_{h}", 6).alias(f"mom_{h}") for h in (1, 3, 12)])


PRESETS = se.window_presets(latest=78, split_idx=47)
_PRESET_SQL = "p AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p['preset']}', {p['lo']}, {p['hi']})" for p in PRESETS) + ") AS v(preset, lo, hi))"
_WSUMS = f"""{t.SERIES}, {_PRESET_SQL}, ws AS (SELECT signal, label, preset, lo, hi,
  CAST(coalesce(sum(n) FILTER (WHERE idx BETWEEN lo AND hi), 0) AS BIGINT) AS cur,
  CASE WHEN lo >= 12 THEN CAST(coalesce(sum(n) FILTER (WHERE idx BETWEEN lo - 12 AND hi - 12), 0) AS BIGINT) END AS prior
  FROM s CROSS JOIN p GROUP BY signal, label, preset, lo, hi)"""


@query("window_yoy", f"WITH {_WSUMS} SELECT signal, label, preset, cur, prior, round({_pct('cur', 'prior')}, 6) AS pct FROM ws")
def window_yoy(spark, sf):
    w = se.window_sums(_monthly(spark, sf), PRESETS)
    return w.select("signal", "label", "preset", "cur", "prior", F.round("pct", 6).alias("pct"))


@query("window_share", f"""WITH {_WSUMS}, x AS (SELECT *, max(CASE WHEN label = 'Citywide' THEN cur END) OVER (PARTITION BY signal, preset) AS city FROM ws)
SELECT signal, label, preset, round(CAST(cur AS DOUBLE) / nullif(city, 0), 6) AS share FROM x WHERE label <> 'Citywide'""")
def window_share(spark, sf):
    w = se.window_share(se.window_sums(_monthly(spark, sf), PRESETS))
    return w.select("signal", "label", "preset", F.round("share", 6).alias("share"))


@query("shares", f"""WITH {t.SERIES}, x AS (SELECT a.*, c.n AS city FROM s a JOIN s c ON a.signal = c.signal AND a.period = c.period
  AND c.label = 'Citywide' WHERE a.label <> 'Citywide'),
y AS (SELECT *, sum(n) OVER w AS rn, sum(city) OVER w AS rc, sum(n) OVER z AS an, sum(city) OVER z AS ac, sum(n) OVER q AS tn, sum(city) OVER q AS tc
  FROM x WINDOW w AS (PARTITION BY signal, label ORDER BY idx), z AS (PARTITION BY signal, label),
  q AS (PARTITION BY signal, label ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT {BASE}, round(n::DOUBLE / nullif(city, 0), 6) AS share, round(rn::DOUBLE / nullif(rc, 0), 6) AS share_to_date,
  round(an::DOUBLE / nullif(ac, 0), 6) AS share_all_time, CASE WHEN idx >= 11 THEN round(tn::DOUBLE / nullif(tc, 0), 6) END AS share_t12 FROM y""")
def shares(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return se.share(_monthly(spark, sf)).select("signal", "label", t.month(), r("share"), r("share_to_date"), r("share_all_time"), r("share_t12"))


@query("share_arrow", f"""WITH {t.SERIES}, x AS (SELECT a.*, c.n AS city FROM s a JOIN s c ON a.signal = c.signal AND a.period = c.period
  AND c.label = 'Citywide' WHERE a.label <> 'Citywide'),
y AS (SELECT *, n::DOUBLE / nullif(city, 0) AS sh, sum(n) OVER z::DOUBLE / nullif(sum(city) OVER z, 0) AS al FROM x WINDOW z AS (PARTITION BY signal, label)),
z AS (SELECT *, floor(sh * 100 + 0.5) AS a, floor(al * 100 + 0.5) AS b FROM y)
SELECT {BASE}, CASE WHEN a IS NULL OR b IS NULL THEN '' WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS arrow FROM z""".replace("sum(n) OVER z::DOUBLE", "CAST(sum(n) OVER z AS DOUBLE)"))
def share_arrow(spark, sf):
    s = se.share(_monthly(spark, sf))
    return s.select("signal", "label", t.month(), se.share_arrow(F.col("share"), F.col("share_all_time")).alias("arrow"))


@query("compare_refs", f"""WITH {t.SERIES}, a AS (SELECT *, lag(n, 1) {W} AS l1, lag(n, 12) {W} AS l12,
  sum(n) OVER (PARTITION BY signal, label ORDER BY idx) AS run FROM s)
SELECT {BASE}, round({_pct('n', 'l1')}, 6) AS vs_last, round({_pct('n', 'l12')}, 6) AS vs_year,
  round(CASE WHEN run <> 0 THEN CAST(n * (idx + 1) - run AS DOUBLE) / run END, 6) AS vs_avg, round(run / (idx + 1)::DOUBLE, 6) AS avg_to_date FROM a""")
def compare_refs(spark, sf):
    c = se.compare_to_average(se.compare_month(_monthly(spark, sf)))
    r = lambda x: F.round(x, 6).alias(x)
    return c.select("signal", "label", t.month(), r("vs_last"), r("vs_year"), r("vs_avg"), r("avg_to_date"))


_TREND = f"""{t.SERIES}, a AS (SELECT *, {_sum(12)} AS x, {_sum(12, 12)} AS y FROM s),
tr AS (SELECT *, CASE WHEN signal IN ('1-URGENT', '2-HIGH') THEN 'up' ELSE 'down' END AS goal,
  CASE WHEN y <> 0 THEN (x / 12.0::DOUBLE - y / 12.0::DOUBLE) / (y / 12.0::DOUBLE) END AS p, {_pct('x', 'y')} AS q FROM a)"""


def _goal():
    return F.when(F.col("signal").isin("1-URGENT", "2-HIGH"), "up").otherwise("down")


@query("verdicts", f"""WITH {_TREND} SELECT {BASE}, goal, CASE WHEN p IS NULL THEN 'Not enough history'
  WHEN goal = 'up' AND p > 0.05 THEN 'Rising — good' WHEN goal = 'down' AND p < -0.05 THEN 'Improving'
  WHEN goal = 'up' AND p < -0.05 THEN 'Falling short' WHEN goal = 'down' AND p > 0.05 THEN 'Worsening' ELSE 'Little change' END AS verdict FROM tr""")
def verdicts(spark, sf):
    s = se.trend12(_monthly(spark, sf)).withColumn("goal", _goal())
    return s.select("signal", "label", t.month(), "goal", se.verdict(F.col("trend_pct"), F.col("goal")).alias("verdict"))


@query("trend_verdicts", f"""WITH {_TREND} SELECT {BASE}, CASE WHEN q <= -0.05 THEN 'Improving' WHEN q >= 0.05 THEN 'Worsening' ELSE 'Little change' END AS label_text,
  CASE WHEN q <= -0.05 THEN 'good' WHEN q >= 0.05 THEN 'bad' ELSE 'flat' END AS tone FROM tr""")
def trend_verdicts(spark, sf):
    label, tone = se.trend_verdict(F.col("t12_pct"))
    return se.trailing_yoy(_monthly(spark, sf)).select("signal", "label", t.month(), label.alias("label_text"), tone.alias("tone"))


@query("goal_tones", f"""WITH {_TREND}, b AS (SELECT *, {_pct('n', 'l12')} AS c FROM (SELECT *, lag(n, 12) {W} AS l12 FROM tr))
SELECT {BASE}, CASE WHEN c > 0.005 THEN 'up' WHEN c < -0.005 THEN 'down' ELSE 'flat' END AS delta,
  CASE WHEN c IS NULL OR abs(c) < 0.005 THEN 'flat' WHEN (goal = 'up' AND c > 0) OR (goal = 'down' AND c < 0) THEN 'good' ELSE 'bad' END AS tone,
  CASE WHEN c IS NULL THEN 'nodata' WHEN (goal = 'down' AND floor(c * 100 + 0.5) < 0) OR (goal = 'up' AND floor(c * 100 + 0.5) > 0) THEN 'good' ELSE 'bad' END AS badge FROM b""")
def goal_tones(spark, sf):
    s = se.yoy(_monthly(spark, sf)).withColumn("goal", _goal())
    pct, goal = F.col("pct"), F.col("goal")
    return s.select(
        "signal", "label", t.month(), se.delta_class(pct).alias("delta"),
        se.goal_tone(pct, goal).alias("tone"), se.badge(half_up(pct * 100), goal).alias("badge"),
    )


@query("week_partner", f"""WITH {t.WEEKLY}, x AS MATERIALIZED (SELECT signal, label, week, period, n FROM w)
SELECT signal, label, week, n, lag(n, 52) OVER (PARTITION BY signal, label ORDER BY period) AS prior FROM x""")
def week_partner(spark, sf):
    return se.week_partner(_weekly(spark, sf)).select("signal", "label", F.col("period").cast("string").alias("week"), "n", "prior")


@query("nearest_week", f"""WITH {t.WEEKLY}, x AS (SELECT DISTINCT day + 200 AS target FROM inc), p AS (SELECT DISTINCT period FROM w)
SELECT CAST(target AS VARCHAR) AS target, CAST(arg_min(period, abs(date_diff('day', period, target)) * 100000 + date_diff('day', DATE '1990-01-01', period)) AS VARCHAR) AS week FROM x CROSS JOIN p GROUP BY target""")
def nearest_week(spark, sf):
    targets = t.incidents(spark, sf).select(F.date_add("day", 200).alias("target")).distinct()
    w = se.nearest_week(_weekly(spark, sf).select("period").distinct(), targets)
    return w.select(F.col("target").cast("string").alias("target"), F.col("period").cast("string").alias("week"))


_CHIP_MONTH, _CHIP_WEEK = "2001-06-01", "2001-06-18"


def _int_pct(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} <> 0 THEN floor(CAST({a} - {b} AS DOUBLE) / {b} * 100 + 0.5) END AS BIGINT)"


@query("kpi_chips", f"""WITH {t.SERIES}, m AS (SELECT *, n AS cur1, lag(n, 12) {W} AS prior1, CAST({_sum(3)} AS BIGINT) AS cur3, CAST({_sum(3, 12)} AS BIGINT) AS prior3 FROM s),
wk AS (SELECT signal, district AS label, wk, count(*) AS n FROM inc WHERE district IN {t.IN_DISTRICTS} GROUP BY ALL UNION ALL SELECT signal, 'Citywide', wk, count(*) FROM inc GROUP BY ALL),
k AS (SELECT signal, label, CAST(coalesce(sum(n) FILTER (WHERE wk BETWEEN DATE '{_CHIP_WEEK}' - 7 AND DATE '{_CHIP_WEEK}'), 0) AS BIGINT) AS cur2,
  CAST(coalesce(sum(n) FILTER (WHERE wk BETWEEN DATE '{_CHIP_WEEK}' - 371 AND DATE '{_CHIP_WEEK}' - 364), 0) AS BIGINT) AS prior2 FROM wk GROUP BY ALL)
SELECT signal, label, cur1, prior1, {_int_pct('cur1', 'prior1')} AS change_1mo, cur3, prior3, {_int_pct('cur3', 'prior3')} AS change_3mo,
  cur2, prior2, {_int_pct('cur2', 'prior2')} AS change_2wk, prior2 < 20 AS low_base FROM m JOIN k USING (signal, label) WHERE period = DATE '{_CHIP_MONTH}'""")
def kpi_chips(spark, sf):
    d = lambda x: F.lit(x).cast("date")
    return se.kpi_chips(*_both(spark, sf), d(_CHIP_MONTH), d(_CHIP_WEEK))


@query("fixed_window_yoy", f"""WITH {t.INCIDENTS}, f AS (SELECT signal, district,
  count(*) FILTER (WHERE day >= DATE '2001-05-01' AND day < DATE '2001-06-01') AS last1, count(*) FILTER (WHERE day >= DATE '2000-05-01' AND day < DATE '2000-06-01') AS prior1,
  count(*) FILTER (WHERE day >= DATE '2001-03-01' AND day < DATE '2001-06-01') AS last3, count(*) FILTER (WHERE day >= DATE '2000-03-01' AND day < DATE '2000-06-01') AS prior3,
  count(*) FILTER (WHERE day >= DATE '2001-06-01' - 14 AND day < DATE '2001-06-01') AS last2w,
  count(*) FILTER (WHERE day >= DATE '2001-06-01' - 378 AND day < DATE '2001-06-01' - 364) AS prior2w
  FROM inc WHERE day >= DATE '2000-03-01' AND day < DATE '2001-06-01' GROUP BY ALL)
SELECT *, {_int_pct('last1', 'prior1')} AS change_1mo, {_int_pct('last3', 'prior3')} AS change_3mo, {_int_pct('last2w', 'prior2w')} AS change_2wk FROM f""")
def fixed_window_yoy(spark, sf):
    return se.fixed_window_yoy(t.incidents(spark, sf), t.AS_OF, ["signal", "district"])


@query("time_slice_sum", f"""WITH {t.INCIDENTS} SELECT signal, district, ym AS month, count(*) AS n FROM inc WHERE hour BETWEEN 6 AND 11 OR hour BETWEEN 18 AND 21 GROUP BY ALL""")
def time_slice_sum(spark, sf):
    c = ru.cube(t.incidents(spark, sf), tk.month_start(F.col("day")), bucket=tk.tod_granular(F.col("hour")))
    s = se.time_slice(c, ["morning", "evening"], ["signal", "district", "period"])
    return s.select("signal", "district", t.month(), "n")


@query("window_clamp", f"""WITH c AS (SELECT DISTINCT CAST(c_custkey % 97 AS INTEGER) - 9 AS lo, CAST(c_custkey % 89 AS INTEGER) - 5 AS hi FROM customer),
a AS (SELECT lo, hi, greatest(0, least(78, lo)) AS x FROM c), b AS (SELECT lo, hi, x, greatest(x, least(78, hi)) AS y FROM a)
SELECT lo, hi, x AS lo2, CASE WHEN y - x + 1 < 3 THEN least(78, x + 2) ELSE y END AS hi2 FROM b""")
def window_clamp(spark, sf):
    k = F.col("c_custkey")
    c = t.table(spark, sf, "customer").select(
        ((k % 97).cast("int") - 9).alias("lo"), ((k % 89).cast("int") - 5).alias("hi")
    ).distinct()
    a, b = se.clamp_window(F.col("lo"), F.col("hi"), F.lit(78), 3)
    return c.select("lo", "hi", a.alias("lo2"), b.alias("hi2"))


@query("window_presets", f"""WITH {t.SERIES}, {_PRESET_SQL} SELECT signal, label, month, preset FROM s JOIN p ON idx BETWEEN lo AND hi""")
def window_presets(spark, sf):
    s = _monthly(spark, sf).withColumn("w", F.explode(param_array(PRESETS)))
    return s.where(F.col("idx").between(F.col("w.lo"), F.col("w.hi"))).select(
        "signal", "label", t.month(), F.col("w.preset").alias("preset")
    )

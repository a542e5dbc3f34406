"""Labels, lookups, stored documents, runnable totals and drift checks."""

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import timekeys as tk
from ..operators import evaluate as ev
from ..operators import quality as qu
from ..operators import records as re
from ..operators import rollup as ru
from ..operators import series as se
from ..operators import settling as st
from ..sources import registry as rg
from ..sources import sinks as sk
from . import tables as t
from .catalog import query
from .rollup_queries import _monthly
from .settling_queries import _CDF, _cdf


@query("calendar_labels", """SELECT o_orderkey AS id, strftime(o_orderdate, '%-m/%-d') AS day, strftime(o_orderdate, '%b ''%y') AS short_month,
  CAST(2001 * 12 + 8 - (year(o_orderdate) * 12 + month(o_orderdate)) AS INTEGER) AS months_to FROM orders""")
def calendar_labels(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), tk.day_label(d).alias("day"), tk.short_month_label(d).alias("short_month"),
        tk.months_between_ym(F.date_format(d, "yyyy-MM"), F.lit("2001-08")).alias("months_to"),
    )


_DELTA = f"date_diff('day', DATE '2001-07-31', DATE '{t.AS_OF}')"


@query("newest_month_peek", f"""WITH {t.SERIES}, {_CDF}, c AS (SELECT signal, round(sum(f) / 31, 6) AS completeness
  FROM cdf JOIN (SELECT unnest(range(31)) AS j) ON k = least({_DELTA} + j, 120) GROUP BY signal)
SELECT s.signal, label, month, n, completeness FROM s LEFT JOIN c USING (signal) WHERE period = DATE '2001-07-01' AND n > 0""")
def newest_month_peek(spark, sf):
    """The held-back month with its completeness from the reporting lags."""
    p = ru.axis_pointers(t.AS_OF, 1)
    peek = se.newest_peek(_monthly(spark, sf), p["latest_complete"], p["latest_settled"], F.lit(None).cast("double")).drop("completeness")
    cdf = _cdf(spark, sf)
    ages = st.month_ages(cdf.select("signal").distinct().withColumn("period", p["latest_complete"]), t.AS_OF)
    done = st.month_completeness(cdf, ages, ["signal"]).select("signal", F.round("completeness", 6).alias("completeness"))
    return peek.join(done, "signal", "left").select("signal", "label", t.month(), "n", "completeness")


_BREAK_ROWS = ", ".join(f"('{a}', DATE '{b}', '{c}')" for a, b, c in rg.known_breaks())


@query("known_breaks", f"""WITH {t.PINS}, w AS (SELECT id AS intervention, lever, CAST(date + INTERVAL 26 YEAR AS DATE) - 200 AS s0, CAST(date + INTERVAL 26 YEAR AS DATE) + CAST(20 + id % 700 AS INTEGER) AS e0
  FROM pins CROSS JOIN (SELECT unnest({sorted(rg.LEVERS)}) AS lever)), br AS (SELECT * FROM (VALUES {_BREAK_ROWS}) AS v(lever, d, label))
SELECT intervention, w.lever, CAST(d AS VARCHAR) AS break_date, label AS break_label FROM w JOIN br ON br.lever = w.lever WHERE s0 < d AND d < e0""")
def known_breaks(spark, sf):
    """Windows that cross a reporting change of their lever's signals, as the registry has them."""
    moved = F.add_months("date", 26 * 12)
    w = t.pins(spark, sf).select(
        F.col("id").alias("intervention"), F.explode(F.array(*[F.lit(x) for x in sorted(rg.LEVERS)])).alias("lever"),
        F.date_sub(moved, 200).alias("start"), F.date_add(moved, (20 + F.col("id") % 700).cast("int")).alias("end"),
    )
    return ev.breaks_crossed(w, rg.known_breaks()).select("intervention", "lever", "break_date", "break_label")


_KPI = " ".join(f"WHEN '{d}' THEN '{s}/{label}/{goal}'" for d, (s, label, goal) in fixed.DISTRICT_THIRD_KPI.items())
_FIVE = ["Central", "Northern", "Mission", "Tenderloin", "Richmond"]


@query("third_kpi", f"SELECT c_custkey AS id, CASE {_FIVE}[CAST(c_custkey % 5 + 1 AS INTEGER)] {_KPI} END AS kpi FROM customer")
def third_kpi(spark, sf):
    k = re.third_kpi(F.element_at(F.array(*[F.lit(d) for d in _FIVE]), (F.col("c_custkey") % 5 + 1).cast("int")))
    return t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(k.isNotNull(), F.concat_ws("/", k["signal"], k["label"], k["goal"])).alias("kpi"))


@query("stored_documents", """SELECT c_custkey AS key, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS intervention,
  CASE WHEN c_custkey % 7 <> 0 THEN 'a,b' END AS levers, CASE WHEN c_custkey % 7 = 0 THEN 'not a document' END AS error FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 <> 0""")
def stored_documents(spark, sf):
    """Records kept as JSON documents, some deleted and some cut off."""
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(
        k.cast("string").alias("id"), F.col("c_name").alias("intervention"), F.array(F.lit("a"), F.lit("b")).alias("levers"), (k % 5 == 0).alias("deleted")
    ))
    rows = t.table(spark, sf, "customer").select(k.alias("key"), F.when(k % 7 == 0, F.lit("{\"id\": ")).otherwise(doc).alias("doc"))
    got = re.stored_documents(rows)
    return got.select("key", "id", "intervention", F.when(F.col("levers").isNotNull(), F.array_join("levers", ",")).alias("levers"), "error")


@query("reproduced_total", f"WITH {t.INCIDENTS} SELECT count(*) AS reports FROM inc WHERE signal = '2-HIGH' AND day >= DATE '1999-01-01' AND day < DATE '2000-01-01' AND district = 'ASIA'")
def reproduced_total(spark, sf):
    t.incidents(spark, sf).createOrReplaceTempView("placetime_incidents")
    return spark.sql(sk.reproduce_total("placetime_incidents", "signal = '2-HIGH'", "day", ("1999-01-01", "2000-01-01"), {"district": "ASIA"}))


@query("filter_drift", """SELECT 'filter_drift' AS "check", 'late' AS entity, CAST(count(*) AS VARCHAR) AS detail FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderpriority <> '1-URGENT'""")
def filter_drift(spark, sf):
    """Two registries over one table: one filter is the same, one is wider in the second."""
    p = F.col("o_orderpriority")
    ours = {"urgent": p == "1-URGENT", "late": p == "1-URGENT"}
    theirs = {"urgent": p.isin("1-URGENT"), "late": p.isin("1-URGENT", "2-HIGH")}
    return qu.filter_drift(t.table(spark, sf, "orders"), ours, theirs)

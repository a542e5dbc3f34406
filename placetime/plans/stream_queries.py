"""Streaming jobs run to the end of the available files, checked against batch SQL."""

from pyspark.sql import functions as F

from ..functions.ranks import materialize
from ..operators import settling as st
from ..streaming import jobs
from . import tables as t
from .catalog import query

DELAY_DAYS = 2


SLICES = 3


def _arrivals(spark, sf):
    """The events in SLICES parts in time order."""
    events = t.table(spark, sf, "events")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    parts = []
    for k in range(SLICES):
        lo, hi = (span.a + (span.b - span.a) * x / SLICES for x in (k, k + 1))
        parts.append(events.where((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) if k + 1 < SLICES else F.lit(True))))
    return parts, events.schema, F.lit(span.b)


def _windows_sql(width: str, start: str) -> str:
    """Plain grouping of all events; a window is closed when the final watermark has passed it."""
    return f"""x AS (SELECT {start} AS s, event_type AS signal FROM events),
m AS (SELECT max(ts) - INTERVAL {DELAY_DAYS} DAY AS w FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, signal, count(*) AS n, s + INTERVAL {width} <= (SELECT w FROM m) AS closed FROM x GROUP BY ALL"""


def _counts(spark, sf, width, label):
    parts, schema, newest = _arrivals(spark, sf)
    plan = lambda s: jobs.counts(s.withColumn("signal", F.col("event_type")), "ts", width, ["signal"], f"{DELAY_DAYS} days")
    last = jobs.with_closed(jobs.run_updates(parts, schema, "ts", plan, ["start", "end", "signal"], label), newest, f"{DELAY_DAYS} days")
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "signal", "n", "closed")


@query("stream_counts", f"WITH {_windows_sql('1 HOUR', chr(39).join(['date_trunc(', 'hour', ', ts)']))}")
def stream_counts(spark, sf):
    return _counts(spark, sf, "1 hour", "hourly")


@query("stream_weekly", f"WITH {_windows_sql('7 DAY', chr(39).join(['date_trunc(', 'week', ', ts)']))}")
def stream_weekly(spark, sf):
    return _counts(spark, sf, "7 days", "weekly")


@query("stream_dedup", "SELECT event_id AS id, event_type AS signal FROM events")
def stream_dedup(spark, sf):
    """Each part arrives with a replay of the part before it, the job is stopped and started again between arrivals;
    each id passes once."""
    parts, schema, _ = _arrivals(spark, sf)
    landing = jobs.Landing(spark, "dedup", schema, "ts")
    for k, part in enumerate(parts):
        landing.add(part.unionByName(parts[k - 1]) if k else part)
        once = jobs.dedup(landing.stream(), "event_id", "ts", "2 days")
        out = once.select(F.col("event_id").alias("id"), F.col("event_type").alias("signal"))
        landing.run(out)
    return landing.out(out.schema)


@query("late_policy", f"""WITH {t.REPORTS}, r AS (SELECT signal, date_diff('day', incident, soon) AS lag FROM rep),
k AS (SELECT signal, lag, row_number() OVER (PARTITION BY signal ORDER BY lag) AS rn, count(*) OVER (PARTITION BY signal) AS n FROM r),
p AS (SELECT signal, max(lag) FILTER (WHERE rn = least(n, CAST(floor(90 * n / 100.0) AS BIGINT) + 1)) AS p90 FROM k GROUP BY signal)
SELECT signal, p90, count(*) FILTER (WHERE lag <= p90) AS in_time, count(*) FILTER (WHERE lag > p90) AS late FROM r JOIN p USING (signal) GROUP BY ALL""")
def late_policy(spark, sf):
    rows = st.lags(t.reports(spark, sf), "incident", "soon")
    return st.late_at_percentile(rows, ["signal"]).withColumnRenamed("delay", "p90")


#: First days of the second and later arrivals.
ARRIVE = ("1994-06-01", "1996-06-01", "1998-01-01")


@query("stream_hold_back", f"""WITH {t.REPORTS}, r AS (SELECT signal, incident, soon, date_diff('day', incident, soon) AS lag FROM rep),
p AS (SELECT lag AS p90 FROM (SELECT lag, row_number() OVER (ORDER BY lag) AS rn, count(*) OVER () AS n FROM r) WHERE rn = least(n, CAST(floor(90 * n / 100.0) AS BIGINT) + 1)),
x AS (SELECT *, CAST(date_trunc('week', incident) AS DATE) + 7 AS last, {' + '.join(f"CAST(soon >= DATE '{d}' AS INTEGER)" for d in ARRIVE)} AS slice FROM r),
w AS (SELECT slice + 1 AS slice, max(max(incident)) OVER (ORDER BY slice) - CAST((SELECT p90 FROM p) AS INTEGER) AS mark FROM x GROUP BY slice),
y AS (SELECT x.*, coalesce(last <= mark, false) AS gone FROM x LEFT JOIN w USING (slice))
SELECT signal, (SELECT CAST(p90 AS BIGINT) FROM p) AS delay, count(*) FILTER (NOT gone AND last <= (SELECT max(mark) FROM w)) AS emitted,
  count(*) FILTER (NOT gone AND last > (SELECT max(mark) FROM w)) AS held, count(*) FILTER (gone) AS dropped FROM y GROUP BY ALL""")
def stream_hold_back(spark, sf):
    """Reports stream in by their report day; weeks are held back by the measured 90th percentile of the lag."""
    rows = st.lags(t.reports(spark, sf), "incident", "soon")
    delay = st.late_at_percentile(rows, []).first()["delay"]
    own = materialize(rows.select("signal", "soon", F.col("incident").cast("timestamp_ntz").alias("ts")), "reports")
    bounds = [None, *ARRIVE, None]
    parts = []
    for lo, hi in zip(bounds, bounds[1:]):
        part = own if lo is None else own.where(F.col("soon") >= F.lit(lo).cast("date"))
        parts.append(part if hi is None else part.where(F.col("soon") < F.lit(hi).cast("date")))
    found, _ = jobs.hold_back(parts, own.schema, "ts", "7 days", ["signal"], delay, "hold-back")
    return found.select("signal", F.lit(delay).cast("long").alias("delay"), "emitted", "held", "dropped")

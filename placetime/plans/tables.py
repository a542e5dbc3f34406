"""The supplied tables read as this package's inputs.  Each builder has its SQL twin beside
it; both derive every attribute from the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

LO, AS_OF = "1995-01-01", "2001-08-15"          # monthly history and its reference day
FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-08-01"
SPLIT = "1998-12-01"
EVENT_LO, EVENT_AS_OF = "2024-01-01", "2024-01-30"
DISTRICTS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")   # the rest counts citywide only
SIGNALS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_SIGNALS = ("click", "error", "purchase", "signup", "view")
SOUTH, WEST = 3770000, -12252000
HEIGHT, WIDTH = 14000, 17000
NORTH, EAST = SOUTH + HEIGHT, WEST + WIDTH

IN_DISTRICTS = "(" + ", ".join(f"'{d}'" for d in DISTRICTS) + ")"
SIGNAL_LIST = "[" + ", ".join(f"'{s}'" for s in SIGNALS) + "]"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table; its footer is read for the schema only the first time."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def hashed(key: Column, a: int, b: int) -> tuple[Column, Column]:
    lat = (F.lit(SOUTH) + (key * a) % HEIGHT).cast("int")
    lng = (F.lit(WEST) + (key * b) % WIDTH).cast("int")
    return lat, lng


def hashed_sql(key: str, a: int, b: int) -> str:
    return (
        f"CAST({SOUTH} + ({key} * {a}) % {HEIGHT} AS INTEGER) AS lat_e5, "
        f"CAST({WEST} + ({key} * {b}) % {WIDTH} AS INTEGER) AS lng_e5"
    )


def corner_name(key: Column) -> Column:
    return F.concat(F.lit("ST"), (key % 40).cast("string"), F.lit(" / AVE"), (key % 25).cast("string"))


def corner_name_sql(key: str) -> str:
    return f"'ST' || CAST({key} % 40 AS VARCHAR) || ' / AVE' || CAST({key} % 25 AS VARCHAR)"


# -- point events ---------------------------------------------------------------------------
def points(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once, with a position."""
    lat, lng = hashed(F.col("event_id"), 7919, 104729)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("ts").cast("date").alias("day"),
        F.hour("ts").alias("hour"), F.col("event_type").alias("signal"), "user_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        lat.alias("lat_e5"), lng.alias("lng_e5"), corner_name(F.col("user_id")).alias("name"),
    )


POINTS = f"""pts AS (SELECT event_id AS id, ts, CAST(ts AS DATE) AS day,
  CAST(extract(hour FROM ts) AS INTEGER) AS hour, event_type AS signal, user_id, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  {hashed_sql('event_id', 7919, 104729)}, {corner_name_sql('user_id')} AS name FROM events)"""


def raw_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a portal would serve them: some ids twice, some missing, some rows undated
    or without a position.  `arrival` is the unique serving order."""
    k = F.col("event_id")
    lat, lng = hashed(k, 7919, 104729)
    copies = F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = table(spark, sf, "events").withColumn("seq", F.explode(copies))
    undated = (k % 101 == 0) & (F.col("seq") == 0)
    located = k % 97 != 0
    return rows.select(
        F.when(k % 89 != 0, k).alias("id"), (k * 2 + F.col("seq")).alias("arrival"),
        F.when(~undated, F.col("ts") + F.make_dt_interval(F.lit(0), F.col("seq"))).alias("ts"),
        F.col("event_type").alias("signal"),
        F.when(located, lat).alias("lat_e5"), F.when(located, lng).alias("lng_e5"),
    )


RAW_POINTS = f"""raw0 AS (SELECT *, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS seq
  FROM events),
raw AS (SELECT CASE WHEN event_id % 89 <> 0 THEN event_id END AS id, event_id * 2 + seq AS arrival,
  CASE WHEN NOT (event_id % 101 = 0 AND seq = 0) THEN ts + to_hours(seq) END AS ts,
  event_type AS signal,
  CASE WHEN event_id % 97 <> 0 THEN CAST({SOUTH} + (event_id * 7919) % {HEIGHT} AS INTEGER) END AS lat_e5,
  CASE WHEN event_id % 97 <> 0 THEN CAST({WEST} + (event_id * 104729) % {WIDTH} AS INTEGER) END AS lng_e5
  FROM raw0)"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events placed at their user's corner: many calls share one position and name."""
    lat, lng = hashed(F.col("user_id"), 7919, 104729)
    return points(spark, sf).withColumns({"lat_e5": lat, "lng_e5": lng})


CALLS = POINTS + f""", calls AS (SELECT id, ts, day, hour, signal, name,
  {hashed_sql('user_id', 7919, 104729)} FROM pts)"""


# -- districts ------------------------------------------------------------------------------
def rings(spark: SparkSession, sf: str) -> DataFrame:
    """Slanted strips, one per region, plus a hole, an overlap and a two-part feature.  The
    eastern edge of the box belongs to no strip."""
    r = F.col("r_regionkey")
    x0 = F.lit(WEST + 0.5) + r * 3000
    wide = F.when(r == 1, 3600).otherwise(3000)
    mid = F.lit(SOUTH + HEIGHT // 2 + 0.5)

    def quad(bottom: Column, top: Column, inset: int = 0) -> Column:
        pts = [(x0 + inset, bottom), (x0 + wide - inset, bottom),
               (x0 + wide - inset + 250, top), (x0 + inset + 250, top)]
        return F.array(*[
            F.struct(
                (pts[i][0] / 100000.0).alias("x1"), (pts[i][1] / 100000.0).alias("y1"),
                (pts[i - 1][0] / 100000.0).alias("x2"), (pts[i - 1][1] / 100000.0).alias("y2"),
            )
            for i in range(4)
        ])

    low, high = F.lit(SOUTH - 99.5), F.lit(NORTH + 99.5)

    def ring(part: int, role: str, edges: Column, cond: Column) -> Column:
        return F.when(cond, F.struct(
            F.lit(part).alias("part"), F.lit(role).alias("role"), edges.alias("edges")
        ))

    two = r == 3
    all_rings = F.array_compact(F.array(
        ring(0, "outer", quad(low, high), ~two),
        ring(0, "hole", quad(mid - 1500, mid + 1500, 600), r == 2),
        ring(0, "outer", quad(low, mid - 300), two),
        ring(1, "outer", quad(mid + 300, high), two),
    ))
    return table(spark, sf, "region").select(
        F.col("r_name").alias("district"), r.alias("feature_order"), F.explode(all_rings).alias("g")
    ).select("district", "feature_order", "g.part", "g.role", "g.edges")


def _edges_sql() -> str:
    low, high, mid = SOUTH - 99.5, NORTH + 99.5, SOUTH + HEIGHT // 2 + 0.5
    shapes = [  # part, ring, role, condition, bottom, top, inset
        (0, 0, "outer", "r_regionkey <> 3", low, high, 0),
        (0, 1, "hole", "r_regionkey = 2", mid - 1500, mid + 1500, 600),
        (0, 2, "outer", "r_regionkey = 3", low, mid - 300, 0),
        (1, 3, "outer", "r_regionkey = 3", mid + 300, high, 0),
    ]
    rows = []
    for part, ring, role, cond, b, t, inset in shapes:
        xs = [f"(x0 + {inset})", f"(x0 + w - {inset})", f"(x0 + w - {inset} + 250)", f"(x0 + {inset} + 250)"]
        ys = [b, b, t, t]
        for i in range(4):
            rows.append(
                f"SELECT r_name AS district, r_regionkey AS feature_order, {part} AS part, {ring} AS ring, "
                f"'{role}' AS role, {xs[i]} / CAST(100000 AS DOUBLE) AS x1, CAST({ys[i]} AS DOUBLE) / 100000 AS y1, "
                f"{xs[i - 1]} / CAST(100000 AS DOUBLE) AS x2, CAST({ys[i - 1]} AS DOUBLE) / 100000 AS y2 FROM strips WHERE {cond}"
            )
    return (
        f"strips AS (SELECT r_name, r_regionkey, CAST({WEST + 0.5} AS DOUBLE) + r_regionkey * 3000 AS x0, "
        "CASE WHEN r_regionkey = 1 THEN 3600 ELSE 3000 END AS w FROM region),\n"
        "edges AS (" + "\nUNION ALL ".join(rows) + ")"
    )


EDGES = _edges_sql()


def assigned_sql(source: str, holes: bool, unknown: str = "UNKNOWN") -> str:
    """CTE `assigned`: source rows (needs unique id) with their district."""
    eps = "" if holes else " + 1e-12"
    hole_test = "AND NOT coalesce(in_hole, false)" if holes else ""
    return f"""{EDGES},
hits AS (SELECT p.id, e.district, e.feature_order, e.part, e.ring, e.role,
  sum(CASE WHEN ((e.y1 > p.lat_e5 / 100000.0) <> (e.y2 > p.lat_e5 / 100000.0)) AND p.lng_e5 / 100000.0 <
    (e.x2 - e.x1) * (p.lat_e5 / 100000.0 - e.y1) / (e.y2 - e.y1{eps}) + e.x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside
  FROM {source} p CROSS JOIN edges e WHERE p.lat_e5 IS NOT NULL GROUP BY ALL),
parts AS (SELECT id, district, feature_order, part, bool_or(inside AND role = 'outer') AS in_outer,
  bool_or(inside AND role = 'hole') AS in_hole FROM hits GROUP BY ALL),
firsts AS (SELECT id, arg_min(district, feature_order * 10 + part) AS district FROM parts
  WHERE in_outer {hole_test} GROUP BY id),
assigned AS (SELECT p.*, coalesce(f.district, '{unknown}') AS district FROM {source} p LEFT JOIN firsts f USING (id))"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A square block per stop, with a courtyard where the stop is sheltered."""
    s = stops(spark, sf)

    def square(half: float) -> Column:
        y, x = F.col("lat_e5") / 100000.0, F.col("lng_e5") / 100000.0
        h = half / 100000.0
        xy = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
        return F.array(*[
            F.struct(xy[i][0].alias("x1"), xy[i][1].alias("y1"), xy[i - 1][0].alias("x2"), xy[i - 1][1].alias("y2"))
            for i in range(4)
        ])

    outer = F.struct(F.lit(0).alias("part"), F.lit("outer").alias("role"), square(40.5).alias("edges"))
    court = F.struct(F.lit(0).alias("part"), F.lit("hole").alias("role"), square(15.5).alias("edges"))
    return s.select(
        F.concat(F.lit("B"), F.col("id").cast("string")).alias("district"), F.col("id").alias("feature_order"),
        F.explode(F.array_compact(F.array(outer, F.when(F.col("shelter"), court)))).alias("g"),
    ).select("district", "feature_order", "g.part", "g.role", "g.edges")


# -- dated incidents with a native district ----------------------------------------------------
def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as incidents: priority is the signal, the customer's region the district, the
    order status the resolution; customers cluster at shared sites."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    site = F.col("c_custkey") % 300
    lat = F.lit(SOUTH) + (site * 4637) % HEIGHT + (F.col("c_custkey") % 7) * 3
    lng = F.lit(WEST) + (site * 9473) % WIDTH + (F.col("c_custkey") % 11) * 3
    hour = (F.col("o_orderkey") % 24).cast("int")
    return j.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hour)).alias("ts"),
        F.col("o_orderdate").cast("date").alias("day"), hour.alias("hour"),
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
        F.col("o_orderpriority").alias("signal"), F.col("o_orderstatus").alias("resolution"),
        F.col("r_name").alias("district"), F.col("n_name").alias("nation"),
        F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"),
        lat.cast("int").alias("lat_e5"), lng.cast("int").alias("lng_e5"),
        corner_name(F.col("c_custkey")).alias("name"),
    )


INCIDENTS = f"""inc AS (SELECT o_orderkey AS id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ts,
  CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 24 AS INTEGER) AS hour,
  strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
  CAST(date_trunc('week', o_orderdate) AS DATE) AS wk,
  o_orderpriority AS signal, o_orderstatus AS resolution, r_name AS district, n_name AS nation,
  c_custkey AS custkey, c_mktsegment AS segment,
  CAST({SOUTH} + ((c_custkey % 300) * 4637) % {HEIGHT} + (c_custkey % 7) * 3 AS INTEGER) AS lat_e5,
  CAST({WEST} + ((c_custkey % 300) * 9473) % {WIDTH} + (c_custkey % 11) * 3 AS INTEGER) AS lng_e5,
  {corner_name_sql('c_custkey')} AS name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

SERIES = INCIDENTS + f""",
ax AS (SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx FROM
  (SELECT CAST(unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS DATE) AS period)),
keys AS (SELECT signal, label FROM (SELECT unnest({SIGNAL_LIST}) AS signal)
  CROSS JOIN (SELECT unnest({list(DISTRICTS) + ['Citywide']}) AS label)),
cnt AS (SELECT signal, district AS label, m AS period, count(*) AS n FROM inc WHERE district IN {IN_DISTRICTS} GROUP BY ALL
  UNION ALL SELECT signal, 'Citywide', m, count(*) FROM inc GROUP BY ALL),
s AS (SELECT signal, label, idx, period, strftime(period, '%Y-%m') AS month, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM keys CROSS JOIN ax LEFT JOIN cnt USING (signal, label, period))"""

WEEKLY = INCIDENTS + f""",
ax AS (SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS idx FROM
  (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', DATE '{LO}') AS DATE), DATE '{AS_OF}', INTERVAL 7 DAY)) AS DATE) AS period)),
keys AS (SELECT signal, label FROM (SELECT unnest({SIGNAL_LIST}) AS signal)
  CROSS JOIN (SELECT unnest({list(DISTRICTS) + ['Citywide']}) AS label)),
cnt AS (SELECT signal, district AS label, wk AS period, count(*) AS n FROM inc WHERE district IN {IN_DISTRICTS} GROUP BY ALL
  UNION ALL SELECT signal, 'Citywide', wk, count(*) FROM inc GROUP BY ALL),
w AS (SELECT signal, label, idx, period, CAST(period AS VARCHAR) AS week, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM keys CROSS JOIN ax LEFT JOIN cnt USING (signal, label, period))"""


def month(c: str = "period") -> Column:
    return F.date_format(c, "yyyy-MM").alias("month")


# -- reports: an incident date, a report date, a load date -------------------------------------
def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as reports of their order: shipped = reported.  Everything loaded before the
    bulk reload carries the reload's date.  `soon` is a short-lag report date."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    j = o.join(l, o.o_orderkey == l.l_orderkey)
    inc, rep = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    lag = F.datediff(rep, inc)
    return j.select(
        F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.col("o_orderpriority").alias("signal"), F.col("o_orderstatus").alias("resolution"),
        F.col("l_returnflag").alias("flag"),
        inc.alias("incident"), rep.alias("report"),
        F.date_add(inc, F.abs(lag) % 60).alias("soon"),
        F.greatest(F.date_add(rep, F.col("l_linenumber")), F.lit("2000-01-01").cast("date")).alias("load"),
    )


REPORTS = """rep AS (SELECT o_orderkey AS id, l_linenumber AS line, o_orderpriority AS signal,
  o_orderstatus AS resolution, l_returnflag AS flag, CAST(o_orderdate AS DATE) AS incident,
  CAST(l_shipdate AS DATE) AS report,
  CAST(o_orderdate AS DATE) + CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 60 AS INTEGER) AS soon,
  greatest(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER), DATE '2000-01-01') AS load
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


# -- stops, corners, pins -----------------------------------------------------------------------
def stops(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lng = hashed(k, 6007, 50021)
    return table(spark, sf, "customer").select(
        k.alias("id"), F.concat(F.lit("1"), F.lpad(k.cast("string"), 4, "0")).alias("code"),
        F.concat(F.lit("ST"), (k % 40).cast("string"), F.lit(" & AVE"), (k % 25).cast("string")).alias("name"),
        F.concat(F.lit("ST"), (k % 40).cast("string")).alias("on"),
        F.concat(F.lit("AVE"), (k % 25).cast("string")).alias("at"),
        (k % 3 == 0).alias("shelter"), lat.alias("lat_e5"), lng.alias("lng_e5"),
    )


STOPS = f"""stops AS (SELECT c_custkey AS id, 'ST' || CAST(c_custkey % 40 AS VARCHAR) || ' & AVE' || CAST(c_custkey % 25 AS VARCHAR) AS name,
  'ST' || CAST(c_custkey % 40 AS VARCHAR) AS st_on, 'AVE' || CAST(c_custkey % 25 AS VARCHAR) AS st_at,
  c_custkey % 3 = 0 AS shelter, {hashed_sql('c_custkey', 6007, 50021)} FROM customer)"""


def pins(spark: SparkSession, sf: str) -> DataFrame:
    """Interventions at incident sites, one per supplier."""
    k = F.col("s_suppkey")
    site = k % 300
    return table(spark, sf, "supplier").select(
        k.alias("id"), (F.lit(SOUTH) + (site * 4637) % HEIGHT + 5).cast("int").alias("lat_e5"),
        (F.lit(WEST) + (site * 9473) % WIDTH + 5).cast("int").alias("lng_e5"),
        F.element_at(F.array(*[F.lit(x) for x in (250, 500, 1000)]), (k % 3 + 1).cast("int")).alias("radius"),
        F.date_add(F.lit("1999-06-15").cast("date"), (k % 300).cast("int")).alias("date"),
        F.array(*[F.lit(s) for s in SIGNALS]).alias("levers"),
    )


PINS = f"""pins AS (SELECT s_suppkey AS id, CAST({SOUTH} + ((s_suppkey % 300) * 4637) % {HEIGHT} + 5 AS INTEGER) AS lat_e5,
  CAST({WEST} + ((s_suppkey % 300) * 9473) % {WIDTH} + 5 AS INTEGER) AS lng_e5,
  [250, 500, 1000][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS radius,
  DATE '1999-06-15' + CAST(s_suppkey % 300 AS INTEGER) AS date FROM supplier)"""


def d2_sql(a: str, b: str) -> str:
    """Squared planar metres, longitude scaled at a."""
    dy = f"(({a}.lat_e5 - {b}.lat_e5) * 1.1132::DOUBLE)"
    dx = f"(({a}.lng_e5 - {b}.lng_e5) * 1.1132::DOUBLE * cos(radians({a}.lat_e5 / 100000.0::DOUBLE)))"
    return f"({dy} * {dy} + {dx} * {dx})"

"""From raw rows to clean events: dedup policies, coordinates, per-source normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import timekeys as tk
from ..functions.geo import to_e5
from .predicates import All, From, matching
from .registry import Signal

DEDUP_POLICIES = ("id_first", "dated_first", "null_once")


def dedup_first(
    df: DataFrame,
    id_col: str,
    order: Sequence[str],
    date_col: str,
    policy: str = "id_first",
    within: Sequence[str] = (),
) -> DataFrame:
    """Keep the first row of each id in `order` (which must be unique; "-c" is descending),
    separately for each value of the `within` columns.

    id_first     the id is taken by its first row even if that row is undated; undated rows
                 are dropped afterwards; rows without an id are all kept
    dated_first  undated rows are dropped first
    null_once    like id_first, but null counts as one id

    The rank-1 filter is applied inside each map task before the shuffle, so an id with a
    large share of the rows reaches its reducer as one row per task.
    """
    if policy not in DEDUP_POLICIES:
        raise ValueError(f"unknown dedup policy {policy}")
    names = [c.removeprefix("-") for c in order]
    dated = F.col(date_col).isNotNull()
    rows = df.where(dated) if policy == "dated_first" else df
    keys = [*[F.col(c) for c in within], F.col(id_col)]
    if policy != "null_once":
        # rows without an id stay apart from one another
        keys += [F.when(F.col(id_col).isNull(), F.col(c)) for c in names]
    first = W.partitionBy(*keys).orderBy(
        *[F.col(n).desc() if c.startswith("-") else F.col(n) for c, n in zip(order, names)]
    )
    kept = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return kept.where(dated)


def point_coords(point: Column) -> tuple[Column, Column]:
    """(lat, lng) E5 of a GeoJSON point column."""
    xy = point["coordinates"]
    return to_e5(F.get(xy, F.lit(1))), to_e5(F.get(xy, F.lit(0)))


def text_coords(lat: Column, lng: Column) -> tuple[Column, Column]:
    return to_e5(lat.try_cast("double")), to_e5(lng.try_cast("double"))


def drop_origin(lat_e5: Column, lng_e5: Column) -> tuple[Column, Column]:
    """The live view also treats (0, 0) as no coordinate."""
    real = ~((lat_e5 == 0) & (lng_e5 == 0))
    return F.when(real, lat_e5), F.when(real, lng_e5)


def time_keys(df: DataFrame, ts_col: str, epoch: str = "2023-01-01") -> DataFrame:
    """Add ts, day, ym, week, hour and the day offset from `epoch`."""
    ts = tk.ntz(F.col(ts_col))
    return df.withColumns({
        "ts": ts,
        "day": ts.cast("date"),
        "ym": tk.ym(ts),
        "week": tk.week_start(ts),
        "hour": F.hour(ts),
        "day_idx": tk.day_offset(ts, epoch),
    })


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _or_else(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit(""))


def _event(dt: str, id_col: str, place: str, lat: Column, lng: Column, notes: Column) -> list[Column]:
    ts = F.col(dt).try_cast("timestamp_ntz")
    return [
        ts.alias("ts"), ts.cast("date").alias("day"), tk.ym(ts).alias("ym"),
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(F.col(place), F.lit("(unknown location)")).alias("place"),
        lat.alias("lat_e5"), lng.alias("lng_e5"), notes.alias("notes"),
    ]


def normalize_requests(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    lat, lng = text_coords(F.col("lat"), F.col("long"))
    notes = F.replace(_text("service_details"), F.lit("_"), F.lit(" "))
    return df.select(*keep, *_event("requested_datetime", "service_request_id", "address", lat, lng, notes))


def normalize_calls(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    lat, lng = point_coords(F.col("intersection_point"))
    notes = _or_else(F.col("call_type_final_notes"), F.col("call_type_original_notes"))
    kind = F.nullif(F.col("call_type_final_desc"), F.lit(""))
    full = F.when(kind.isNull(), notes).when(notes == "", kind).otherwise(
        F.concat(kind, F.lit(" — "), notes)
    )
    return df.select(*keep, *_event("received_datetime", "cad_number", "intersection_name", lat, lng, full))


def normalize_reports(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    lat, lng = text_coords(F.col("latitude"), F.col("longitude"))
    notes = _or_else(F.col("incident_description"), F.col("incident_subcategory"))
    return df.select(*keep, *_event("incident_datetime", "incident_id", "intersection", lat, lng, notes))


def normalize_ems(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    lat, lng = point_coords(F.col("case_location"))
    group = F.nullif(F.col("call_type_group"), F.lit(""))
    notes = F.when(group.isNull(), _text("call_type")).otherwise(
        F.concat(_text("call_type"), F.lit(" — "), group)
    )
    return df.select(*keep, *_event("received_dttm", "call_number", "address", lat, lng, notes))


NORMALIZERS = {
    "raw_911": normalize_calls,
    "raw_311": normalize_requests,
    "raw_incidents": normalize_reports,
    "raw_ems": normalize_ems,
}


def lever_events(
    tables: dict[str, DataFrame], levers: dict[str, tuple[Signal, ...]], history_start: str | None = None
) -> DataFrame:
    """Every lever's events from all its sources, deduplicated inside each source only.

    Each source table is read once: rows of no lever, or before `history_start`, are filtered at the scan, the
    others are tagged with all levers they belong to, then one dedup runs per table.  Equal times are settled by
    a hash of the row, so the survivor does not depend on partitions.  Levers whose signal has no id column keep
    every row.
    """
    out = None
    for name, table in tables.items():
        own = {f"{lever}/{i}": (lever, i, sig) for lever, sources in levers.items() for i, sig in enumerate(sources) if sig.table == name}
        if not own:
            continue
        since = lambda sig: (From(sig.date_col, history_start),) if history_start else ()
        marked = matching(table, {k: All((*since(sig), sig.filter)) for k, (_, _, sig) in own.items()}, "_lever")
        tag = [F.substring_index("_lever", "/", 1).alias("lever"), F.substring_index("_lever", "/", -1).cast("int").alias("source")]
        rows = NORMALIZERS[name](marked, ["_lever"]).select(*tag, "*").drop("_lever")
        with_id = {lever for lever, _, sig in own.values() if sig.id_col}
        rows = rows.withColumns({
            "_key": F.when(F.col("lever").isin(*with_id), F.col("id")),
            "_row": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]),
        }).withColumn("_copy", F.when(F.col("_key").isNull(), F.monotonically_increasing_id()).otherwise(0))  # all of these stay
        rows = dedup_first(
            rows, "_key", ["-ts", "_row", "_copy"], "day", "dated_first", within=["lever", "source"]
        ).drop("_key", "_row", "_copy")
        out = rows if out is None else out.unionByName(rows)
    return out


def union_sources(sources: dict[str, DataFrame], id_col: str, order: Sequence[str], date_col: str) -> DataFrame:
    """Deduplicate inside each source, then concatenate; ids of two sources never collide."""
    out = None
    for name, df in sources.items():
        kept = dedup_first(df, id_col, order, date_col, "dated_first").withColumn("source", F.lit(name))
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out


def assignment_report(raw: DataFrame, kept: DataFrame, id_col: str, date_col: str) -> DataFrame:
    """Counts of one load: rows, duplicates, undated, without coordinates, per district."""
    loaded = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(id_col) - F.count_distinct(F.col(id_col))).alias("duplicates"),
    )
    per = kept.groupBy("district").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lat_e5").isNull()).alias("_no_coord")
    )
    every = W.partitionBy(F.lit(0))          # one row per district
    return per.select(
        "district", "n",
        loaded.select("rows").scalar().alias("rows"),
        loaded.select("duplicates").scalar().alias("duplicates"),
        F.sum("n").over(every).alias("kept"),
        F.sum("_no_coord").over(every).alias("no_coord"),
    ).withColumn("undated", F.col("rows") - F.col("duplicates") - F.col("kept"))

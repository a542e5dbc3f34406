"""Readers.  Schemas are always given, never inferred; scalars arrive as text and are cast
with try_cast so one malformed value cannot stop a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geo import to_e5
from .registry import Signal

POINT = "struct<type:string,coordinates:array<double>>"

SCHEMAS = {
    "raw_911": (
        "cad_number string, received_datetime string, intersection_point " + POINT + ", "
        "intersection_name string, call_type_final_desc string, call_type_original_desc string, "
        "call_type_original_notes string, call_type_final_notes string, onview_flag string, "
        "dup_cad_number string, disposition string, priority_final string"
    ),
    "raw_311": (
        "service_request_id string, requested_datetime string, lat string, long string, "
        "service_name string, service_subtype string, service_details string, address string, "
        "status_description string, agency_responsible string, source string"
    ),
    "raw_incidents": (
        "incident_id string, incident_datetime string, incident_date string, "
        "report_datetime string, data_loaded_at string, incident_category string, "
        "incident_subcategory string, incident_description string, resolution string, "
        "report_type_description string, police_district string, intersection string, "
        "latitude string, longitude string, filed_online boolean"
    ),
    "raw_ems": (
        "call_number string, received_dttm string, call_type string, call_type_group string, "
        "unit_sequence_in_call_dispatch int, address string, case_location " + POINT
    ),
    "stops": (
        "stopid string, stopname string, latitude string, longitude string, shelter string, "
        "data_as_of string, accessibilitymask string, onstreet string, atstreet string, "
        "position string, supervisor_district string"
    ),
}

FEED_SCHEMAS = {
    "stops": ("stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "wheelchair_boarding"),
    "routes": ("route_id", "route_short_name", "route_long_name"),
    "trips": ("trip_id", "route_id", "direction_id", "shape_id"),
    "stop_times": ("trip_id", "stop_sequence", "stop_id"),
    "feed_info": ("feed_version", "feed_start_date", "feed_end_date"),
}


def read_signal(df: DataFrame, signal: Signal, history_start: str) -> DataFrame:
    """Rows of one signal since history_start, only the columns it selects."""
    rows = df.where(signal.where() & (F.col(signal.date_col) >= history_start))
    return rows.select(*signal.select) if signal.select else rows


def read_portal_json(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Portal rows: text scalars plus nested GeoJSON points.  `multiline` reads one JSON array
    per file; the default expects one object per line, which splits over many tasks."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Transit feed files by name; columns found by header, so their order is free."""
    feed = {}
    for name, cols in FEED_SCHEMAS.items():
        raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(f"{folder}/{name}.txt")
        clean = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
        feed[name] = clean.select(
            *[F.trim(F.col(c)).alias(c) if c in clean.columns else F.lit(None).cast("string").alias(c)
              for c in cols]
        )
    return feed


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows with a header: headers and values trimmed, missing values ''."""
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return raw.select(
        *[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.replace("﻿", "").strip())
          for c in raw.columns]
    )


def read_geojson_rings(
    spark: SparkSession, path: str, name_property: str = "district", multiline: bool = True
) -> DataFrame:
    """One row per ring of a FeatureCollection: district, feature_order, part, role, edges.

    `edges` joins consecutive vertices; role is 'outer' for a part's first ring, else 'hole'.
    multiline=False reads one collection per line, so a large set splits over tasks.
    """
    schema = (
        "features array<struct<properties:map<string,string>,"
        "geometry:struct<type:string,coordinates:string>>>"
    )
    feats = (
        spark.read.schema(schema).option("multiLine", multiline).json(path)
        .select(F.posexplode("features").alias("feature_order", "f"))
        .select("feature_order", F.col("f.properties")[name_property].alias("district"),
                "f.geometry.type", "f.geometry.coordinates")
    )
    nested = "array<array<array<array<double>>>>"
    parts = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", nested)).when(
        F.col("type") == "Polygon",
        F.array(F.from_json("coordinates", "array<array<array<double>>>")),
    )
    rings = (
        feats.select("feature_order", "district", F.posexplode(parts).alias("part", "p"))
        .select("feature_order", "district", "part", F.posexplode("p").alias("ring", "xy"))
    )
    return rings.select(
        "district", "feature_order", "part",
        F.when(F.col("ring") == 0, "outer").otherwise("hole").alias("role"),
        ring_edges(F.col("xy")).alias("edges"),
    )


def ring_edges(xy: Column) -> Column:
    """Edges of a vertex list, closing the ring from its last vertex to its first."""
    n = F.size(xy)
    return F.transform(
        xy,
        lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"),
            F.get(F.get(xy, (i + n - 1) % n), F.lit(0)).alias("x2"),
            F.get(F.get(xy, (i + n - 1) % n), F.lit(1)).alias("y2"),
        ),
    )


def reference_points(raw: DataFrame) -> DataFrame:
    """Stop snapshot: cast coordinates and flags, drop rows without a latitude."""
    return raw.where(F.coalesce(F.col("latitude"), F.lit("")) != "").select(
        F.col("stopid").alias("id"),
        F.col("stopname").alias("name"),
        to_e5(F.col("latitude").try_cast("double")).alias("lat_e5"),
        to_e5(F.col("longitude").try_cast("double")).alias("lng_e5"),
        F.coalesce(F.col("shelter") == "1", F.lit(False)).alias("shelter"),
        F.substring(F.coalesce("data_as_of", F.lit("")), 1, 10).alias("shelter_as_of"),
        F.coalesce(F.col("accessibilitymask") == "1", F.lit(False)).alias("accessible"),
        F.col("onstreet").alias("on"),
        F.col("atstreet").alias("at"),
        "position",
        F.col("supervisor_district").alias("supe"),
    )


def with_fallback(primary: DataFrame | None, fallback: DataFrame, as_of: str, fallback_as_of: str) -> DataFrame:
    """The fresh feed where there is one, else the carried-forward snapshot, with its date."""
    if primary is not None:
        return primary.withColumn("feed_as_of", F.lit(as_of))
    return fallback.withColumn("feed_as_of", F.lit(fallback_as_of))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_slice(spark: SparkSession, path: str, **keys: str) -> DataFrame:
    """One key's slice of a partitioned output; only its folders are listed and read."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df

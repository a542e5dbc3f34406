"""Transit feed: routes served and the nearest alternative stop of every stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geo import planar_m, to_e5
from .rollup import ranked


def representative_trips(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """The longest trip of each (route, direction, shape); ties take the smallest trip id."""
    lengths = stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("stops"))
    rows = lengths.join(trips, "trip_id")
    return ranked(rows, 1, ["route_id", "direction_id", "shape_id"],
                  [F.desc("stops"), F.col("trip_id")]).drop("rank")


def stop_patterns(feed: dict[str, DataFrame]) -> DataFrame:
    """Ordered stops of each representative trip with route name, previous and next stop."""
    route = F.coalesce(F.nullif(F.col("route_short_name"), F.lit("")), F.col("route_long_name"))
    routes = feed["routes"].select("route_id", route.alias("route"))
    best = representative_trips(feed["stop_times"], feed["trips"]).join(routes, "route_id")
    seq = feed["stop_times"].select("trip_id", F.col("stop_sequence").cast("int").alias("seq"), "stop_id")
    rows = seq.join(best.select("trip_id", "route", "direction_id"), "trip_id")
    along = W.partitionBy("trip_id").orderBy("seq", "stop_id")   # one trip: as many rows as it has stops
    return rows.withColumns({"prev_stop": F.lag("stop_id").over(along), "next_stop": F.lead("stop_id").over(along)})


def feed_stops(feed: dict[str, DataFrame]) -> DataFrame:
    return feed["stops"].select(
        "stop_id", "stop_name", "stop_code", "wheelchair_boarding",
        to_e5(F.col("stop_lat").cast("double")).alias("lat_e5"),
        to_e5(F.col("stop_lon").cast("double")).alias("lng_e5"),
    )


def nearest_alternative(patterns: DataFrame, stops: DataFrame) -> DataFrame:
    """Per stop, route and direction: the nearer of the stops before and after it, the least
    over all patterns.  Columns stop_id, route, direction_id, alt_id, m."""
    near = F.array_compact(F.array("prev_stop", "next_stop"))
    pairs = patterns.select("stop_id", "route", "direction_id", F.explode(near).alias("alt_id")).distinct()
    spot = stops.select("stop_id", "lat_e5", "lng_e5")
    other = stops.select(F.col("stop_id").alias("alt_id"), F.col("lat_e5").alias("t_lat"), F.col("lng_e5").alias("t_lng"))
    d = pairs.join(spot, "stop_id").join(other, "alt_id").withColumn(
        "d", planar_m(F.col("lat_e5"), F.col("lng_e5"), F.col("t_lat"), F.col("t_lng"))
    )
    return d.groupBy("stop_id", "route", "direction_id").agg(F.min(F.struct("d", "alt_id")).alias("b")).select(
        "stop_id", "route", "direction_id", F.col("b.alt_id").alias("alt_id"),
        F.bround("b.d").cast("long").alias("m"),
    )


def stop_summary(patterns: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Routes by (length, text) and alternatives by metres, one row per served stop."""
    routes = patterns.select("stop_id", "route").distinct().groupBy("stop_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.length("route").alias("l"), "route"))),
            lambda r: r["route"],
        ).alias("routes")
    )
    alts = alternatives.groupBy("stop_id").agg(
        F.array_sort(F.collect_list(F.struct("m", "route", "direction_id", "alt_id"))).alias("alts")
    )
    return routes.join(alts, "stop_id", "left")


def enrich_stops(stops: DataFrame, summary: DataFrame, feed: DataFrame) -> DataFrame:
    """Stops with public code, routes, alternatives and whether the feed serves them."""
    served = summary.join(feed.select("stop_id", "stop_code", "wheelchair_boarding"), "stop_id", "left").select(
        F.col("stop_id").alias("id"), "stop_code", F.col("wheelchair_boarding").alias("wheelchair"),
        "routes", "alts", F.lit(True).alias("in_feed"),
    )
    return stops.join(served, "id", "left").withColumns({
        "in_feed": F.coalesce("in_feed", F.lit(False)),
        "code": F.coalesce(F.nullif(F.col("stop_code"), F.lit("")), F.concat(F.lit("1"), "id")),
    }).drop("stop_code")

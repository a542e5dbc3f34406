"""Sinks: dense series, compact points, shards, coded dictionaries, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import timekeys as tk
from ..functions.joins import lookup_join
from ..functions.ranks import global_rank, materialize
from .predicates import Opaque, quoted
from .readers import path_exists
from .registry import Group, Registry


def series_arrays(series: DataFrame, keys: Sequence[str], value: str = "n", axis: str = "period") -> DataFrame:
    """Dense long series to one axis-aligned array per key.  A group is one series, so its
    size is the length of the axis."""
    pairs = F.array_sort(F.collect_list(F.struct(axis, value)))
    return series.groupBy(*keys).agg(
        F.transform(pairs, lambda p: p[value]).alias("values"),
        F.min(axis).alias("start"),
        F.max(axis).alias("end"),
    )


def write_series(series: DataFrame, path: str, keys: Sequence[str] = ("signal", "label")) -> None:
    series_arrays(series, keys).write.mode("overwrite").partitionBy(keys[0]).json(path)


def points(events: DataFrame, districts: Sequence[str], epoch: str = "2023-01-01") -> DataFrame:
    """Compact in-district points: lat, lng, day index, district index, day/night code."""
    order = F.array(*[F.lit(d) for d in districts])
    return events.where(F.col("district").isin(*districts) & F.col("lat_e5").isNotNull()).select(
        "signal", "lat_e5", "lng_e5",
        tk.day_offset(F.col("day"), epoch).alias("day_idx"),
        (F.array_position(order, F.col("district")).cast("int") - 1).alias("district_idx"),
        F.when(tk.tod_bucket(F.col("hour")) == "day", 0).otherwise(1).alias("tod_code"),
    )


def write_points(events: DataFrame, path: str, districts: Sequence[str], epoch: str = "2023-01-01") -> None:
    points(events, districts, epoch).write.mode("overwrite").partitionBy("signal").parquet(path)


def decode_points(pts: DataFrame, districts: Sequence[str], epoch: str) -> DataFrame:
    """Points back to day and district name."""
    order = F.array(*[F.lit(d) for d in districts])
    return pts.withColumns({
        "day": F.date_add(F.lit(epoch).cast("date"), F.col("day_idx")),
        "district": F.get(order, F.col("district_idx")),
    })


def shard_key(id_col: str = "id") -> Column:
    """First two digits of the id padded to four."""
    text = F.col(id_col).cast("string")
    width = F.greatest(F.length(text), F.lit(4))
    return F.substring(F.lpad(text, width, F.lit("0")), 1, 2)


def write_sharded(df: DataFrame, path: str, id_col: str = "id") -> None:
    df.withColumn("shard", shard_key(id_col)).write.mode("overwrite").partitionBy("shard").parquet(path)


def update_shards(new: DataFrame, path: str, id_col: str = "id") -> list[str | None]:
    """Take a later load into a sharded table: its rows replace the stored rows of their ids, and only the shards
    that it falls in are read and written.  Returns those shards.

    The new state of the shards is written beside the table before any is replaced, and a load can be repeated after
    a failure with the same result.  Rows without an id form one shard and replace each other.  A load without rows
    changes nothing; a table that does not exist is created.
    """
    spark = new.sparkSession
    if not path_exists(spark, path):
        write_sharded(new, path, id_col)
        return sorted({r.shard for r in new.select(shard_key(id_col).alias("shard")).distinct().collect()}, key=str)
    load = materialize(new.withColumn("shard", shard_key(id_col)), "shard-load")
    stored = spark.read.parquet(path).columns
    if set(stored) != set(load.columns):
        raise ValueError(f"columns of the load {sorted(load.columns)} are not those stored {sorted(stored)}")
    touched = sorted((r.shard for r in load.select("shard").distinct().collect()), key=str)   # two characters each
    if not touched:
        return []
    named = [s for s in touched if s is not None]
    here = F.col("shard").isin(named) | (F.col("shard").isNull() if None in touched else F.lit(False))
    old = spark.read.schema(load.schema).parquet(path).where(here)
    ids = load.select(F.col(id_col).alias("_id")).distinct()
    kept = old.join(ids, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
    merged = materialize(kept.unionByName(load), "shard-merge")
    merged.hint("rebalance", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return touched


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, code) of a column, the code being the value's position in sorted order."""
    return global_rank(df.select(col).distinct(), [F.col(col)], f"{col}_code")


def dictionary_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add `<col>_code` for the columns the caller wants coded; null counts as ''."""
    out = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols})
    for c in cols:
        out = lookup_join(out, dictionary(out, c), [c])
    return out


def provenance(tagged: DataFrame, registry: Registry) -> DataFrame:
    """Records per signal beside its source, axis, goal and caveat; signals without records show 0."""
    rows = [(s.key, s.table, s.label, s.axis, s.goal, s.group, s.caveat) for s in registry.signals]
    meta = tagged.sparkSession.createDataFrame(
        rows, "signal string, source string, label string, axis string, goal string, group_key string, caveat string"
    )
    counts = tagged.groupBy("signal").agg(F.count(F.lit(1)).alias("records"))
    return meta.join(counts, "signal", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def provenance_filters(registry: Registry, spark) -> DataFrame:
    """The filter of every signal as Spark SQL text, and of every component of a combined filter; `component` is null
    for the whole.  Filters that are known as a Column only are left out."""
    rows = [
        (s.key, part, s.table, s.caveat, p.sql())
        for s in registry.signals for part, p in [(None, s.filter), *s.components] if not any(isinstance(leaf, Opaque) for leaf in p.leaves())
    ]
    return spark.createDataFrame(rows, "signal string, component string, source string, caveat string, filter string")


def audited(filters: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """provenance_filters with `records`: what the texts themselves, run as SQL over the named tables, count.  One pass
    a table: each text is one aggregate."""
    out = None
    for name, table in tables.items():
        texts = filters.where(F.col("source") == name).select("filter").distinct().collect()      # one row a signal
        if not texts:
            continue
        view = f"placetime_{name}"
        table.createOrReplaceTempView(view)
        counts = ", ".join(f"count_if({r['filter']}) AS c{k}" for k, r in enumerate(texts))
        one = table.sparkSession.sql(f"SELECT {counts} FROM {view}")
        one = one.select(F.explode(F.array(*[F.struct(F.lit(r["filter"]).alias("filter"), F.col(f"c{k}").alias("records")) for k, r in enumerate(texts)])).alias("x"))
        one = one.select(F.lit(name).alias("source"), "x.*")
        out = one if out is None else out.unionByName(one)
    return filters.join(out, ["source", "filter"])


def reproduce_total(table: str, cond: str, date_col: str, window: tuple[str, str], place: dict[str, str] | None = None) -> str:
    """Spark SQL text that recomputes one published total: the count in [from, to), at one place if given."""
    scope = "".join(f" AND {c} = {quoted(v)}" for c, v in (place or {}).items())
    return (
        f"SELECT count(*) AS reports FROM {table} WHERE {cond} AND {date_col} >= {quoted(window[0])} "
        f"AND {date_col} < {quoted(window[1])}{scope}"
    )


def reproduce_sql(
    table: str, cond: str, date_col: str, unit: str = "MM", district: str | None = None, place: dict[str, str] | None = None
) -> str:
    """Spark SQL text that recomputes a published monthly series, of a district or of one place (columns and values)."""
    scope = "".join(f" AND {c} = {quoted(v)}" for c, v in {**({"district": district} if district else {}), **(place or {})}.items())
    return (
        f"SELECT trunc({date_col}, '{unit}') AS month, count(*) AS reports FROM {table} "
        f"WHERE {cond}{scope} GROUP BY 1 ORDER BY 1"
    )


def group_members(groups: Sequence[Group], spark) -> DataFrame:
    rows = [(g.key, m) for g in groups for m in g.members]
    return spark.createDataFrame(rows, "group_key string, signal string")


def corner_map(corners: DataFrame) -> DataFrame:
    """Per-corner sparse month map; a corner has at most one entry per month."""
    return corners.groupBy("district", "corner").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ym", "n")))).alias("m"),
        F.sum("n").alias("total"),
    )


PRIVATE_COLUMNS = (
    "email", "cityEmailGuess", "precinct", "issue", "basis", "basis_types",
    "missed_servicing_rank", "needs_verification", "removal_requested", "uploaded_by",
)


def public_projection(df: DataFrame, full: bool = False) -> DataFrame:
    """Drop private columns unless the full form is asked for."""
    return df if full else df.drop(*PRIVATE_COLUMNS)


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Persist a table several jobs read, and read it back."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)



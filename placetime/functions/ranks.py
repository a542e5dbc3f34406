"""Exact order statistics and whole-table ranks without a one-task sort."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .numbers import rank_target


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir.  Only on a local master where that is unset,
    one temporary folder a session, set there and removed when Python ends."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="placetime-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", own)
        return own
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def run_dir(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"placetime-{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost
    executor costs a file read, not a recomputation."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """0-based position of each row in a total order, computed in parallel.

    Rows are range-partitioned and sorted, written once with (partition, row) positions,
    and shifted by the sizes of the preceding partitions.  `order` must end in a unique
    column so equal keys spread over partitions.
    """
    spark = df.sparkSession
    pid, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_pid", pid).withColumn("_row", row),
        "rank",
    )
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )  # one row per shuffle partition
    return placed.join(F.broadcast(starts), "_pid").select(
        *df.columns, (F.col("_start") + F.col("_row")).alias(out)
    )


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "pos") -> DataFrame:
    """0-based position of each row inside its key, for keys that may hold most of the rows:
    the global position minus the key's first one."""
    placed = global_rank(df, [*[F.col(k) for k in keys], *order], "_at")
    first = placed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_at").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(first, same).select(
        *df.columns, (F.col("_at") - F.col("_first")).alias(out)
    )


#: Keys that a range's bounds are taken from, a range.
SAMPLED = 20


def range_number(df: DataFrame, at: Column) -> Column:
    """Number of the range that the struct `at` falls in: ascending, nulls first, about as many ranges as shuffle partitions.

    Bounds are every SAMPLED-th of the keys with the smallest hashes, so the driver sees at most SAMPLED keys a
    range.  They only balance the work: any bounds give the same results.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = df.select(at.alias("k")).orderBy(F.xxhash64("k")).limit(parts * SAMPLED)
    found = [r.k for r in few.distinct().orderBy("k").collect()]
    fields = few.schema["k"].dataType.fields
    bounds = [found[i * len(found) // parts] for i in range(1, parts)] if len(found) > parts else found[1:]
    if not bounds:
        return F.lit(0)
    literal = lambda b: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, fields, strict=True)])
    return F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= at))


def _before(ranges: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Of (keys, _range, amount): what the lower ranges of the key hold (_before) and the whole key (_all)."""
    part = W.partitionBy(*keys)
    lower = part.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return ranges.select(
        *keys, "_range", F.coalesce(F.sum(amount).over(lower), F.lit(0)).alias("_before"), F.sum(amount).over(part).alias("_all"),
        F.count(F.lit(1)).over(part).alias("_parts"),
    )


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos", size: str | None = None) -> DataFrame:
    """0-based position of each row inside its key by ascending `order` (nulls first), and the key's row count as `size`.

    Two levels: rows are numbered inside (key, range), where a range is a slice of the order of all rows, and shifted
    by the counts of the key's lower ranges.  So a key that holds most rows is numbered by many tasks, rows are
    shuffled once and nothing is written.  Only keys that reach over a bound need the shift, at most two rows a
    range.  df is read three times (bounds, counts, rows) and must give the same rows each time; `order` should end
    in a unique column.
    """
    placed = df.withColumn("_range", range_number(df, F.struct(*keys, *order)))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    shift = _before(counts, keys, "_c").where("_parts > 1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), "_before", "_all",
    )
    own = W.partitionBy(*keys, "_range")
    numbered = placed.withColumn(out, F.row_number().over(own.orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1)
    if size:
        numbered = numbered.withColumn(size, F.count(F.lit(1)).over(own))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    total = [F.coalesce("_all", size).alias(size)] if size else []
    return numbered.join(F.broadcast(shift), same, "left").select(   # at most two rows a range
        *df.columns, (F.col(out) + F.coalesce("_before", F.lit(0))).alias(out), *total
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Histogram per key with running counts: columns keys, value, c, cum, n.

    Without keys the running counts are taken inside ranges of values and shifted by the sums of the lower ranges, so
    that no task sees the whole histogram.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    if keys:
        part = W.partitionBy(*keys)
        running = part.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        return hist.select(*keys, value, "c", F.sum("c").over(running).alias("cum"), F.sum("c").over(part).alias("n"))
    placed = hist.withColumn("_range", range_number(hist, F.struct(value)))
    sums = placed.groupBy("_range").agg(F.sum("c").alias("_c"))
    shift = _before(sums, [], "_c").withColumnRenamed("_range", "_r")   # one row a range
    running = W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    counted = placed.withColumn("cum", F.sum("c").over(running))
    return counted.join(F.broadcast(shift), F.col("_range") == F.col("_r")).select(
        value, "c", (F.col("cum") + F.col("_before")).alias("cum"), F.col("_all").alias("n")
    )


def nearest_rank(counts: DataFrame, keys: Sequence[str], value: str, **pcts: int) -> list[Column]:
    """Aggregates picking nearest-rank percentiles from a `value_counts` frame: the smallest
    value whose running count reaches the percentile's position."""
    return [
        F.min(F.when(F.col("cum") >= rank_target(F.col("n"), p), F.col(value))).alias(name)
        for name, p in pcts.items()
    ]

"""Incremental counterparts: dedup on arrival, tumbling counts, late-row policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ranks import run_dir
from ..functions.timekeys import instant, wall_clock


def read_events(
    spark: SparkSession, folder: str, schema, ts: str, glob: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Event files as a stream; the naive event time becomes an instant, read as UTC."""
    rows = (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )
    return rows.withColumn(ts, instant(F.col(ts)))


def dedup(events: DataFrame, id_col: str, ts: str, delay: str) -> DataFrame:
    """First row per id; an id is remembered for `delay` after its first event time."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def counts(events: DataFrame, ts: str, width: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Tumbling counts.  Seven-day windows start on Mondays.  In append mode a window is emitted once,
    when the watermark passes its end, and windows still open at the end are missing; `run_updates`
    has them all.  Rows later than the watermark are dropped and show up in numRowsDroppedByWatermark."""
    win = F.window(ts, width, width, "4 days") if width == "7 days" else F.window(ts, width)
    return (
        events.withWatermark(ts, delay).groupBy(win.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(wall_clock(F.col("w.start")).alias("start"), wall_clock(F.col("w.end")).alias("end"), *keys, "n")
    )


def settled_counts(events: DataFrame, ts: str, width: str, keys: Sequence[str], p90_lag_days: int) -> DataFrame:
    """Counts held back until the measured report lag has passed."""
    return counts(events, ts, width, keys, f"{int(p90_lag_days)} days")


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available into Parquet in the shared folder and return the result.
    Checkpoint and output live beside each other, so a restarted query continues exactly."""
    spark = stream.sparkSession
    base = run_dir(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class WindowTable:
    """A table that holds one row a window: later counts of a window replace earlier ones.

    Rows lie below batch=<number>/day=<day of the window's start>.  A micro-batch writes the days it touches whole: its
    own rows and those of the day's last version that it does not replace; readers take the newest version of each day.
    A batch that runs again after a stop writes its own folder again.  So the versions it was made from stay until the
    next batch begins, or until `settle` after the job has ended: both come after the batch is committed.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.columns = [f.name for f in schema.fields]
        self.stored = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, batch long, day date"

    def put(self, rows: DataFrame, number: int) -> None:
        """A micro-batch of counts.  Its rows are used three times but counted once; a day's rows go to one file."""
        self._drop_replaced(before=number)
        rows = rows.withColumn("day", F.to_date("start")).persist()
        fresh = rows
        if (old := self._newest(before=number)) is not None:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys]
            touched = old.join(rows.select("day").distinct(), "day", "left_semi")
            left = touched.alias("o").join(rows.alias("r"), same, "left_anti")
            fresh = rows.unionByName(left.select(*self.columns, "day"))
        fresh.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch={number}")
        rows.unpersist()

    def settle(self) -> None:
        """After the job has ended: only the newest version of each day stays."""
        self._drop_replaced()

    def rows(self) -> DataFrame:
        """Every window once."""
        found = self._newest()
        return self.spark.createDataFrame([], self.stored).select(*self.columns) if found is None else found.select(*self.columns)

    def _newest(self, before: int | None = None) -> DataFrame | None:
        folders = [n for n in self._batches() if before is None or n < before]
        if not folders:
            return None
        every = self.spark.read.option("basePath", self.path).schema(self.stored).parquet(*[f"{self.path}/batch={n}" for n in folders])
        if len(folders) == 1:
            return every
        last = every.groupBy("day").agg(F.max("batch").alias("batch"))       # partition values only
        return every.join(last, ["day", "batch"])

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _folders(self, path: str, prefix: str) -> list[str]:
        fs, at = self._files(path)
        if not fs.exists(at):
            return []
        return [name for f in fs.listStatus(at) if (name := f.getPath().getName()).startswith(prefix)]

    def _batches(self) -> list[int]:
        """Complete batches."""
        return sorted(int(n.removeprefix("batch=")) for n in self._folders(self.path, "batch=") if self._folders(f"{self.path}/{n}", "_SUCCESS"))

    def _drop_replaced(self, before: int | None = None) -> None:
        newer: set[str] = set()
        for number in reversed([n for n in self._batches() if before is None or n < before]):
            folder = f"{self.path}/batch={number}"
            days = set(self._folders(folder, "day="))
            gone = [folder] if days and days <= newer else [f"{folder}/{d}" for d in days & newer]
            for path in gone:
                fs, at = self._files(path)
                fs.delete(at, True)
            newer |= days


class Landing:
    """A folder that event files arrive in, and jobs over it that may be stopped between arrivals."""

    def __init__(self, spark: SparkSession, label: str, schema, ts: str):
        self.spark, self.base, self.schema, self.ts = spark, run_dir(spark, label), schema, ts
        self.arrived = 0

    def add(self, rows: DataFrame) -> None:
        """More files, of as many tasks as rows has."""
        rows.write.parquet(f"{self.base}/in/arrival={self.arrived}")
        self.arrived += 1

    def stream(self) -> DataFrame:
        return read_events(self.spark, f"{self.base}/in/*", self.schema, self.ts)

    def run(self, stream: DataFrame, put=None, mode: str = "append") -> list[dict]:
        """Process what has arrived since the last run, go on from its state, and stop; the progress of each batch."""
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True)
        if put:
            query = writer.foreachBatch(put).start()
        else:
            query = writer.format("parquet").option("path", f"{self.base}/out").start()
        query.awaitTermination()
        return [p.asDict() if hasattr(p, "asDict") else dict(p) for p in query.recentProgress]

    def out(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/out")


def run_updates(arrivals: Sequence[DataFrame], schema, ts: str, plan, keys: Sequence[str], label: str) -> DataFrame:
    """The last count of every window, open ones included: arrivals come one after the other, the job is stopped and
    started again between them."""
    landing = Landing(arrivals[0].sparkSession, label, schema, ts)
    table = None
    for rows in arrivals:
        landing.add(rows)
        counted = plan(landing.stream())
        table = table or WindowTable(landing.spark, f"{landing.base}/windows", counted.schema, keys)
        landing.run(counted, table.put, "update")
        table.settle()
    return table.rows()


def hold_back(arrivals: Sequence[DataFrame], schema, ts: str, width: str, keys: Sequence[str], delay_days: int, label: str) -> tuple[DataFrame, list[dict]]:
    """What a hold-back of `delay_days` does to rows as they arrive: (keys, emitted, held, dropped) and one entry a
    run with the rows that the stream itself counted and its watermark.

    emitted: rows of windows that the watermark has passed, which appear in the append-mode output.  held: rows of windows
    still open, which the running state has.  dropped: rows that came after their window had gone; by keys they are
    what arrived less what was counted, and in all they must equal the stream's own count.
    """
    landing = Landing(arrivals[0].sparkSession, label, schema, ts)
    table, seen = None, []
    for rows in arrivals:
        landing.add(rows)
        watched = landing.stream().observe("arrived", F.count(F.lit(1)).alias("rows"))
        counted = settled_counts(watched, ts, width, keys, delay_days)
        table = table or WindowTable(landing.spark, f"{landing.base}/windows", counted.schema, ["start", *keys])
        progress = landing.run(counted, table.put, "update")
        table.settle()
        observed = [p["observedMetrics"]["arrived"] for p in progress if "arrived" in (p.get("observedMetrics") or {})]
        marks = [p["eventTime"]["watermark"] for p in progress if "watermark" in (p.get("eventTime") or {})]
        seen.append({"rows": sum(o["rows"] for o in observed), "watermark": max(marks, default=None)})
    mark = F.lit(seen[-1]["watermark"][:19] if seen[-1]["watermark"] else "1970-01-01T00:00:00").cast("timestamp_ntz")
    windows = table.rows().groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("end") <= mark, F.col("n"))), F.lit(0)).alias("emitted"),
        F.coalesce(F.sum(F.when(F.col("end") > mark, F.col("n"))), F.lit(0)).alias("held"),
    )
    came = landing.spark.read.schema(schema).parquet(f"{landing.base}/in/*").groupBy(*keys).agg(F.count(F.lit(1)).alias("_came"))
    none = F.lit(0).cast("long")
    counted = came.join(windows, list(keys), "left").select(*keys, F.coalesce("emitted", none).alias("emitted"), F.coalesce("held", none).alias("held"), "_came")
    return counted.withColumn("dropped", F.col("_came") - F.col("emitted") - F.col("held")).drop("_came"), seen


def with_closed(windows: DataFrame, newest: Column, delay: str) -> DataFrame:
    """Flags windows that the final watermark has passed; later rows cannot change these."""
    return windows.withColumn("closed", F.col("end") <= newest - F.expr(f"interval {delay}"))


def late_rows(rows: DataFrame, event: str, arrival: str, delay_days: int | Column, keys: Sequence[str]) -> DataFrame:
    """Batch audit of a delay: rows that would arrive in time and too late under it."""
    lag = F.datediff(F.col(arrival), F.col(event))
    return rows.where(lag >= 0).groupBy(*keys).agg(
        F.count_if(lag <= delay_days).alias("in_time"), F.count_if(lag > delay_days).alias("late")
    )

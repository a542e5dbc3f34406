from helpers import rows
from pyspark.sql import functions as F

from placetime.streaming import jobs

SCHEMA = "id long, ts timestamp_ntz, signal string"


def files(spark, path, batches):
    """One file per batch, in arrival order."""
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "id long, t string, signal string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "signal")
        df.coalesce(1).write.mode("append").parquet(f"{path}/b{i}")


def stream(spark, path):
    return jobs.read_events(spark, f"{path}/*", spark.createDataFrame([], SCHEMA).schema, "ts", files_per_batch=1)


def test_stream_equals_batch_when_the_delay_covers_lateness(spark, tmp_path):
    batches = [[(1, "2024-01-01 01:00:00", "a"), (2, "2024-01-02 01:00:00", "a")], [(3, "2024-01-01 02:00:00", "a")], [(4, "2024-01-30 00:00:00", "a")]]
    files(spark, tmp_path, batches)
    got = jobs.run_available(jobs.counts(stream(spark, tmp_path), "ts", "1 day", ["signal"], "5 days"), "t")
    assert [(str(r[0])[:10], r[1]) for r in rows(got, "start", "n")] == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_late_rows_beyond_the_delay_are_left_out(spark, tmp_path):
    # lateness is judged by the watermark of the batch before, hence the batch in between
    days = ["2024-01-10 00", "2024-01-20 00", "2024-01-21 00", "2024-01-10 05", "2024-02-20 00"]
    batches = [[(i, f"{d}:00:00", "a")] for i, d in enumerate(days)]
    files(spark, tmp_path, batches)
    got = jobs.run_available(jobs.counts(stream(spark, tmp_path), "ts", "1 day", ["signal"], "1 day"), "t")
    by_day = {str(r[0])[:10]: r[1] for r in rows(got, "start", "n")}
    assert by_day["2024-01-10"] == 1 and by_day["2024-01-20"] == 1


def test_weeks_start_on_monday(spark, tmp_path):
    files(spark, tmp_path, [[(1, "2024-01-07 23:00:00", "a"), (2, "2024-01-08 00:00:00", "a"), (3, "2024-03-01 00:00:00", "a")]])
    got = jobs.run_available(jobs.settled_counts(stream(spark, tmp_path), "ts", "7 days", ["signal"], 2), "t")
    assert [(str(r[0])[:10], r[1]) for r in rows(got, "start", "n")] == [("2024-01-01", 1), ("2024-01-08", 1)]


def test_dedup_across_files(spark, tmp_path):
    files(spark, tmp_path, [[(1, "2024-01-01 00:00:00", "a")], [(1, "2024-01-01 00:00:00", "b"), (2, "2024-01-01 01:00:00", "a")]])
    got = jobs.run_available(jobs.dedup(stream(spark, tmp_path), "id", "ts", "1 day").select("id"), "t")
    assert rows(got) == [(1,), (2,)]


def test_late_report(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-02"), ("2024-01-01", "2024-01-09"), ("2024-01-05", "2024-01-01")], "a string, b string")
    r = jobs.late_rows(df.select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), F.lit(1).alias("k")), "a", "b", 3, ["k"]).first()
    assert (r["in_time"], r["late"]) == (1, 1)


WINDOWS = "start timestamp_ntz, end timestamp_ntz, signal string, n long"


def windows(spark, *data):
    rows_ = [(f"{d} 00:00:00", s, n) for d, s, n in data]
    df = spark.createDataFrame(rows_, "t string, signal string, n long")
    start = F.col("t").cast("timestamp_ntz")
    return df.select(start.alias("start"), F.expr("cast(t as timestamp_ntz) + interval 1 day").alias("end"), "signal", "n")


def kept(table):
    return [(str(r[0])[:10], r[1], r[2]) for r in rows(table.rows(), "start", "signal", "n")]


def test_window_table_holds_one_row_a_window(spark, tmp_path):
    import os

    table = jobs.WindowTable(spark, str(tmp_path / "w"), windows(spark, ("2024-01-01", "a", 1)).schema, ["start", "end", "signal"])
    assert kept(table) == []
    table.put(windows(spark, ("2024-01-01", "a", 1), ("2024-01-01", None, 4), ("2024-01-02", "a", 2)), 0)
    table.put(windows(spark, ("2024-01-01", "a", 3), ("2024-01-03", "b", 1)), 1)
    want = [("2024-01-01", "a", 3), ("2024-01-01", None, 4), ("2024-01-02", "a", 2), ("2024-01-03", "b", 1)]
    assert sorted(kept(table), key=str) == sorted(want, key=str)
    table.put(windows(spark, ("2024-01-01", "a", 3), ("2024-01-03", "b", 1)), 1)       # the same batch after a stop
    assert sorted(kept(table), key=str) == sorted(want, key=str)
    os.makedirs(tmp_path / "w" / "batch=2")                                            # a batch that never finished
    assert sorted(kept(table), key=str) == sorted(want, key=str)
    table.put(windows(spark, ("2024-01-01", None, 5)), 2)
    assert ("2024-01-01", None, 5) in kept(table) and len(kept(table)) == 4
    table.put(windows(spark, ("2024-01-02", "a", 9)).where("false"), 3)
    assert len(kept(table)) == 4
    table.settle()
    assert spark.read.parquet(str(tmp_path / "w")).count() == 4 == len(kept(table)), "only the newest version of a day stays"


def parts_of(spark, batches):
    return [spark.createDataFrame(b, "id long, t string, signal string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "signal") for b in batches]


def test_counts_go_on_after_a_stop(spark):
    batches = [[(1, "2024-01-01 01:00:00", "a"), (2, "2024-01-02 01:00:00", "a")], [(3, "2024-01-01 02:00:00", "a"), (4, "2024-01-02 03:00:00", "b")], [(5, "2024-01-02 23:00:00", "a")]]
    parts = parts_of(spark, batches)
    got = jobs.run_updates(parts, parts[0].schema, "ts", lambda s: jobs.counts(s, "ts", "1 day", ["signal"], "5 days"), ["start", "end", "signal"], "t")
    assert [(str(a)[:10], s, n) for a, s, n in rows(got, "start", "signal", "n")] == [("2024-01-01", "a", 2), ("2024-01-02", "a", 2), ("2024-01-02", "b", 1)]


def test_dedup_goes_on_after_a_stop(spark):
    parts = parts_of(spark, [[(1, "2024-01-01 00:00:00", "a")], [(1, "2024-01-01 00:00:00", "b"), (2, "2024-01-01 01:00:00", "a")], [(2, "2024-01-01 01:00:00", "a"), (3, "2024-01-02 00:00:00", "c")]])
    landing = jobs.Landing(spark, "t", parts[0].schema, "ts")
    for p in parts:
        landing.add(p)
        out = jobs.dedup(landing.stream(), "id", "ts", "1 day").select("id", "signal")
        landing.run(out)
    assert rows(landing.out(out.schema)) == [(1, "a"), (2, "a"), (3, "c")]


def test_hold_back_equals_its_batch_form(spark):
    import datetime as dt
    import random

    rnd, day = random.Random(2), dt.datetime(2024, 1, 1)
    batches = [[(k, str(day + dt.timedelta(days=10 * b + rnd.randint(-25, 9), hours=rnd.randrange(24))), rnd.choice("abc")) for k in range(60)] for b in range(4)]
    parts = parts_of(spark, batches)
    found, seen = jobs.hold_back(parts, parts[0].schema, "ts", "1 day", ["signal"], 6, "t")
    want, mark = {}, None
    state = []
    for b in batches:
        stamps = [(dt.datetime.fromisoformat(t), s) for _, t, s in b]
        for ts, s in stamps:
            last = dt.datetime(ts.year, ts.month, ts.day) + dt.timedelta(days=1)
            own = want.setdefault(s, [0, 0, 0])
            if mark and last <= mark:
                own[2] += 1
            else:
                state.append((last, s))
        mark = max([m for m in (mark,) if m] + [ts - dt.timedelta(days=6) for ts, _ in stamps])
    for last, s in state:
        want[s][last > mark] += 1
    assert {r.signal: [r.emitted, r.held, r.dropped] for r in found.collect()} == want
    assert sum(w[2] for w in want.values()) > 0 and [s["rows"] for s in seen] == [60] * 4
    assert [s["watermark"] for s in seen] == sorted(s["watermark"] for s in seen)


def test_window_table_counts_a_batch_once_and_writes_a_file_a_day(spark, tmp_path):
    """A micro-batch of many tasks is evaluated once, and each of its days becomes one file."""
    from glob import glob

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def watched(n):
        seen.add(1)
        return n

    def batch(days, n):
        start = F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % {days} as int))")
        return spark.range(0, days * 4, 1, 8).select(start.alias("start"), (F.col("id") / days).cast("int").alias("key"), watched(F.lit(n)).alias("n"))

    table = jobs.WindowTable(spark, str(tmp_path / "windows"), batch(3, 1).schema, ["start", "key"])
    table.put(batch(3, 1), 0)
    table.put(batch(2, 5), 1)
    assert seen.value == 12 + 8
    assert [len(glob(f"{tmp_path}/windows/batch=1/day=*")), len(glob(f"{tmp_path}/windows/batch=1/day=*/*.parquet"))] == [2, 2]
    assert sorted(r.n for r in table.rows().collect()) == [1] * 4 + [5] * 8

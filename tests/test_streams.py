"""Call numbers on streams: out-of-order and late calls, heartbeats, restart from the checkpoint."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskframe.operators import telemetry
from riskframe.streaming import telemetry as streams

SCHEMA = "collector string, at timestamp, id long"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + dt.timedelta(minutes=minutes)


def arrive(spark, path, rows):
    """One run over what has arrived since the last one."""
    data = [(c, at(m), i) for c, m, i in rows]
    spark.createDataFrame(data, SCHEMA).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    streams.run_numbering(stream, f"{path}/out", f"{path}/ck", collector="collector", time="at", event_id="id", delay_seconds=600)


def results(spark, path):
    out = spark.read.parquet(f"{path}/out")
    return sorted(((r["collector"], r["id"], r["invocation_count"], r["late"]) for r in out.collect()), key=repr)


def test_numbers_follow_time_and_late_calls_are_set_aside(spark, tmp_path):
    path = str(tmp_path)
    arrive(spark, path, [("a", 5, 2), ("a", 20, 3), ("a", 5, 1), ("b", 0, 10), (None, 3, 20)])
    # 12 is younger than the clock of a (20 - 10), 9 is not; a repeated row counts twice
    arrive(spark, path, [("a", 12, 4), ("a", 9, 5), ("b", 1, 11), ("b", 1, 11), ("a", None, 6)])
    arrive(spark, path, [("a", 60, None), ("b", 60, None), (None, 60, None)])
    want = [
        ("a", 1, 1, False), ("a", 2, 2, False), ("a", 4, 3, False), ("a", 3, 4, False), ("a", 5, None, True),
        ("a", 6, None, True), ("b", 10, 1, False), ("b", 11, 2, False), ("b", 11, 3, False), (None, 20, 1, False),
    ]
    assert results(spark, path) == sorted(want, key=repr)


def test_calls_wait_until_the_clock_passes_them(spark, tmp_path):
    path = str(tmp_path)
    arrive(spark, path, [("a", 0, 1), ("a", 5, 2)])
    assert results(spark, path) == []
    arrive(spark, path, [("a", 12, None)])
    assert results(spark, path) == [("a", 1, 1, False)]


def test_numbers_equal_those_of_the_whole_table(spark, tmp_path):
    path = str(tmp_path)
    rows = [(f"c{i % 3 if i % 4 else 0}", (i * 37) % 101, i) for i in range(120)]
    parts = [[r for r in rows if (r[1] + r[2] % 9) // 40 == k] for k in range(3)]
    assert sum(map(len, parts)) == len(rows)
    for part in parts:
        arrive(spark, path, part)
    arrive(spark, path, [(f"c{i}", 500, None) for i in range(3)])
    table = spark.createDataFrame([(c, at(m), i) for c, m, i in rows], SCHEMA)
    batch = telemetry.with_invocation_number(table, "collector", "at", ["id"])
    want = sorted(((r["collector"], r["id"], r["invocation_count"], False) for r in batch.collect()), key=repr)
    assert results(spark, path) == want


def test_an_empty_stream_gives_nothing(spark, tmp_path):
    path = str(tmp_path)
    arrive(spark, path, [("a", 0, 1)])
    spark.read.parquet(f"{path}/in").where(F.lit(False)).write.mode("append").parquet(f"{path}/in")
    assert results(spark, path) == []


def test_collectors_share_rows_of_state(spark, tmp_path):
    """3,000 collectors in 5 rows of state: every number and type is kept, state does not grow by collectors."""
    path, n = str(tmp_path), 3_000
    big = 2**60  # beyond what a double holds
    calls = spark.range(3 * n).select(
        F.when(F.col("id") % n > 0, F.col("id") % n + big).alias("who"),
        F.timestamp_seconds(F.col("id") * 7 % 5003 + 1_700_000_000).alias("at"), (F.col("id") + big).alias("id"),
    )
    beats = calls.groupBy("who").agg((F.max("at") + F.expr("INTERVAL 3 HOURS")).alias("at"), F.lit(None).cast("long").alias("id"))
    for part in (calls.where("id % 2 = 0"), calls.where("id % 2 = 1"), beats):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(calls.schema).parquet(f"{path}/in")
        streams.run_numbering(stream, f"{path}/out", f"{path}/ck", collector="who", time="at", event_id="id", delay_seconds=9000, buckets=5)
    got = spark.read.parquet(f"{path}/out")
    want = telemetry.with_invocation_number(calls, "who", "at", ["id"])
    assert got.where("late").count() == 0 and got.schema["who"].dataType == calls.schema["who"].dataType
    assert got.select("who", "at", "id", "invocation_count").exceptAll(want).count() == 0 and got.count() == want.count() == 3 * n
    state = spark.read.format("statestore").load(f"{path}/ck")
    assert state.count() == 5

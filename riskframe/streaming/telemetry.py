"""Windowed telemetry over a stream of scoring events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import summary_columns
from ..session import ship_package

# of each collector of a bucket, the clock: time up to which calls are numbered; numbered: calls so far;
# waiting: how many of the times and ids, which stand in the order of the collectors, are its own
NUMBERING_STATE = (
    "collectors array<string>, clocks array<long>, numbered array<long>, waiting array<long>, times array<long>, ids array<long>"
)
BUCKETS = 4_096  # buckets of collectors that share a row of state


def windowed_telemetry(
    events: DataFrame, window: str = "1 day", watermark: str = "1 hour", by: tuple[str, ...] = ("event_type",)
) -> DataFrame:
    """Counts per tumbling window of event time; later events than the watermark are dropped."""
    counted = (
        events.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", window).alias("window"), *by)
        .agg(*summary_columns())
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
        *[c for c in counted.columns if c not in ("window", *by)],
    )


def start_event_sink(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append events to JSON-lines files, exactly once."""
    return (
        events.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_windowed_telemetry(
    events: DataFrame, output: str, checkpoint: str, mode: str = "update", **options
) -> None:
    """Run over everything available; each micro-batch replaces its own ``batch_id`` partition.

    In update mode a batch writes the windows it changed (``latest_windows`` reads the last
    state of each), in append mode the windows that the watermark closed. Both forget closed
    windows, so the state stays bounded, and a batch that is run again leaves no duplicates.
    """
    if mode not in ("update", "append"):
        raise ValueError("mode must be update or append")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    query = (
        windowed_telemetry(events, **options)
        .writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_windows(written: DataFrame, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The last state of every window of a table that update mode wrote."""
    keys = ["window_start", "window_end", *by]
    values = [c for c in written.columns if c not in (*keys, "batch_id")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("last"))
    return last.select(*keys, "last.*")


def _due(state: tuple, arrived: list[tuple[int, int | None]], delay: int) -> tuple[tuple, list[tuple]]:
    """One micro-batch of a collector: its state afterwards and the rows it gives.

    ``arrived`` holds (microseconds, id); an id of None moves the clock only. The clock is
    the latest time seen, less the delay, and never goes back. Waiting calls up to the
    clock are numbered by time, then id; a call at or before the clock of an earlier batch is late.
    """
    clock, numbered, times, ids = state
    waiting = list(zip(times, ids))
    late = [(i, t, None, True) for t, i in arrived if i is not None and t <= clock]
    waiting += [(t, i) for t, i in arrived if i is not None and t > clock]
    clock = max([clock, *[t - delay for t, _ in arrived]])
    due = sorted(w for w in waiting if w[0] <= clock)
    rows = [(i, t, numbered + k, False) for k, (t, i) in enumerate(due, 1)]
    rest = [w for w in waiting if w[0] > clock]
    return (clock, numbered + len(due), [t for t, _ in rest], [i for _, i in rest]), rows + late


def _unpacked(state: tuple) -> dict[str | None, tuple]:
    """Collector -> ``(clock, numbered, times, ids)`` of a bucket's state."""
    collectors, clocks, numbered, waiting, times, ids = state
    out, begin = {}, 0
    for name, clock, n, size in zip(collectors, clocks, numbered, waiting):
        out[name] = (clock, n, times[begin : begin + size], ids[begin : begin + size])
        begin += size
    return out


def _packed(held: dict[str | None, tuple]) -> tuple:
    clocks, numbered, times, ids = zip(*held.values()) if held else ((),) * 4
    joined = [[v for part in parts for v in part] for parts in (times, ids)]
    return list(held), list(clocks), list(numbered), [len(t) for t in times], *joined


def _as_text(collector: str, kind: T.DataType) -> tuple[Column, Callable[[Column], Column]]:
    """A collector as a string, and the way back to its type."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError("a collector must be of a plain type")
    value = F.col(collector)
    if isinstance(kind, T.BinaryType):
        return F.hex(value), F.unhex
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string"), lambda c: F.timestamp_micros(c.cast("long"))
    if isinstance(kind, T.FractionalType):
        value = value + F.lit(0).cast(kind)  # -0.0 is 0.0
    return value.cast("string"), lambda c: c.cast(kind)


def numbered_stream(
    events: DataFrame, collector: str, time: str, event_id: str, delay_seconds: float = 3600.0, buckets: int = BUCKETS
) -> DataFrame:
    """``(collector, event_id, time, invocation_count, late)``: the running call number of a stream.

    Calls are numbered by their time, not by their arrival, so numbers equal those of
    ``with_invocation_number`` on the whole table (ties by id) as long as no call arrives more than
    the delay after a later one of its collector. Such a late call is set aside: it keeps a NULL
    number, and the numbers given before stay. State is kept for each collector: its clock, its
    last number and the calls that are not older than the delay, so its size depends on the
    rate of calls, not on the length of the stream. An event without an id is a heartbeat: it moves the
    clock of its collector and releases what waits. Events without a time are set aside as late;
    those without a collector are one collector. Repeated rows count as often as they occur.

    Collectors share a row of state by the hash of their name, as a call of Python for each of
    them costs more than its events; ``buckets`` stays what it was while a checkpoint is used.
    """
    ship_package(events.sparkSession)
    delay = int(delay_seconds * 1_000_000)
    text, back = _as_text(collector, events.schema[collector].dataType)
    micros, number = F.unix_micros(time), F.col(event_id).cast("long")
    # whole numbers without NULL reach Python as they are
    rows = events.select(
        F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("collector"),
        F.coalesce(micros, F.lit(0)).alias("micros"), F.coalesce(number, F.lit(0)).alias("id"),
        micros.isNotNull().alias("timed"), number.isNull().alias("beat"),
    )
    schema = "collector string, id long, micros long, invocation_count long, late boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get) if state.exists else {}
        arrived: dict[str | None, list] = {}
        out = []
        for batch in batches:
            for name, micros, i, timed, beat in zip(*(batch[c].tolist() for c in ("collector", "micros", "id", "timed", "beat"))):
                if timed:
                    arrived.setdefault(name, []).append((micros, None if beat else i))
                elif not beat:
                    out.append((name, i, None, None, True))
        for name, calls in arrived.items():
            held[name], numbered = _due(held.get(name, (-(2**62), 0, [], [])), calls, delay)
            out += [(name, *row) for row in numbered]
        state.update(_packed(held))
        if out:
            names = ("collector", "id", "micros", "invocation_count", "late")
            yield pd.DataFrame({c: np.array(values, dtype=object) for c, values in zip(names, zip(*out))}, copy=False)

    numbered = rows.groupBy("bucket").applyInPandasWithState(
        step, schema, NUMBERING_STATE, "append", GroupStateTimeout.NoTimeout
    )
    return numbered.select(
        back(F.col("collector")).alias(collector), F.col("id").alias(event_id), F.timestamp_micros("micros").alias(time), "invocation_count", "late"
    )


def run_numbering(events: DataFrame, output: str, checkpoint: str, **columns) -> None:
    """Number everything available; each micro-batch replaces its own ``batch_id`` partition.

    Started again with the same checkpoint it goes on with the state it had.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    query = (
        numbered_stream(events, **columns)
        .writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

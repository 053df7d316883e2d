"""Best-fit packing: best fit inside tasks, then rounds that merge the bins left underfull."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .common import written
from .tokens import SPACES, PieceEncoder

CAPACITY = 2048
END_ID = 0
NEARLY_FULL = 0.99  # a bin this full is final
ITEMS_PER_TASK = 20_000  # items that one best-fit run holds at once
MIN_GAIN = 0.01  # a round that merges fewer bins than this share is the last one
_WORD = re.compile(f"[^{SPACES}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """``encode(words)`` of one worker: little-endian 32-bit ids of each word.

    The tokenizer drops white space and never joins over it, so a text's ids are those of
    its words.
    """
    return PieceEncoder(path, lambda ids: np.array(ids, dtype="<u4").tobytes(), fold=True)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = _encoder(path), np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            rows, piece, start, ids = [], [], [], []
            for row, text in enumerate(part.column("__text").to_pylist()):
                content = b"".join(encode(_WORD.findall(text))) + end
                for i, at in enumerate(range(0, len(content), 4 * capacity)):
                    rows.append(row)
                    piece.append(i)
                    start.append(at // 4)
                    ids.append(content[at : at + 4 * capacity])
            out = part.drop_columns(["__text"]).take(pa.array(rows, pa.int64()))
            for name, values, kind in (
                ("piece", piece, pa.int32()),
                ("start", start, pa.int64()),
                ("length", [len(x) // 4 for x in ids], pa.int64()),
                ("ids", ids, pa.binary()),
            ):
                out = out.append_column(name, pa.array(values, kind))
            yield out


def token_pieces(
    docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Every text as pieces of at most ``capacity`` ids: ``piece start length ids`` beside its own columns.

    A text's ids are the tokenizer's, then ``end_id``; ``ids`` holds little-endian 32-bit
    numbers. A null text counts as empty: one piece with the end id. Columns named like the
    results are replaced.
    """
    ship_package(docs.sparkSession)
    path = path or default_tokenizer()
    kept = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids")]
    plain = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = docs.select(*kept).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids", "binary")):
        schema = schema.add(name, kind)
    return plain.mapInArrow(lambda batches: _pieces(batches, path, capacity, end_id), schema)


def best_fit(lengths: Sequence[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item: longest first, each into the fullest bin that has room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    rooms, count = 0, 0  # bit r is set if a bin has room r
    for i in order:
        n = lengths[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = count, capacity
            count += 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            with_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, level: int) -> Iterator[pa.RecordBatch]:
    """Best fit over up to ITEMS_PER_TASK rows at a time; bin numbers are unique to task and level."""
    first = (level << 56) + (TaskContext.get().partitionId() << 33)

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal first
        table = pa.Table.from_batches(held).combine_chunks()
        bins, offsets = best_fit(table.column("length").to_pylist(), capacity)
        numbers = np.array(bins, dtype=np.int64) + first
        first += max(bins, default=-1) + 1
        table = table.append_column("bin", pa.array(numbers)).append_column("offset", pa.array(offsets, pa.int64()))
        return table.to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, ITEMS_PER_TASK):
            part = batch.slice(begin, ITEMS_PER_TASK)
            if held and sum(b.num_rows for b in held) + part.num_rows > ITEMS_PER_TASK:
                yield run(held)
                held = []
            held.append(part)
    if held:
        yield run(held)


def _local(items: DataFrame, capacity: int, level: int) -> DataFrame:
    schema = StructType([*items.schema.fields]).add("bin", "long").add("offset", "long")
    return items.mapInArrow(lambda batches: _packed(batches, capacity, level), schema)


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``items`` (with a ``length`` of at most ``capacity``) with ``sequence_id`` and ``offset``.

    Tasks pack the rows they hold by best fit; bins nearly full, and those that not even the
    smallest other bin fits into, are final. The rest go up a tree as items of their own:
    each round deals them to as few tasks as hold them and packs again, until one task held
    them all or a round gains little. No task holds more than 20,000 items at once, and
    only bin numbers and lengths move. Every item gets a place; an empty table gives an
    empty one; columns named ``sequence_id``, ``offset`` or ``bin`` are replaced.
    """
    ship_package(items.sparkSession)
    placed = written(_local(items.drop("sequence_id", "offset", "bin"), capacity, 0), "packed")
    bins = placed.groupBy("bin").agg(F.sum("length").alias("length"))
    moved, level, full = None, 0, int(capacity * nearly_full)
    while True:
        level += 1
        under = written(bins.filter(F.col("length") < full), "underfull")
        seen = under.agg(F.min("length").alias("least"), F.count(F.lit(1)).alias("n")).first()
        if seen["n"] < 2:
            break
        # a bin that the smallest one does not fit into can take nothing
        open_bins = under.filter(F.col("length") + F.lit(seen["least"]) <= capacity)
        n_open = open_bins.count()
        if n_open < 2:
            break
        tasks = -(-n_open // ITEMS_PER_TASK)
        merged = written(
            _local(open_bins.withColumnRenamed("bin", "item").repartition(tasks), capacity, level), "merged"
        )
        step = merged.select(F.col("item").alias("from"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
        if moved is None:
            moved = step
        else:
            earlier = moved.join(
                step.select(F.col("from").alias("to"), F.col("to").alias("next"), F.col("shift").alias("more")), "to", "left"
            ).select("from", F.coalesce("next", "to").alias("to"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moved = written(earlier, "moved")
        bins = merged.groupBy("bin").agg(F.sum("length").alias("length"))
        if tasks == 1 or n_open - bins.count() < MIN_GAIN * n_open:
            break
    if moved is None:
        return placed.withColumnRenamed("bin", "sequence_id")
    columns = [c for c in placed.columns if c not in ("bin", "offset")]
    return placed.join(moved.withColumnRenamed("from", "bin"), "bin", "left").select(
        *columns,
        F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )

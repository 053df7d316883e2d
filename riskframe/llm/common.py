"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 2_000_000  # text handled at once by the array code of a task
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other letter stays as it is."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, between: str = SPACE_RUN) -> Column:
    """The words of a text; ``between`` matches what separates them."""
    return F.filter(F.split(text, between), lambda w: w != "")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives its executors.

    Shuffle files of the write are of no use afterwards and go at once, not only when the
    driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return durable(df, f"llm-{name}")
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def discarded(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing reads any more; what was written from them stays."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sort and merge only, where its rows grow with the input.

    Spark takes exploded rows, and those made by Python, for about as many as there were
    before, and files for as large in memory as on disk, and would broadcast them.
    """
    return df.hint("merge")


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts of about ``limit`` bytes, one text at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts in order: text number, first byte and end in it, 64-bit hash."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    begins = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
    inside = ~((joined == 32) | ((joined >= 9) & (joined <= 13)))
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    number = np.searchsorted(begins, first, side="right") - 1
    if not len(first):
        return number, first, end, np.zeros(0, dtype=np.uint64)
    length = end - first
    powers = np.full(int(length.max()), _ODD, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    values = (joined[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64) * _ODD)
    return number, first - begins[number], end - begins[number], hashes


def shingle_hashes(hashes: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and the run's first word."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    count = len(hashes) - size + 1
    total = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        total = total * _ODD + hashes[i : i + count]
    first = np.flatnonzero(number[:count] == number[size - 1 :])
    return mix(total[first]), first

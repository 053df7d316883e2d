"""Embedding whitening: exact covariance from bit planes, then whitening along its eigenvectors.

Entries become integers. Of a block of rows each dimension is shifted to start at zero and
cut into bit planes, packed across the rows into 64-bit words; the number of bits that two
planes share, weighted by their places, adds up to exact cross-products. Integers are
centred as integers and become floating-point numbers only for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

STEPS_PER_UNIT = 256
COMPONENTS = 4
BLOCK_ROWS = 4096  # rows whose bit planes are packed together
_LIMB = 32  # bits of a cross-product that are summed as one number
_BEYOND = 2.0**63


@dataclass
class Whitening:
    """Exact count and sums of the fit list, and of each component its direction and variance."""

    n: int
    sums: list[int]
    directions: np.ndarray  # a column for each component
    variances: np.ndarray
    trace: float


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of unsigned numbers (rows by dimensions): packed words, and of each plane its dimension and place."""
    n, dims = values.shape
    width = [int(x).bit_length() for x in values.max(axis=0)]
    dimension = np.repeat(np.arange(dims), width)
    place = np.concatenate([np.arange(w) for w in width]) if sum(width) else np.zeros(0, dtype=np.int64)
    padded = np.zeros((len(dimension), -(-n // 64) * 64), dtype=np.uint8)
    padded[:, :n] = (values.T[dimension] >> place[:, None].astype(np.uint64)) & np.uint64(1)
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64), dimension, place


def plane_products(planes: np.ndarray, dimension: np.ndarray, place: np.ndarray, dims: int) -> list[list[int]]:
    """Exact sum over rows of u_i u_j from popcounts of AND-ed planes, each weighted 2^(places)."""
    out = [[0] * dims for _ in range(dims)]
    if not len(dimension):
        return out
    first = np.flatnonzero(np.diff(dimension, prepend=-1))
    widest = int(place.max()) + 1
    exact = 2 * widest + int(planes.shape[1] * 64).bit_length() < 62
    weight = (1 << place) if exact else np.array([1 << int(p) for p in place], dtype=object)
    for a in range(len(dimension)):
        i = int(dimension[a])
        at = int(first[np.searchsorted(dimension[first], i)])  # from the plane's own dimension on
        shared = np.bitwise_count(planes[at:] & planes[a]).sum(axis=1, dtype=np.int64)
        starts = first[first >= at] - at
        sums = np.add.reduceat(shared * weight[at:], starts)
        for j, s in zip(dimension[at:][starts].tolist(), sums.tolist()):
            out[i][j] += s << int(place[a])
    return out


def block_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of each dimension and of each product of two (the upper triangle) over a block of rows."""
    n, dims = x.shape
    least = x.min(axis=0)
    shifted = x.view(np.uint64) - least.view(np.uint64)  # wraps to the true difference, however far apart
    planes, dimension, place = bit_planes(shifted)
    low, base = [int(v) for v in least], [0] * dims
    for d, p, ones in zip(dimension.tolist(), place.tolist(), np.bitwise_count(planes).sum(axis=1, dtype=np.int64).tolist()):
        base[d] += ones << p
    products = plane_products(planes, dimension, place, dims)
    for i in range(dims):
        for j in range(i, dims):
            products[i][j] += low[i] * base[j] + low[j] * base[i] + n * low[i] * low[j]
    return [s + n * m for s, m in zip(base, low)], products


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A number as limbs of 32 bits, all of its sign: their sums over many tasks stay within 64 bits."""
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if part := value & ((1 << _LIMB) - 1):
            yield limb, sign * part
        value, limb = value >> _LIMB, limb + 1


def to_steps(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as 64-bit integers."""
    return np.floor(values * STEPS_PER_UNIT).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row by the fewest bytes an entry that hold all of it, that number first: equal rows, equal bytes."""
    most = np.maximum(x.max(axis=1), ~x.min(axis=1))
    code = np.searchsorted(np.array([1 << 7, 1 << 15, 1 << 31], dtype=np.int64), most, side="right")
    out: list[bytes] = [b""] * len(x)
    for c in range(4):
        own = np.flatnonzero(code == c)
        cells = x[own].astype(f"<i{1 << c}")
        for row, r in enumerate(own.tolist()):
            out[r] = bytes([1 << c]) + cells[row].tobytes()
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype=np.int64)
    width = np.array([r[0] for r in rows])
    for c in (1, 2, 4, 8):
        own = np.flatnonzero(width == c)
        if len(own):
            out[own] = np.frombuffer(b"".join(rows[i][1:] for i in own.tolist()), dtype=f"<i{c}").reshape(len(own), dims)
    return out


def _integral(vector: str) -> tuple[Column, Column]:
    """The vector as doubles, and whether every entry is finite and within reach once multiplied."""
    v = F.col(vector).cast("array<double>")
    return v, v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) * STEPS_PER_UNIT < _BEYOND))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit_list(rows: DataFrame) -> DataFrame:
    """The distinct integer vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # copies inside a batch go here already
                yield pa.RecordBatch.from_arrays([pa.array(packed(to_steps(_matrix(batch.column(0)))), pa.binary()).unique()], ["x"])

    return rows.select("__vector").mapInArrow(run, "x binary").distinct()


def _statistics(fit_list: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Exact count, sums and cross-products of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for begin in range(0, len(rows), BLOCK_ROWS):
                part = rows[begin : begin + BLOCK_ROWS]
                n += len(part)
                s, p = block_products(unpacked(part, dims))
                sums = [a + b for a, b in zip(sums, s)]
                products = [[a + b for a, b in zip(x, y)] for x, y in zip(products, p)]
        cells = [(-1, -1, n), *((-1, j, s) for j, s in enumerate(sums))]
        cells += [(i, j, products[i][j]) for i in range(dims) for j in range(i, dims)]
        limbs = [(i, j, limb, part) for i, j, value in cells for limb, part in _limbs(value)] or [(-1, -1, 0, 0)]
        for at in range(0, len(limbs), 100_000):
            columns = zip(*limbs[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "limb", "value"])

    cells = fit_list.mapInArrow(run, "i long, j long, limb long, value long")
    n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for i, j, limb, value in cells.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).toArrow().to_pandas().itertuples(index=False):
        amount = int(value) << (_LIMB * int(limb))
        if i >= 0:
            products[i][j] += amount
        elif j >= 0:
            sums[j] += amount
        else:
            n += amount
    return n, sums, products


def whitening_of(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance; those without variance (beyond rounding) are left out."""
    dims = len(sums)
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # centred as integers; a quotient of integers is rounded once
            v[i, j] = v[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n) if n else 0.0
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(n * products[i][i] - sums[i] ** 2 for i in range(dims)) / (n * n) if n else 0.0
    real = int((values[:components] > max(trace, 0.0) * dims * np.finfo(float).eps).sum())
    vectors = vectors[:, :real]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(real)] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values[:real], trace)


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray | list[int]]:
    """x - S/n as doubles, and the exact sum of (n x - S)^2."""
    reach = max(1, model.n) * max(1, int(np.abs(x.astype(object)).max()) if len(x) else 1) + max(map(abs, model.sums), default=0)
    if reach**2 * x.shape[1] < 2**63:
        far = model.n * x - np.array(model.sums, dtype=np.int64)
        return far / model.n, (far * far).sum(axis=1)
    exact = [[model.n * v - s for v, s in zip(row, model.sums)] for row in x.tolist()]
    return np.array([[v / model.n for v in row] for row in exact]), [sum(v * v for v in row) for row in exact]


def whitened_values(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray | list[int]]:
    centred, deviation = _centred(x, model)
    return centred @ model.directions / np.sqrt(model.variances), deviation


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    k, dims = len(model.variances), len(model.sums)
    names = [f"w{c}" for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, _ = whitened_values(unpacked(batch.column(0).to_pylist(), dims), model)
                yield pa.RecordBatch.from_arrays([pa.array(values[:, c].copy()) for c in range(k)], names)

    rows = fit_list.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    # Spark's covar_pop keeps running means, so sums are centred before they are multiplied
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = rows.agg(*(F.covar_pop(names[a], names[b]) for a, b in pairs)).first()
    return max(abs(value - (a == b)) for value, (a, b) in zip(found, pairs))


_OUT = pa.list_(pa.float64())


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``rows`` with ``whitening``: ``struct(n, deviation, whitened[], explained[], identity_error)``.

    Every entry c becomes the integer floor(256 c). Count, sums and covariance are those of
    the distinct integer vectors, computed exactly: tasks add up popcounts of AND-ed bit
    planes, Spark adds the tasks' sums, the driver holds one matrix of dimensions by
    dimensions. ``whitened`` has an entry for each component, by falling variance, at most
    ``components`` (a component's sign makes its largest entry positive; components without
    variance do not count, so equal vectors give none); ``explained`` their shares of the
    variance. ``deviation`` is the sum of (n x - S)^2 as decimal(38,0), null beyond.

    Rows are dropped if their vector is null, empty, holds a null, non-finite or too large
    entry (|256 c| of 2^63 or more), or has another length than most (of equally frequent
    lengths, the smaller). Repeated rows are returned each and fitted once. An empty table
    gives an empty one; a column named ``whitening`` is replaced.
    """
    spark = rows.sparkSession
    ship_package(spark)
    v, good = _integral(vector)
    others = [c for c in rows.columns if c != "whitening"]
    plain = rows.select(*others, v.alias("__vector")).filter(good)
    common = plain.groupBy(F.size("__vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    kind = "struct<n:bigint,deviation:decimal(38,0),whitened:array<double>,explained:array<double>,identity_error:double>"
    if common is None:
        return rows.select(*others).limit(0).withColumn("whitening", F.lit(None).cast(kind))
    dims = common["dim"]
    alike = plain.filter(F.size("__vector") == dims)
    fit_list = written(_fit_list(alike), "fit-list")
    model = whitening_of(*_statistics(fit_list, dims), components)
    error = _identity_error(fit_list, model) if len(model.variances) else None
    shares = [float(e) / model.trace for e in model.variances]
    schema = alike.withColumn("__whitened", F.lit(None).cast("array<double>")).withColumn("__deviation", F.lit(None).cast("string")).drop("__vector").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__vector")
            if not batch.num_rows:
                continue
            values, deviation = whitened_values(to_steps(_matrix(batch.column(at))), model)
            out = batch.drop_columns(["__vector"]).append_column("__whitened", pa.array(list(values), _OUT))
            yield out.append_column("__deviation", pa.array([str(d) for d in (deviation.tolist() if isinstance(deviation, np.ndarray) else deviation)]))

    done = alike.mapInArrow(run, schema)
    value = F.struct(
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(__deviation AS decimal(38,0))").alias("deviation"),
        F.col("__whitened").alias("whitened"),
        F.array(*(F.lit(s) for s in shares)).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
    return done.select(*others, value.alias("whitening"))

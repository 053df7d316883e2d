"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Every row stands in one leaf of the tree. A query visits leaves in the order a priority
queue over node centres gives, as many as calibration found necessary, and is compared with
all rows of the leaves it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import written

K = 20
SAMPLE_CELLS = 1_000_000  # numbers (rows times dimensions) of the sample that the tree is fitted on
BRANCHES = 12
LEAF_SAMPLE = 16  # sample rows of a leaf
LLOYD_STEPS = 8
CALIBRATION_QUERIES = 200
TARGET_RECALL = 0.96  # of the calibration queries
BUCKETS = 64  # groups of neighbouring leaves: what a query is sent to
INDEX_CHUNK, QUERY_CHUNK = 1024, 256  # rows of a bucket that one task compares at once
SEED = 11
_LARGEST = 1.7976931348623157e308


@dataclass
class Tree:
    """Nodes in depth-first order: centre, children's numbers, and for leaves their number and bucket."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: np.ndarray  # leaf number of a node, -1 for inner nodes
    bucket: np.ndarray  # of each leaf
    scale: float  # vectors are divided by this before anything else
    radius: float  # largest norm after that

    @property
    def n_leaves(self) -> int:
        return len(self.bucket)


def lifted(vectors: np.ndarray, scale: float, radius: float) -> np.ndarray:
    """Vectors of equal length, with one more dimension: the nearest is then that of largest inner product."""
    x = vectors / scale
    return np.column_stack([x, np.sqrt(np.maximum(radius**2 - (x**2).sum(axis=1), 0))])


def lifted_queries(vectors: np.ndarray, radius: float) -> np.ndarray:
    """Queries as long as the longest row; their length does not change the order of the rows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    x *= radius / np.linalg.norm(x, axis=1, keepdims=True)
    return np.column_stack([x, np.zeros(len(x))])


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * (points @ centres.T)


def _cluster(points: np.ndarray, branches: int, random: np.random.Generator) -> np.ndarray:
    """Cluster number of each point after a few Lloyd steps."""
    centres = points[random.choice(len(points), branches, replace=False)]
    for _ in range(LLOYD_STEPS):
        own = _squared(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        size = np.bincount(own, minlength=branches)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return _squared(points, centres).argmin(axis=1)


def fit_tree(sample: np.ndarray, scale: float, radius: float) -> Tree:
    """Split the sample by k-means until a cluster is small or cannot be split."""
    random = np.random.default_rng(SEED)
    points = lifted(sample, scale, radius)
    centres: list[np.ndarray] = []
    children: list[list[int]] = []
    sizes: list[int] = []

    def grow(rows: np.ndarray) -> int:
        node = len(centres)
        centres.append(points[rows].mean(axis=0))
        children.append([])
        sizes.append(len(rows))
        if len(rows) > LEAF_SAMPLE:
            own = _cluster(points[rows], min(BRANCHES, len(rows)), random)
            parts = [rows[own == c] for c in np.unique(own)]
            if len(parts) > 1:
                children[node] = [grow(part) for part in parts]
        return node

    grow(np.arange(len(points)))
    inner = np.array([len(c) > 0 for c in children])
    leaf_of = np.where(inner, -1, np.cumsum(~inner) - 1)
    held = np.array(sizes)[~inner]
    bucket = np.minimum((np.cumsum(held) - held) * BUCKETS // max(1, held.sum()), BUCKETS - 1)
    return Tree(np.array(centres), children, leaf_of, bucket, scale, radius)


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point: at every node the child with the nearest centre."""
    out = np.zeros(len(points), dtype=np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if tree.leaf_of[node] >= 0:
            out[rows] = tree.leaf_of[node]
            continue
        own = _squared(points[rows], tree.centres[tree.children[node]]).argmin(axis=1)
        todo += [(int(child), part) for c, child in enumerate(tree.children[node]) if len(part := rows[own == c])]
    return out


def visits(tree: Tree, distance: np.ndarray, most: int, sizes: np.ndarray, least_rows: int) -> np.ndarray:
    """Leaves in best-bin-first order, given a query's distance to each node.

    The queue holds nodes by distance; an inner node gives way to its children. ``most``
    leaves, or more until they hold ``least_rows`` rows.
    """
    away, children = distance.tolist(), tree.children
    queue, found, rows = [(away[0], 0)], [], 0
    while queue and (len(found) < most or rows < least_rows):
        _, node = heapq.heappop(queue)
        if children[node]:
            for child in children[node]:
                heapq.heappush(queue, (away[child], child))
        else:
            found.append(node)
            if len(found) >= most:
                rows = sizes[tree.leaf_of[found]].sum()
    return tree.leaf_of[found]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, added from the first dimension to the last in double precision."""
    return np.cumsum(a * b, axis=1)[:, -1]


def best_of(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` best rows, more where the last ones (nearly) tie."""
    if not len(rows) or not len(queries):
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    rough = queries @ rows.T
    if rough.shape[1] > k:
        last = np.partition(rough, -k, axis=1)[:, -k]
        error = 1e-13 * rows.shape[1] * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
        query, row = np.nonzero(rough >= (last - error)[:, None])
    else:
        query, row = (x.ravel() for x in np.indices(rough.shape))
    return query, row, inner_products(queries[query], rows[row])


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Distinct ``(id, v)`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    plain = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) <= _LARGEST))
    return plain.filter(finite & F.exists("v", lambda c: c != 0)).distinct()


def _ranked(by: str, order: list[Column], most: int, rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most)


def _hashed(column: str, share: float) -> Column:
    """True for about this share of the values, by their hash."""
    return F.pmod(F.xxhash64(column, F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))


def _exact_neighbours(index: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best indexed vectors ``(query, leaf)`` of a bounded set of queries against all rows."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            query, row, score = best_of(shared.value, _matrix(batch.column(1)), k)
            for q, r, s in zip(query.tolist(), leaf[row].tolist(), score.tolist()):
                best.setdefault(q, []).append((s, r))
            best = {q: heapq.nlargest(k, x) for q, x in best.items()}
        rows = [(q, r, s) for q, x in best.items() for s, r in x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["query", "leaf", "score"])

    near = index.select("leaf", "v").mapInArrow(run, "query long, leaf long, score double")
    return _ranked("query", [F.desc("score"), F.asc("leaf")], k, near)


def calibrated_visits(tree: Tree, index: DataFrame, queries: np.ndarray, sizes: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit so that the calibration queries find ``target`` of their exact neighbours."""
    if not len(queries):
        return tree.n_leaves
    place = np.zeros((len(queries), tree.n_leaves), dtype=np.int64)
    distance = _squared(lifted_queries(queries, tree.radius), tree.centres)
    for q in range(len(queries)):
        place[q, visits(tree, distance[q], tree.n_leaves, sizes, 0)] = np.arange(tree.n_leaves)
    # a query finds itself as well, which says nothing
    true = _exact_neighbours(index, queries, k + 1).filter("rank > 1").select("query", "leaf").collect()
    needed = np.array([place[r["query"], r["leaf"]] for r in true])
    most = 1
    while most < tree.n_leaves and np.mean(needed < most) < target:
        most = min(tree.n_leaves, most + max(1, most // 8))
    return most


def _visited(queries: DataFrame, shared, most: int, least_rows: int) -> DataFrame:
    """Queries with the leaves they visit, a row for each bucket: ``bucket query v leaves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                distance = _squared(lifted_queries(_matrix(part.column(1)), tree.radius), tree.centres)
                row, bucket, leaves = [], [], []
                for q in range(part.num_rows):
                    found = np.sort(visits(tree, distance[q], most, sizes, least_rows))
                    for own in np.split(found, np.flatnonzero(np.diff(tree.bucket[found])) + 1):
                        row.append(q)
                        bucket.append(int(tree.bucket[own[0]]))
                        leaves.append(own)
                out = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket, pa.int32()), out.column(0), out.column(1), pa.array(leaves, pa.list_(pa.int64()))],
                    ["bucket", "query", "v", "leaves"],
                )

    return queries.select("id", "v").mapInArrow(run, "bucket int, query long, v array<double>, leaves array<long>")


def _chunks(rows: DataFrame, key: str, size: int, name: str, *columns: str) -> DataFrame:
    """Rows of a bucket packed into lists of about ``size``, dealt by the hash of ``key``."""
    counts = rows.groupBy("bucket").count()
    number = F.pmod(F.xxhash64(key), F.ceil(F.col("count") / size))
    dealt = rows.join(F.broadcast(counts), "bucket").withColumn("chunk", number)  # at most BUCKETS counts
    return dealt.groupBy("bucket", "chunk").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("chunk")


def _compared(pairs: DataFrame, k: int) -> DataFrame:
    """``(query, id, score)``: of each pair of chunks every query's best rows in the leaves it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, queries = batch.column(0)[i].values, batch.column(1)[i].values
                leaf, v, ids = rows.field("leaf").to_numpy(), _matrix(rows.field("v")), rows.field("ids")
                number, qv, visited = queries.field("query").to_numpy(), _matrix(queries.field("v")), queries.field("leaves")
                member = np.repeat(np.arange(len(number)), visited.value_lengths().to_numpy())
                goes = visited.flatten().to_numpy()
                order = np.argsort(leaf, kind="stable")
                edges = np.searchsorted(leaf[order], np.stack([goes, goes + 1]))
                # each query's rows side by side; unvisited leaves score nothing
                seen = np.zeros((len(number), len(leaf) + 1), dtype=np.int32)
                np.add.at(seen, (member, edges[0]), 1)
                np.add.at(seen, (member, edges[1]), -1)
                inside = np.cumsum(seen, axis=1)[:, :-1] > 0
                v = v[order]
                rough = np.where(inside, qv @ v.T, -np.inf)
                if rough.shape[1] > k:
                    error = 1e-13 * v.shape[1] * np.linalg.norm(qv, axis=1) * np.linalg.norm(v, axis=1).max()
                    inside &= rough >= (np.partition(rough, -k, axis=1)[:, -k] - error)[:, None]
                query, row = np.nonzero(inside)
                score = inner_products(qv[query], v[row])
                own = ids.take(pa.array(order[row]))
                length = own.value_lengths().to_numpy()
                out = [np.repeat(number[query], length), own.flatten().to_numpy(), np.repeat(score, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query", "id", "score"])

    return pairs.select("rows", "queries").mapInArrow(run, "query long, id long, score double")


def nearest(
    rows: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K,
    target: float = TARGET_RECALL, sample_cells: int = SAMPLE_CELLS,
) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's ``k`` rows of largest inner product, as far as found.

    Rows of equal vectors are one entry of the index, with their ``k + 1`` least ids (no
    result needs more). The tree is fitted on a sample of at most ``sample_cells`` numbers,
    chosen by the vectors' hash; all rows are indexed. About 200 queries, compared with all
    rows, tell how many leaves must be visited to find ``target`` of the true neighbours; a
    query visits more if these hold too few rows. Neighbouring leaves form 64 buckets; rows
    and queries meet by bucket in chunks of bounded size, and scores are inner products of
    the original vectors in double precision, added in the order of the dimensions.

    Vectors that are null, empty, all zero, or hold a null or non-finite component take no
    part, nor do rows without id or of another length than most vectors have (of equally
    frequent lengths, the smaller). A query's own rows (those of its id) are no candidates;
    ties go to the smaller id; a row given twice counts once; if an id has several vectors,
    each is a candidate and a query, and the best counts. Fewer candidates than ``k`` are all returned; no rows give
    no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    ship_package(spark)
    size = F.size("v")
    base = written(usable(rows, id_column, vector).withColumn("dim", size), "vectors")
    lengths = base.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale")
    ).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, scale = lengths["dim"], lengths["scale"]
    alike = base.filter(F.col("dim") == dim)
    entries = written(
        _ranked("v", [F.asc("id")], k + 1, alike.select("id", "v")).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")),
        "entries",
    )
    squares = F.aggregate(F.transform("v", lambda c: (c / scale) * (c / scale)), F.lit(0.0), lambda a, c: a + c)
    seen = entries.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(squares)).alias("radius")).first()
    share = min(1.0, 0.9 * sample_cells / dim / seen["n"])
    sample = _matrix(entries.filter(_hashed("v", share)).select("v").toArrow().column("v").combine_chunks())
    if not len(sample):
        sample = _matrix(entries.select("v").limit(1).toArrow().column("v").combine_chunks())
    tree = fit_tree(sample[np.lexsort(sample.T[::-1])], scale, seen["radius"])

    tree_only = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree_only.value
        for batch in batches:
            leaf = leaves_of(own, lifted(_matrix(batch.column(0)), own.scale, own.radius)) if batch.num_rows else np.zeros(0, dtype=int)
            columns = [pa.array(own.bucket[leaf], pa.int32()), pa.array(leaf, pa.int64()), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "leaf", "v", "ids"])

    index = written(entries.select("v", "ids").mapInArrow(place, "bucket int, leaf long, v array<double>, ids array<long>"), "index")
    sizes = np.zeros(tree.n_leaves, dtype=np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]

    asked = usable(queries, id_column, vector).filter(F.size("v") == dim)
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    some = asked.filter(_hashed("id", min(1.0, CALIBRATION_QUERIES / n_asked))).select("v").toArrow().column("v").combine_chunks()
    most = calibrated_visits(tree, index, _matrix(some) if len(some) else np.zeros((0, dim)), sizes, k, target)

    shared = spark.sparkContext.broadcast((tree, sizes))
    dealt = asked.repartition(min(10_000, -(-n_asked // QUERY_CHUNK)), "id")
    sent = written(_visited(dealt, shared, most, k + 1), "visits")
    pairs = _chunks(index, "v", INDEX_CHUNK, "rows", "leaf", "v", "ids").join(
        _chunks(sent, "query", QUERY_CHUNK, "queries", "query", "v", "leaves"), "bucket"
    )
    found = _compared(pairs, k + 1).filter("id != query")
    # an id with several vectors can come twice
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    return _ranked("query", [F.desc("score"), F.asc("id")], k, once).select(F.col("query").alias("query_id"), "rank", "id", "score")

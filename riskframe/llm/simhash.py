"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact links and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import blocks, never_broadcast, written
from .components import components

BITS = 64
SHINGLE = 4
MAX_DIFFERENT = 4
SEED = 42


def _shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-size]]
    return [joined[s:e] for s, e in zip(starts, ends[size - 1 :])]


def fingerprints(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if over half of the shingle hashes have it."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for block in blocks(texts):
        hashes, counts = [], []
        for text in texts[block]:
            own = _shingles(text, size)
            counts.append(len(own))
            hashes.extend([digest(s, SEED) for s in own])
        if not hashes:
            continue
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.array(counts)
        filled = np.flatnonzero(counts)
        begins = (np.cumsum(counts) - counts)[filled]
        votes = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        majority = (2 * votes > counts[filled, None]).astype(np.uint8)
        out[block.start + filled] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("__text").cast(pa.binary()).to_pylist()
        values = pa.array(fingerprints(texts, size).view(np.int64), pa.int64())
        yield batch.drop_columns(["__text"]).append_column("fingerprint", values)


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` without the text, with a long ``fingerprint``; a null text counts as empty (zero)."""
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "fingerprint")]
    plain = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = docs.select(*kept).schema.add("fingerprint", "long")
    return plain.mapInArrow(lambda batches: _fingerprinted(batches, size), schema)


def segments(count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` segments of about equal width."""
    edges = [i * bits // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(fingerprint: Column, segment: tuple[int, int]) -> Column:
    first, width = segment
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1))


def _different(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def passes_chain(a: Column, b: Column, start: Column, parts: list[tuple[int, int]], most: int) -> Column:
    """Whether the chain of segments from ``start`` stays within its proportional budgets.

    Of m segments around a ring, a pair within ``most`` bits has a start from which every
    chain of l segments differs in at most ``l * most / m`` bits.
    """
    m = len(parts)
    different = F.array(*(_different(_segment(a, s), _segment(b, s)) for s in parts))
    ok, total = F.lit(True), F.lit(0)
    for step in range(m):
        total = total + F.get(different, F.pmod(start + F.lit(step), F.lit(m)))
        ok = ok & (total <= (step + 1) * most // m)
    return ok


def candidate_keys(fp: DataFrame, parts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Index and probe rows: the columns of ``fp`` with ``start`` and ``key`` of chains of two segments.

    A chain's first segment must be equal and the first two may differ in one bit: the index
    holds both segments as they are, a probe also each variant of the second with one bit
    flipped.
    """
    m = len(parts)
    exact, variants = [], []
    for i in range(m):
        (_, width), follower = parts[i], parts[(i + 1) % m]
        joined = F.shiftleft(_segment(F.col("fingerprint"), follower), width).bitwiseOR(
            _segment(F.col("fingerprint"), parts[i])
        )
        exact.append(F.struct(F.lit(i).alias("start"), joined.alias("key")))
        flips = [0] + [1 << (width + b) for b in range(follower[1])]
        variants.append(
            F.transform(
                F.array(*(F.lit(f).cast("long") for f in flips)),
                lambda f: F.struct(F.lit(i).alias("start"), joined.bitwiseXOR(f).alias("key")),
            )
        )
    explode = lambda x: fp.select(*fp.columns, F.inline(x))
    return explode(F.array(*exact)), explode(F.concat(*variants))


def _bucket_links(index: DataFrame, most: int) -> DataFrame:
    """Links of each fingerprint to the least of its bucket, where these differ in at most ``most`` bits.

    Linear in the rows: a dense group of near copies shrinks to one label before any pairs
    are looked at.
    """
    heads = (
        index.groupBy("start", "key")
        .agg(F.min("fingerprint").alias("head"), F.max("fingerprint").alias("__other"))
        .filter("head != __other")
        .drop("__other")
    )
    return (
        never_broadcast(index).join(never_broadcast(heads), ["start", "key"])
        .filter((F.col("fingerprint") != F.col("head")) & (_different(F.col("fingerprint"), F.col("head")) <= most))
        .select(F.col("head").alias("a"), F.col("fingerprint").alias("b"))
        .distinct()
    )


def link_classes(distinct: DataFrame, most: int = MAX_DIFFERENT) -> DataFrame:
    """``(fingerprint, root)`` of every distinct fingerprint: equal roots if linked, directly or not.

    First, buckets of equal segment chains link to their head (linear). Then fingerprints
    whose labels still differ meet by pigeonring: two segments of a chain in the join key,
    the chain's other budgets and the full distance in the join's condition. Only links
    between different labels come out.
    """
    if not 2 <= most <= 15:
        raise ValueError("links of 2 to 15 bits only")
    parts = segments(most + 1)
    index, _ = candidate_keys(distinct, parts)
    first = written(components(_bucket_links(index, most)), "labels")
    labelled = written(
        distinct.join(never_broadcast(first.withColumnRenamed("node", "fingerprint")), "fingerprint", "left").select(
            "fingerprint", F.coalesce("root", "fingerprint").alias("label")
        ),
        "labelled",
    )
    index, probe = candidate_keys(labelled, parts)
    a, b = F.col("i.fingerprint"), F.col("p.fingerprint")
    met = (
        (F.col("i.start") == F.col("p.start"))
        & (F.col("i.key") == F.col("p.key"))
        & (F.col("i.label") != F.col("p.label"))
        & (a < b)
        & passes_chain(a, b, F.col("i.start"), parts, most)
        & (_different(a, b) <= most)
    )
    # 70 probe rows for each fingerprint
    both = never_broadcast(index).alias("i").join(never_broadcast(probe).alias("p"), met)
    links = both.select(F.col("i.label").alias("a"), F.col("p.label").alias("b"))
    second = components(links).withColumnRenamed("node", "label")
    return labelled.join(never_broadcast(second), "label", "left").select("fingerprint", F.coalesce("root", "label").alias("root"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    most: int = MAX_DIFFERENT,
) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row; the component is named by its least key.

    Rows link if their fingerprints differ in at most ``most`` bits (2 to 15). Equal
    fingerprints are counted once before anything is compared, so a group of copies of any
    size is one row. A null or empty text has fingerprint zero and links like any other; a
    null key is ignored when the component is named (null if it has no other); repeated rows
    come out once each; an empty table gives an empty one; other columns are left out.
    """
    own = written(with_fingerprint(docs.select(F.col(key).alias("__id"), F.col(text).alias("__body")), "__body", size), "fingerprints")
    distinct = written(own.groupBy("fingerprint").agg(F.min("__id").alias("least")), "distinct")
    rooted = written(link_classes(distinct.select("fingerprint"), most), "roots")
    names = distinct.join(never_broadcast(rooted), "fingerprint").groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(never_broadcast(names), "root").select("fingerprint", "component_id"), "components")
    return own.join(never_broadcast(named), "fingerprint").select(F.col("__id").alias(key), "fingerprint", "component_id")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MAX_DIFFERENT
) -> DataFrame:
    """One row of each component of near-duplicates, with its own columns.

    The row with the least key stays; rows without a key come after all others, and rows
    that share a key are told apart by a hash of their text. Of rows that share both, any
    one stays.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumn("__id", F.col(key)).withColumn("__hash", F.xxhash64(content, F.length(content)))
    own = written(
        with_fingerprint(marked.select("__id", "__hash", F.col(text).alias("__body")), "__body", size), "fingerprints"
    )
    copies = own.groupBy("__id", "__hash", "fingerprint").agg(F.count(F.lit(1)).alias("__rows"))
    rooted = written(link_classes(own.select("fingerprint").distinct(), most), "roots")
    first = F.min(F.struct(F.col("__id").isNull().alias("keyless"), "__id", "__hash", "__rows")).alias("first")
    winners = written(copies.join(never_broadcast(rooted), "fingerprint").groupBy("root").agg(first), "winners").select(
        F.col("first.__id").alias("__winner"), F.col("first.__hash").alias("__winner_hash"), "first.__rows"
    )
    same = F.col("__id").eqNullSafe(F.col("__winner")) & (F.col("__hash") == F.col("__winner_hash"))
    kept = marked.join(never_broadcast(winners), same)
    once = kept.filter("__rows = 1").unionByName(kept.filter("__rows > 1").dropDuplicates(["__id", "__hash"]))
    return once.select(*docs.columns)

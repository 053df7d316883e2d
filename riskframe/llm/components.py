"""Connected components of a distributed edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import never_broadcast, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges ``(a, b)`` with a < b.

    Large star: each node links its larger neighbours to the least of its neighbourhood.
    Small star: each node links itself and its smaller neighbours to the least of them.
    """
    if small:
        sided = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        sided = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = sided.join(never_broadcast(least), "u")
    if small:
        out = linked.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    else:
        out = linked.filter("v > u").select("v", "m")
    return out.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the links ``(a long, b long)``; root is the least node reachable.

    Every step is a grouped minimum, which combines before its shuffle, and a join; no
    neighbourhood is ever collected, and each step's edges are written, so a lost executor
    costs one step. Self-links and repeated links count once; no links give no rows.
    """
    ordered = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written(ordered, "edges")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = written(_stars(_stars(now, small=False), small=True), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )

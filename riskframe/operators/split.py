"""Exact stratified splits, folds and samples that depend on nothing but key and seed.

Rows are ordered within each class by the seeded hash of their key and cut into blocks of
exact size. The cuts are found by radix selection, so the data is neither sorted nor
shuffled and the final assignment is a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import class_counts, hash_cuts, key_hash, with_block

SEED = 42
TOP_ROWS = 10_000  # rows of a sample that are found as a top-k


def allocate(total: int, per_class: dict[int, int]) -> dict[int, int]:
    """Share ``total`` over the classes in proportion, remainders to the largest fractions."""
    n = sum(per_class.values())
    exact = {c: total * k / n for c, k in per_class.items()}
    share = {c: math.floor(v) for c, v in exact.items()}
    left = total - sum(share.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - share[c]), c))[:left]:
        share[c] += 1
    return share


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test: float = 0.30,
    val: float = 0.30,
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """Add train/val/test: ``test`` of all rows, then ``val`` of the remaining ones.

    Sizes are exact for unique keys. Rows that share a key stay together, so a size can be
    off by the rows of one key at most at each cut. A NULL key is an error.
    """
    counts = class_counts(df, label, key)
    if not counts:
        raise ValueError("nothing to split")
    n = sum(counts.values())
    n_test = math.ceil(test * n)
    in_test = allocate(n_test, counts)
    rest = {c: counts[c] - in_test[c] for c in counts}
    n_val = math.ceil(val * (n - n_test))
    in_val = allocate(n_val, rest) if n > n_test else {c: 0 for c in counts}
    cuts = hash_cuts(
        df, key, label, seed, {c: [in_test[c], in_test[c] + in_val[c]] for c in counts}
    )
    block = F.col("_block")
    return (
        with_block(df, key, label, seed, cuts, "_block")
        .withColumn(name, F.when(block == 0, "test").when(block == 1, "val").when(block == 2, "train"))
        .drop("_block")
    )


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1; class counts of unique keys differ by at most one between folds.

    Rows that share a key stay in one fold; a key with more rows than a fold holds fills it
    beyond its share and may leave the next one empty. A NULL key is an error.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    counts = class_counts(df, label, key)
    if not counts:
        raise ValueError("nothing to split")
    targets = {}
    for c, n in counts.items():
        sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
        targets[c] = [sum(sizes[: i + 1]) for i in range(k - 1)]
    cuts = hash_cuts(df, key, label, seed, targets)
    return with_block(df, key, label, seed, cuts, name)


def split_report(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """``(split, y, count, percent)``."""
    from .profile import value_share

    return value_share(df, label, [split]).withColumnRenamed("value", label)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement: those of least key hash, the same ones every time.

    A few rows are a top-k. Beyond 10,000, where a task would send as many rows to one other
    task, the hash of the n-th row is found from counts and rows are kept where they are.
    Rows with a NULL key are never taken; fewer than ``n`` rows are all returned.
    """
    named = df.where(F.col(key).isNotNull())
    h = key_hash(key, seed)
    if n <= TOP_ROWS:
        return named.orderBy(h).limit(n)
    counted = named.select(key, F.lit(0).alias("_class"))
    if counted.count() <= n:
        return named
    cut = hash_cuts(counted, key, "_class", seed, {0: [n]})[0][0]
    below = named.where(h < cut)
    # rows that share the last hash: as many as are left to take
    return below.unionByName(named.where(h == cut).limit(n - below.count()))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a named order."""
    return df.orderBy(*order).limit(n)


def leakage_audit(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``(check, ok, bad_keys)``: every key once, in one split, with a split."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(split).alias("lo"),
        F.max(split).alias("hi"),
    )
    row = per_key.agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("lo") != F.col("hi")).alias("overlap"),
        F.count_if(F.col("lo").isNull()).alias("unassigned"),
    )
    names = ["repeated", "overlap", "unassigned"]
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("check"), (F.col(n) == 0).alias("ok"), F.col(n).alias("bad_keys")
                    )
                    for n in names
                ]
            )
        ).alias("c")
    ).select("c.*")

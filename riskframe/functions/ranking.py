"""Exact order statistics without single-task windows.

Three tools, all exact and all free of a window over the whole table:

* ``running_totals`` - prefix sums along a column: rows are put in value ranges cut at
  approximate quantiles, ranges are summed and accumulated (a few thousand rows), and a
  window runs inside each range only. Balance depends on the quantiles, the result does not.
* ``hash_cuts`` - the r-th smallest key hash per class, by radix selection on the hex
  digits of the hash: each step is one narrow scan that counts 4,096 digit groups. Rows are
  then assigned to blocks by comparing their hash with literals: no shuffle of the data.
* ``exact_quantiles`` - brackets around the answer are cut into ranges by counts, round by
  round, until their ends are the answer: narrow scans, nothing is moved or ordered.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .expressions import literal_array
from ..session import MAX_LITERAL_ROWS, durable, require_small

HEX_DIGITS = 3


# ---------------------------------------------------------------- value ranges


def value_range_cuts(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Cut points that divide ``column`` into about ``ranges`` equally filled ranges."""
    if ranges is None:
        ranges = max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(ranges, 8192)
    probs = [i / ranges for i in range(1, ranges)]
    row = df.agg(
        F.percentile_approx(column, probs, max(2_000, 10 * ranges)).alias("cuts")
    ).first()
    return sorted(set(row["cuts"] or []))


def with_range(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the index of the range ``column`` falls in: how many cuts are ``<=`` the value."""
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    out = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="error").transform(df)
    return out.withColumn(name, F.col(name).cast("int"))


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = True,
    ranges: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive prefix sum) and ``tot_<c>`` for each column in ``sums``.

    ``df`` must hold one row per ``(by, order)`` value. ``by`` may have many groups; a
    group of any size is spread over the ranges.
    """
    by = list(by)
    if cuts is None:
        cuts = value_range_cuts(df, order, ranges)
    ranged = with_range(df, order, cuts, "_range")
    direction = F.desc if descending else F.asc

    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    upto = whole.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"tot_{c}") for c in sums],
    )
    if not by:
        # at most len(cuts) + 1 rows, a number fixed by the list of cut points
        offsets = F.broadcast(offsets)
    # null-safe equality adds no null filter, so both branches share one exchange
    cond = F.col("_range").eqNullSafe(F.col("_r"))
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select(
        "*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums]
    )
    joined = local.join(offsets, cond)
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"tot_{c}") for c in sums],
    )


# ---------------------------------------------------------------- hash ranks


def key_hash(key: str | Column, seed: int) -> Column:
    """Seeded md5 of the key as hex text: a fixed pseudo-random order of the rows."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}-"), k.cast("string")))


def class_counts(df: DataFrame, label: str, key: str) -> dict[int, int]:
    """Rows per class of a 0/1 label; another label or a NULL key is an error.

    One row for each class reaches the driver.
    """
    binary = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    rows = (
        df.groupBy(F.when(binary, F.col(label).cast("int")).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("keyless"))
        .collect()
    )
    if any(r["y"] is None for r in rows):
        raise ValueError("label must be 0 or 1")
    if keyless := sum(r["keyless"] for r in rows):
        raise ValueError(f"key column {key} is NULL in {keyless} rows")
    return {r["y"]: r["n"] for r in sorted(rows, key=lambda r: r["y"])}


def hash_cuts(
    df: DataFrame,
    key: str,
    label: str,
    seed: int,
    targets: dict[int, list[int]],
    small: int = 100_000,
) -> dict[int, list[str]]:
    """Hash of the ``r``-th row (1-based, by hash) of each class for every requested rank.

    Rows that share a key share its hash: a rank inside such a group has the group's hash.
    Only counts per digit group reach the driver, 4,096 per open
    group, until every group that holds a wanted rank has at most ``small`` rows.
    """
    base = df.select(F.col(label).cast("int").alias("y"), key_hash(key, seed).alias("h"))
    # (class, prefix) -> [(rank inside the group, slot)]
    open_groups: dict[tuple[int, str], list[tuple[int, int]]] = {}
    cuts = {c: [""] * len(ranks) for c, ranks in targets.items()}
    for c, ranks in targets.items():
        for slot, rank in enumerate(ranks):
            if rank > 0:
                open_groups.setdefault((c, ""), []).append((rank, slot))
    ready: dict[tuple[int, str], list[tuple[int, int]]] = {}
    depth = 0
    while open_groups:
        width = depth + HEX_DIGITS
        groups = require_small(list(open_groups), "open digit groups")
        rows = base
        if depth:
            tag = F.concat_ws(":", F.col("y"), F.substring("h", 1, depth))
            rows = base.where(tag.isin([f"{c}:{prefix}" for c, prefix in groups]))
        counted = (
            rows.groupBy("y", F.substring("h", 1, width).alias("prefix"))
            .count()
            .collect()
        )
        by_group: dict[tuple[int, str], list[tuple[str, int]]] = {}
        for r in counted:
            by_group.setdefault((r["y"], r["prefix"][:depth]), []).append((r["prefix"], r["count"]))
        following: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for group, wanted in open_groups.items():
            before = 0
            todo = sorted(wanted)
            for prefix, count in sorted(by_group.get(group, [])):
                while todo and todo[0][0] <= before + count:
                    rank, slot = todo.pop(0)
                    dest = ready if count <= small or width >= 30 else following
                    dest.setdefault((group[0], prefix), []).append((rank - before, slot))
                before += count
            if todo:
                raise ValueError(f"class {group[0]} has fewer rows than rank {todo[0][0]}")
        open_groups = following
        depth = width
    if ready:
        widths = sorted({len(prefix) for _, prefix in ready})
        picked: dict[tuple[int, str, int], str] = {}
        for width in widths:
            here = [(c, p) for c, p in ready if len(p) == width]
            ranks = sorted({rank for g in here for rank, _ in ready[g]})
            tag = F.concat_ws(":", F.col("y"), F.substring("h", 1, width))
            order = Window.partitionBy("y", "prefix").orderBy("h")
            # a repeated key is one counted row before the window, however hot it is
            rows = (
                base.where(tag.isin([f"{c}:{p}" for c, p in here]))
                .groupBy("y", F.substring("h", 1, width).alias("prefix"), "h")
                .agg(F.count(F.lit(1)).alias("n"))
                .withColumn("upto", F.sum("n").over(order))
                .withColumn(
                    "inside",
                    F.filter(F.lit(ranks), lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto"))),
                )
                .where(F.size("inside") > 0)
                .collect()
            )
            picked.update({(r["y"], r["prefix"], rank): r["h"] for r in rows for rank in r["inside"]})
        for (c, prefix), wanted in ready.items():
            for rank, slot in wanted:
                cuts[c][slot] = picked[(c, prefix, rank)]
    return cuts


def with_block(
    df: DataFrame, key: str, label: str, seed: int, cuts: dict[int, list[str]], name: str
) -> DataFrame:
    """Add the number of the block a row falls in: how many class cuts lie below its hash."""
    h = F.col("_hash")
    out = None
    for c, hashes in cuts.items():
        n = F.lit(0)
        for cut in hashes:
            n = n + (h > F.lit(cut)).cast("int")
        cond = F.col(label) == c
        out = F.when(cond, n) if out is None else out.when(cond, n)
    # hashed in a step of its own, so that the hash is computed once per row
    hashed = df.withColumn("_hash", key_hash(key, seed))
    return hashed.withColumn(name, out.cast("int")).drop("_hash")


# ---------------------------------------------------------------- quantiles


def _exponent(v: Column) -> Column:
    """A non-decreasing map of doubles that spreads them by their order of magnitude."""
    # the smallest positive double has a logarithm above -745
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746.0))


def _half(v: Column) -> Column:
    """Finite and halved: differences of two such values do not overflow."""
    return F.greatest(F.least(v, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)) / 2


def _counted(clean: DataFrame, group: list[str], schema: StructType, brackets: list[_Bracket], cells: int) -> list:
    """``(id, cell, n, lo, hi)``: the rows of each bracket by ``cells`` ranges of its values."""
    by_group: dict[tuple, list] = {}
    for i, b in enumerate(brackets):
        by_group.setdefault(b.group, []).append((i, b.lo, b.hi, b.by_exponent))
    kind = "array<struct<id:int,lo:double,hi:double,by_exponent:boolean>>"
    named = StructType([StructField(f"_g{i}", schema[g].dataType) for i, g in enumerate(group)])
    table = clean.sparkSession.createDataFrame([(*g, b) for g, b in by_group.items()], named.add("_brackets", DataType.fromDDL(kind)))

    def scale(x: Column, bracket: Column) -> Column:
        return F.when(bracket["by_exponent"], _exponent(x)).otherwise(_half(x))

    ends = F.transform(
        "_brackets",
        lambda b: F.struct(b["id"].alias("id"), b["lo"].alias("lo"), b["hi"].alias("hi"), b["by_exponent"].alias("by_exponent"),
                           scale(b["lo"], b).alias("from"), scale(b["hi"], b).alias("to")),
    )
    table = table.withColumn("_brackets", ends)
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    v, b = F.col("_v"), F.col("_b")
    # at most one bracket of the group holds a row; one row of the small table meets each row
    own = F.filter("_brackets", lambda x: (v >= x["lo"]) & (v <= x["hi"]))
    share = (scale(v, b) - b["from"]) / (b["to"] - b["from"])
    cell = F.when(b["to"] > b["from"], F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise((v > b["lo"]).cast("long"))
    rows = clean.join(F.broadcast(table), cond).select("_v", F.get(own, 0).alias("_b")).where("_b IS NOT NULL")
    return (
        rows.groupBy(b["id"].alias("id"), cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        .collect()
    )


@dataclass
class _Bracket:
    """Values of a group between two of its values, their number, and the ranks wanted among them."""

    group: tuple
    lo: float
    hi: float
    n: int
    ranks: list[tuple[int, tuple]]  # rank inside the bracket, what it is wanted for
    by_exponent: bool = False

    def settle(self, found: dict) -> bool:
        """Note the ranks that the ends reveal; True if others remain."""
        open_ranks = []
        for rank, wanted in self.ranks:
            if rank == 0 or self.lo == self.hi:
                found[wanted] = self.lo
            elif rank == self.n - 1:
                found[wanted] = self.hi
            else:
                open_ranks.append((rank, wanted))
        self.ranks = open_ranks
        return bool(open_ranks)


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Sequence[float],
    groups: int,
    extra: dict[str, Column] | None = None,
    cells: int = 4_096,
) -> DataFrame:
    """Linearly interpolated quantiles: ``(*group, prob, quantile, n_values)``.

    ``groups`` is the caller's proven bound on the number of group values (column names,
    outcome labels); more of them are an error. NULL and NaN values are left out; ``extra``
    adds plain aggregates of the value column (named ``_v``) that ride along in the first
    pass.

    Selection in rounds: a bracket of values is cut into up to ``cells`` ranges, one scan
    counts the rows of each and notes its least and greatest value, and the range that holds
    a wanted rank is the next bracket. Ranges are equally wide; if they hardly shrink a
    bracket (a few values far from the rest), the next round cuts it by order of magnitude.
    Each round takes at least a bracket's ends away, so the rounds end, usually after two or
    three; no rows are moved or ordered, and at most 200,000 counts reach the driver.
    """
    group, extra = list(group), extra or {}
    if not group or groups * len(probs) > MAX_LITERAL_ROWS:
        raise ValueError("exact_quantiles needs group columns with a small number of values")
    probs = [float(q) for q in require_small(list(probs), "probabilities")]
    # written once: the rounds scan these two columns, not what they were computed from
    clean = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    clean = durable(clean, "values")
    summary = clean.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        *[e.alias(n) for n, e in extra.items()],
    )
    rows = summary.limit(groups + 1).collect()
    if len(rows) > groups:
        raise ValueError(f"exact_quantiles found more than {groups} groups")
    found: dict[tuple, float] = {}
    brackets = []
    for r in rows:
        key, n = tuple(r[: len(group)]), r["n_values"]
        at = [((n - 1) * q, i) for i, q in enumerate(probs)]
        ranks = [(rank, (key, i, side)) for p, i in at for side, rank in enumerate((math.floor(p), math.ceil(p)))]
        brackets.append(_Bracket(key, r["_lo"], r["_hi"], n, ranks))
    brackets = [b for b in brackets if b.settle(found)]
    while brackets:
        width = max(16, min(cells, 200_000 // len(brackets)))
        counted: dict[int, list] = {}
        for r in _counted(clean, group, summary.schema, brackets, width):
            counted.setdefault(r["id"], []).append((r["cell"], r["n"], r["lo"], r["hi"]))
        following = []
        for i, b in enumerate(brackets):
            before, todo = 0, sorted(b.ranks)
            for _, n, lo, hi in sorted(counted[i]):
                here = [(rank - before, wanted) for rank, wanted in todo if rank < before + n]
                todo = todo[len(here) :]
                before += n
                if here:
                    following.append(_Bracket(b.group, lo, hi, n, here, not b.by_exponent and 16 * n > b.n))
        brackets = [b for b in following if b.settle(found)]
    out = []
    for r in rows:
        key, n = tuple(r[: len(group)]), r["n_values"]
        for i, q in enumerate(probs):
            low, high, at = found[key, i, 0], found[key, i, 1], (n - 1) * q
            between = low if low == high else low + (high - low) * (at - math.floor(at))
            out.append((*key, q, between, n, *(r[name] for name in extra)))
    schema = StructType([summary.schema[g] for g in group])
    schema = schema.add("prob", "double").add("quantile", "double").add("n_values", "long")
    return df.sparkSession.createDataFrame(out, StructType([*schema, *(summary.schema[name] for name in extra)]))

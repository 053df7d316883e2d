"""Cleaning of raw labelled tables and dataset-level assertions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import binary_label, blank_to_null, is_blank, to_number


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def zero_fill(df: DataFrame, when_zero: str, target: str) -> Column:
    """``target`` with a blank text read as "0" where ``when_zero`` is 0.

    Only blanks count: a NULL stays NULL, and a non-text column is left alone.
    """
    if not _is_text(df, target):
        return F.col(target)
    fill = (F.col(when_zero) == 0) & is_blank(F.col(target))
    return F.when(fill, "0").otherwise(F.col(target))


def clean(
    df: DataFrame,
    numeric_text: Sequence[str] = (),
    zero_filled: dict[str, str] | None = None,
    drop: Sequence[str] = (),
    sort_columns: bool = True,
) -> DataFrame:
    """One projection: zero rule, text to number, trim, blank to NULL, drop identifiers.

    ``zero_filled`` maps a target column to the column whose zero explains its blanks.
    Assign splits and folds before dropping the key.
    """
    rule = zero_filled or {}
    out = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = F.col(f.name)
        if f.name in rule:
            c = zero_fill(df, rule[f.name], f.name)
        if f.name in numeric_text:
            c = to_number(c) if _is_text(df, f.name) else F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        elif isinstance(f.dataType, T.StringType):
            c = blank_to_null(c)
        out.append((f.name, c))
    if sort_columns:
        out.sort(key=lambda pair: pair[0])
    return df.select(*[c.alias(n) for n, c in out])


def with_label(df: DataFrame, target: str, positive: str = "Yes", negative: str = "No", name: str = "y") -> DataFrame:
    """Replace the text target by a 0/1 label."""
    keep = [c for c in df.columns if c != target]
    return df.select(*keep, binary_label(F.col(target), positive, negative).alias(name))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any missing value."""
    return df.na.drop(subset=list(columns) if columns else None)


def dataset_checks(df: DataFrame, target: str, allowed: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """``(check, ok, bad_rows)`` for a labelled table: not empty, target present and expected."""
    t = F.col(target)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(t.isNull()).alias("missing"),
        F.count_if(t.isNotNull() & ~t.isin(*allowed)).alias("odd"),
    )
    zero = F.lit(0).cast("bigint")
    lines = [
        ("not_empty", F.col("n") > 0, zero),
        ("target_present", F.col("missing") == 0, F.col("missing")),
        ("target_expected", F.col("odd") == 0, F.col("odd")),
    ]
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), ok.alias("ok"), bad.alias("bad_rows"))
                    for n, ok, bad in lines
                ]
            )
        ).alias("c")
    ).select("c.*")


def assert_dataset(df: DataFrame, target: str, allowed: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """Run the checks and fail on the first broken one; returns ``df`` unchanged."""
    broken = [r["check"] for r in dataset_checks(df, target, allowed).collect() if not r["ok"]]
    if broken:
        raise ValueError(f"dataset check failed: {', '.join(broken)}")
    return df

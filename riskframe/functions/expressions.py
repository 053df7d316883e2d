"""Column expressions shared by the operators. All stay JVM-side."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as trimmed from both ends of a text, and the accepted
# spellings of numbers and of non-finite numbers.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NON_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"


def trim_space(c: Column) -> Column:
    """Trim all whitespace (not only blanks) from both ends."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    """True for a text of whitespace only; NULL for NULL."""
    return trim_space(c) == ""


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_space(c), F.lit(""))


def parse_double(c: Column) -> Column:
    """Text to double, keeping infinities and NaN; NULL where the text is no number."""
    t = trim_space(c)
    return (
        F.when(t.rlike(NUMBER), t.try_cast("double"))
        .when(t.rlike(NON_FINITE), F.lower(F.regexp_replace(t, r"^\+", "")).try_cast("double"))
    )


def to_number(c: Column) -> Column:
    """Text to double with anything unusable (no number, NaN) as NULL."""
    d = parse_double(c)
    return F.when(~F.isnan(d), d)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` as double, ``default`` where the denominator is zero."""
    otherwise = F.lit(default).cast("double")
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(otherwise)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log-odds with ``p`` clipped to ``[eps, 1 - eps]``."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


def predicted(p: Column, threshold: float | Column) -> Column:
    """1 where the probability reaches the threshold (inclusive), else 0."""
    t = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    return (p >= t).cast("int")


def outcome(y: Column, pred: Column) -> Column:
    """TN / FP / FN / TP of one row."""
    return (
        F.when((y == 0) & (pred == 0), "TN")
        .when((y == 0) & (pred == 1), "FP")
        .when((y == 1) & (pred == 0), "FN")
        .when((y == 1) & (pred == 1), "TP")
    )


def binary_label(c: Column, positive: str = "Yes", negative: str = "No") -> Column:
    """Yes/No text to 1/0; anything else becomes NULL."""
    return F.when(c == positive, 1).when(c == negative, 0).cast("int")


def checked_y(y: Column) -> Column:
    """``y`` as int, failing the query on anything but 0 and 1."""
    return F.when(y.isin(0, 1), y.cast("int")).otherwise(
        F.raise_error(F.lit("label must be 0 or 1")).cast("int")
    )


def checked_p(p: Column) -> Column:
    """``p`` as double, failing the query on NULL, NaN and values outside [0, 1]."""
    d = p.cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (d >= 0.0) & (d <= 1.0)
    return F.when(ok, d).otherwise(
        F.raise_error(F.lit("probability must be in [0, 1]")).cast("double")
    )


def sql_literal(v) -> str:
    """A Python value as SQL text."""
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "NULL"}[v]
    if isinstance(v, float):
        if math.isfinite(v):
            return f"{v!r}D"
        return f"double('{v}')"
    return str(int(v))


def literal_array(values: Iterable) -> Column:
    """Driver-side values as one array expression (parsed once, not built value by value)."""
    return F.expr(f"array({', '.join(sql_literal(v) for v in values)})")


def struct_array(rows: Iterable[dict]) -> Column:
    """Driver-side rows as an array-of-struct literal, to be exploded in place of a join."""
    structs = [
        f"named_struct({', '.join(f'{sql_literal(k)}, {sql_literal(v)}' for k, v in r.items())})"
        for r in rows
    ]
    return F.expr(f"array({', '.join(structs)})")


def round_doubles(df, places: int = 6):
    """Round every double column, for comparable output."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def evaluated(df: DataFrame) -> DataFrame:
    """``df`` with every column computed once per row, however often later steps use it.

    The optimizer copies a computed column into each filter and projection that names it. It
    does not look through a generator, so the row passes through one that yields it once;
    nothing is moved between tasks.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.array(row)))

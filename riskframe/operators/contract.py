"""Row-level data contract for scoring input."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import evaluated, parse_double, trim_space
from ..session import require_small

ERRORS, INPUT = "_errors", "_input"
# The messages for faulty columns, in the order they are reported.
COLUMN_FAULTS = {
    "forbidden": "Forbidden fields present",
    "missing": "Missing required fields",
    "unexpected": "Unexpected fields",
}
ERROR_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("column", T.StringType()),
            T.StructField("code", T.StringType()),
            T.StructField("value", T.StringType()),
        ]
    )
)


class ContractError(ValueError):
    """Input breaks the contract; ``errors`` lists what is wrong with its columns."""

    category = "validation_error"

    def __init__(self, message: str, errors: Sequence[str]):
        self.errors = list(errors)
        super().__init__(f"{message}: {'; '.join(self.errors)}" if self.errors else message)


@dataclass(frozen=True)
class NumericRule:
    """Constraint of one numeric feature."""

    kind: str = "float"
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[float, ...] = ()


@dataclass(frozen=True)
class Contract:
    """Required features in order, numeric rules, category domains, forbidden columns."""

    numeric: dict[str, NumericRule]
    categorical: dict[str, tuple[str, ...]]
    forbidden: tuple[str, ...] = ()
    allow_unknown: bool = False
    passthrough: tuple[str, ...] = field(default=())
    max_domain: int = 100_000  # values of one column's domain, which become literals of the plan

    def __post_init__(self):
        for c, domain in self.categorical.items():
            require_small(list(domain), f"domain of {c}", self.max_domain)

    @property
    def feature_order(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    # -------------------------------------------------------- columns

    def column_status(self, columns: Sequence[str]) -> list[tuple[str, str]]:
        """``(column, status)``: every column given, then every required one that is not."""
        status = dict.fromkeys(columns, "unexpected")
        roles = (("passthrough", self.passthrough), ("ok", self.feature_order), ("forbidden", self.forbidden))
        for name, members in roles:
            status.update((c, name) for c in members if c in status)
        return [*status.items(), *((c, "missing") for c in self.feature_order if c not in status)]

    def column_errors(self, columns: Sequence[str]) -> list[str]:
        """One line for each kind of fault among the columns, with the columns at fault."""
        found: dict[str, list[str]] = {}
        for column, status in self.column_status(columns):
            found.setdefault(status, []).append(column)
        found["forbidden"] = sorted(found.get("forbidden", ()))
        return [f"{text}: {found[status]}" for status, text in COLUMN_FAULTS.items() if found.get(status)]

    def column_report(self, df: DataFrame) -> DataFrame:
        """``(column, status)`` for every column of the input and every required one."""
        return df.sparkSession.createDataFrame(self.column_status(df.columns), "column string, status string")

    def require_columns(self, df: DataFrame) -> DataFrame:
        errors = self.column_errors(df.columns)
        if errors:
            raise ContractError("columns break the contract", errors)
        return df

    # -------------------------------------------------------- rows

    def _number(self, df: DataFrame, name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.StringType):
            return parse_double(F.col(name))
        return F.col(name).cast("double")

    def _numeric_error(self, df: DataFrame, name: str, rule: NumericRule) -> list[Column]:
        raw, v = F.col(name), self._number(df, name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        # a NaN in a numeric column is a missing value, the text "nan" is not finite
        missing = raw.isNull() if is_text else raw.isNull() | F.isnan(v)
        infinite = F.isnan(v) | (F.abs(v) == float("inf"))

        def problem(code: str, cond: Column) -> Column:
            return F.when(
                cond,
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(code).alias("code"),
                    raw.cast("string").alias("value"),
                ),
            )

        usable = ~missing & v.isNotNull() & ~infinite
        checks = [problem("missing", missing)]
        if rule.kind == "int" and is_text:
            # text has to be written as a whole number
            written = trim_space(raw).rlike(r"^[+-]?[0-9]+$")
            checks.append(problem("invalid", ~missing & ~written))
            usable = usable & written
        elif rule.kind == "int":
            whole = (F.rint(v) == v) & ~infinite
            checks.append(problem("not_integer", ~missing & ~whole))
            usable = usable & whole
        else:
            checks.append(problem("invalid", ~missing & v.isNull()))
            checks.append(problem("non_finite", ~missing & infinite))
        if rule.allowed:
            checks.append(problem("not_allowed", usable & ~v.isin(*[float(a) for a in rule.allowed])))
        if rule.minimum is not None:
            checks.append(problem("below_minimum", usable & (v < float(rule.minimum))))
        if rule.maximum is not None:
            checks.append(problem("above_maximum", usable & (v > float(rule.maximum))))
        return checks

    def _category_error(self, name: str, domain: Sequence[str]) -> list[Column]:
        raw = F.col(name).cast("string")
        text = trim_space(raw)
        blank = raw.isNull() | (text == "")

        def problem(code: str, cond: Column) -> Column:
            return F.when(
                cond,
                F.struct(F.lit(name).alias("column"), F.lit(code).alias("code"), text.alias("value")),
            )

        checks = [problem("missing", blank)]
        if not self.allow_unknown:
            known = text.isin(*domain)
            checks.append(problem("unknown_category", ~blank & ~known))
        return checks

    def check(self, df: DataFrame) -> DataFrame:
        """Add every violation of every row as an array; no shuffle.

        Computed input columns are evaluated once, before the rules read them, and the rules
        once, before anything filters on them.
        """
        self.require_columns(df)
        df = evaluated(df)
        problems: list[Column] = []
        for name, rule in self.numeric.items():
            problems += self._numeric_error(df, name, rule)
        for name, domain in self.categorical.items():
            problems += self._category_error(name, domain)
        return evaluated(df.withColumn(ERRORS, F.array_compact(F.array(*problems)).cast(ERROR_TYPE)))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Valid rows in feature order, and the rejected rows with their violations."""
        checked = self.check(df)
        return self.select_valid(checked), checked.where(F.size(ERRORS) > 0)

    def select_valid(self, checked: DataFrame, keep_input: bool = False) -> DataFrame:
        """Valid rows: numbers as doubles, categories trimmed, passthrough columns first.

        ``keep_input`` carries the row as it arrived in the struct column ``_input``.
        """
        keep = [F.col(c) for c in self.passthrough if c in checked.columns]
        if keep_input:
            arrived = [F.col(c) for c in checked.columns if c != ERRORS]
            keep = [F.struct(*arrived).alias(INPUT)]
        return checked.where(F.size(ERRORS) == 0).select(
            *keep,
            *[self._number(checked, c).alias(c) for c in self.numeric],
            *[trim_space(F.col(c).cast("string")).alias(c) for c in self.categorical],
        )

    def require_valid(self, df: DataFrame) -> DataFrame:
        """Fail on empty input or any violation, else the valid rows.

        Only the counts per column and code reach the driver.
        """
        return self.select_valid(self.checked_or_fail(df))

    def checked_or_fail(self, df: DataFrame) -> DataFrame:
        """The checked input if it has rows and no violation; one validation job."""
        checked = self.check(df)
        # a row without violations counts under NULL, so no counts at all means no rows
        rows = checked.select(F.explode_outer(ERRORS).alias("e")).groupBy("e.column", "e.code").count()
        found = sorted(
            (r["column"] or "", r["code"] or "", r["count"]) for r in rows.collect()
        )
        if not found:
            raise ContractError("empty input", ["no rows to score"])
        broken = [f"{c}: {code} in {n} rows" for c, code, n in found if c]
        if broken:
            raise ContractError("rows break the contract", broken)
        return checked

    # -------------------------------------------------------- documents

    def to_json(self, version: str = "1.0") -> str:
        rules = {}
        for c, r in self.numeric.items():
            rule: dict = {"type": r.kind}
            if r.allowed:
                rule["allowed"] = list(r.allowed)
            if r.minimum is not None:
                rule["min"] = r.minimum
            if r.maximum is not None:
                rule["max"] = r.maximum
            rules[c] = rule
        return json.dumps(
            {
                "version": version,
                "numeric_features": list(self.numeric),
                "categorical_features": {c: list(d) for c, d in self.categorical.items()},
                "feature_order": self.feature_order,
                "forbidden_fields": list(self.forbidden),
                "numeric_constraints": rules,
            },
            indent=2,
            sort_keys=True,
        )

    @classmethod
    def from_json(cls, text: str, **kw) -> Contract:
        doc = json.loads(text)
        rules = {}
        for c in doc["numeric_features"]:
            r = doc["numeric_constraints"].get(c, {})
            rules[c] = NumericRule(
                r.get("type", "float"), r.get("min"), r.get("max"), tuple(r.get("allowed", ()))
            )
        order = [c for c in doc["feature_order"] if c in doc["categorical_features"]]
        return cls(
            rules,
            {c: tuple(doc["categorical_features"][c]) for c in order},
            tuple(doc["forbidden_fields"]),
            **kw,
        )


def violations(checked: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per violation: ``(*key, column, code, value)``."""
    return checked.select(*key, F.explode(ERRORS).alias("e")).select(*key, "e.*")


def violation_summary(checked: DataFrame) -> DataFrame:
    """``(column, code, n)``."""
    return (
        checked.select(F.explode(ERRORS).alias("e"))
        .groupBy(F.col("e.column").alias("column"), F.col("e.code").alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

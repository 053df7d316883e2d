"""Table conventions and the small driver-side inputs of the operators."""

from __future__ import annotations

from decimal import Decimal

import math
from dataclasses import asdict, dataclass

from .session import require_small

# Column conventions of a scored table.
KEY, LABEL, SCORE = "key", "y", "p"

# Tie tolerance of the threshold choice.
COST_TOLERANCE = 1e-6


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns of a labelled table play which part."""

    key: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    positive: str = "Yes"
    negative: str = "No"

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @classmethod
    def from_schema(cls, schema, key: str, target: str, numeric, **kw) -> FeatureSpec:
        """Every column that is neither key, target nor numeric is categorical."""
        skip = {key, target, *numeric}
        cats = tuple(f.name for f in schema.fields if f.name not in skip)
        return cls(key=key, target=target, numeric=tuple(numeric), categorical=cats, **kw)


def _non_negative(obj, names) -> None:
    for n in names:
        v = getattr(obj, n)
        if not (math.isfinite(v) and v >= 0):
            raise ValueError(f"{n}={v} must be a finite number >= 0")


@dataclass(frozen=True)
class CostScenario:
    """Unit cost of each confusion cell."""

    cost_tn: float
    cost_fp: float
    cost_fn: float
    cost_tp: float
    label: str = ""

    def __post_init__(self):
        _non_negative(self, ("cost_tn", "cost_fp", "cost_fn", "cost_tp"))

    def row(self) -> dict:
        r = {k: float(v) for k, v in asdict(self).items() if k != "label"}
        return {"scenario": self.label, **r}


@dataclass(frozen=True)
class RetentionScenario:
    """Contact costs ``cost_intervention``; a contacted churner stays with the given rate."""

    cost_intervention: float
    clv: float
    retention_success_rate: float
    cost_tn: float = 0.0
    cost_fp: float = 0.0
    cost_fn: float = 0.0
    label: str = ""

    def __post_init__(self):
        _non_negative(self, ("cost_tn", "cost_fp", "cost_fn", "cost_intervention", "clv"))
        if not 0.0 <= self.retention_success_rate <= 1.0:
            raise ValueError("retention_success_rate must be in [0, 1]")

    def row(self) -> dict:
        r = {k: float(v) for k, v in asdict(self).items() if k != "label"}
        return {"scenario": self.label, **r}


# The default costs (tn, fp, fn, tp) and the five cost scenarios.
DEFAULT_COSTS = CostScenario(0.0, 10.0, 100.0, 10.0, "illustrative default: FN=10x FP")
COST_SCENARIOS = [
    CostScenario(0.0, 10.0, 10.0, 10.0, "Scenario A: FN and FP balanced (1:1)"),
    CostScenario(0.0, 10.0, 50.0, 10.0, "Scenario B: FN moderately more expensive (5x FP)"),
    CostScenario(0.0, 10.0, 100.0, 10.0, "Scenario C: FN more expensive (10x FP)"),
    CostScenario(0.0, 10.0, 200.0, 10.0, "Scenario D: FN very expensive (20x FP)"),
    CostScenario(0.0, 50.0, 100.0, 50.0, "Scenario E: FP more expensive than FN (0.5x)"),
]


def retention_grid(
    rates=(0.2, 0.4, 0.6, 0.8), clvs=(100.0,), interventions=(10.0,)
) -> list[RetentionScenario]:
    """Every combination of the three assumptions as one scenario."""
    rows = [
        RetentionScenario(
            cost_intervention=c,
            clv=v,
            retention_success_rate=r,
            cost_fp=c,
            cost_fn=v,
            # fixed value: the label's form
            label=f"extended: r={r}, clv={v}, int={c}",
        )
        for r in rates
        for v in clvs
        for c in interventions
    ]
    return require_small(rows, "retention scenarios")


def threshold_grid(start: float = 0.01, end: float = 0.99, step: float = 0.01) -> list[float]:
    """All thresholds ``start + i * step`` up to ``end``, counted in exact decimals.

    The numbers are taken as they are written (0.001 is one thousandth), so a grid of any
    step has all its thresholds, each the float nearest to its decimal, and none beyond its
    end. An end that no step meets is not a threshold.
    """
    first, last, width = (Decimal(str(x)) for x in (start, end, step))
    if not 0 <= first < last <= 1:
        raise ValueError(f"a grid rises inside [0, 1]; got {start} to {end}")
    if not width > 0:
        raise ValueError(f"a grid rises by a positive step; got {step}")
    return check_grid(float(first + i * width) for i in range(int((last - first) / width) + 1))


def check_grid(grid) -> list[float]:
    """Sorted distinct thresholds, each in [0, 1]."""
    values = sorted({float(t) for t in grid})
    for t in values:
        if not 0.0 <= t <= 1.0:
            raise ValueError(f"threshold {t} must be in [0, 1]")
    return require_small(values, "threshold grid", 5_000)


# The coarse grid and the candidate thresholds of the final evaluation.
COARSE_GRID = [round(0.10 + 0.05 * i, 2) for i in range(17)]
FINAL_CANDIDATES = [0.45, 0.50, 0.55, 0.60]

# penalties of the logistic search, from strong to weak
GRID_C = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)

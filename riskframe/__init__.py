"""Risk scoring and decision analytics on PySpark DataFrames."""

from .spec import (
    COST_SCENARIOS,
    DEFAULT_COSTS,
    CostScenario,
    FeatureSpec,
    RetentionScenario,
    retention_grid,
    threshold_grid,
)

__all__ = [
    "COST_SCENARIOS",
    "DEFAULT_COSTS",
    "CostScenario",
    "FeatureSpec",
    "RetentionScenario",
    "retention_grid",
    "threshold_grid",
]

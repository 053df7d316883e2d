"""Failures that know their telemetry category."""

from __future__ import annotations


class ScoringFailure(Exception):
    """A scoring call failed; ``category`` is the name telemetry counts it under."""

    category = "unknown_error"


class ArtifactMissing(ScoringFailure):
    """A saved model, contract or manifest cannot be read or parsed."""

    category = "artifact_load_error"


class ArtifactTampered(ScoringFailure, ValueError):
    """A saved model is not the one its manifest describes."""

    category = "artifact_integrity_error"


class ScoringFailed(ScoringFailure):
    """Valid rows could not be scored or written."""

    category = "inference_error"


class BadRequest(ScoringFailure, ValueError):
    """The call itself is wrong, for example its threshold."""

    category = "validation_error"

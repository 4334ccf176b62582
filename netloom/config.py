"""Validated parameters for the detection plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


def _open_unit(name: str, value: float) -> float:
    value = float(value)
    if not 0.0 < value < 1.0:
        raise ValueError(f"{name} must lie strictly between 0 and 1, got {value}")
    return value


@dataclass(frozen=True)
class FlowParams:
    """Flow timeouts in seconds.

    A key with more than ``hot_rows`` packets is cut into slices of ``slice_s``, which
    bounds how much of it one task sorts.
    """

    idle_s: float = 120.0
    absolute_s: float = 600.0
    slice_s: float = 900.0
    hot_rows: int | None = 5_000_000

    def __post_init__(self) -> None:
        if min(self.idle_s, self.absolute_s, self.slice_s) <= 0:
            raise ValueError("flow timeouts and slice length must be positive")


@dataclass(frozen=True)
class ScoreParams:
    """Decision thresholds, anomaly range and (optionally) fixed meta-learner weights.

    The default weights are the published coefficients of the meta-learner.
    """

    meta_threshold: float = 0.50
    unknown_iso_threshold: float = 0.70
    binary_threshold: float = 0.50
    iso_min: float = -0.18102660407345794
    iso_max: float = 0.2797091882412718
    w_rf: float = 7.30
    w_xgb: float = 7.39
    w_iso: float = 3.28
    intercept: float = -9.94

    def __post_init__(self) -> None:
        for name in ("meta_threshold", "unknown_iso_threshold", "binary_threshold"):
            _open_unit(name, getattr(self, name))
        if self.iso_max <= self.iso_min:
            raise ValueError(f"iso_max {self.iso_max} must exceed iso_min {self.iso_min}")


@dataclass(frozen=True)
class AlertParams:
    """Alert gates and the dedup window (never below one second)."""

    min_severity: str = "LOW"
    min_confidence: float = 0.5
    suppressed_types: tuple[str, ...] = ()
    suppressed_ports: tuple[int, ...] = ()
    dedup_window_s: float = 60.0
    notify_min_severity: str = "HIGH"

    def __post_init__(self) -> None:
        object.__setattr__(self, "dedup_window_s", max(1.0, float(self.dedup_window_s)))


@dataclass(frozen=True)
class DetectionParams:
    flows: FlowParams = field(default_factory=FlowParams)
    scores: ScoreParams = field(default_factory=ScoreParams)
    alerts: AlertParams = field(default_factory=AlertParams)


def load_config(path: str) -> DetectionParams:
    """Read the JSON configuration; a missing key keeps its default."""
    with open(path, encoding="utf-8") as fh:
        raw = json.load(fh)
    scores = {
        ours: raw[theirs]
        for ours, theirs in (
            ("meta_threshold", "meta_learner_threshold"),
            ("unknown_iso_threshold", "unknown_attack_iso_threshold"),
            ("binary_threshold", "binary_threshold"),
        )
        if theirs in raw
    }
    alerts = {
        ours: raw[theirs]
        for ours, theirs in (
            ("min_severity", "alert_min_severity"),
            ("min_confidence", "alert_min_confidence"),
            ("dedup_window_s", "alert_dedup_window_s"),
        )
        if theirs in raw
    }
    alerts["suppressed_types"] = tuple(raw.get("alert_suppressed_types", ()))
    alerts["suppressed_ports"] = tuple(raw.get("alert_suppressed_ports", ()))
    alerts["notify_min_severity"] = raw.get("telegram", {}).get("min_severity", "HIGH").upper()
    return DetectionParams(scores=ScoreParams(**scores), alerts=AlertParams(**alerts))

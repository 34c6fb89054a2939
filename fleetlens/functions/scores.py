"""Health, anomaly and status scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.kpi import clamp

THROTTLE_C = 85.0
MAX_C = 95.0


def health_score(
    temp: Column, realized: Column, degradation: Column | None = None,
    throttle: Column | float = THROTTLE_C, limit: Column | float = MAX_C,
) -> Column:
    throttle = throttle if isinstance(throttle, Column) else F.lit(throttle)
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    heat = F.when(temp > throttle, 1.0 - 0.3 * ((temp - throttle) / (limit - throttle))).otherwise(F.lit(1.0))
    score = heat * (0.3 + 0.7 * realized)
    if degradation is not None:
        score = score * degradation
    return clamp(score, 0.0, 1.0)


def heuristic_anomaly(
    temp: Column, realized: Column, degradation: Column | None = None, throttle: float = THROTTLE_C
) -> Column:
    """Rule score used when no model is loaded (without random jitter)."""
    score = F.when(temp > throttle, 0.3 * F.least(F.lit(1.0), (temp - throttle) / 15.0)).otherwise(F.lit(0.0))
    score = score + F.when(realized < 0.9, 0.4 * (1.0 - realized)).otherwise(F.lit(0.0))
    if degradation is not None:
        score = score + F.when(degradation < 0.95, 0.3 * (1.0 - degradation)).otherwise(F.lit(0.0))
    return clamp(score, 0.0, 1.0)


def threshold_rule(temp: Column, hashrate: Column, nameplate: Column) -> Column:
    """Hot, or below 80 % of nameplate; unknown readings do not trigger."""
    hot = F.coalesce(temp > THROTTLE_C, F.lit(False))
    slow = F.coalesce(hashrate < nameplate * 0.80, F.lit(False))
    return hot | slow


def ensemble_score(classifier: Column, error: Column, threshold: Column | float) -> Column:
    """0.65 / 0.35 blend of classifier probability and scaled reconstruction error."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    scored = error.isNotNull() & (threshold > 0)
    anomaly = F.when(scored, F.least(F.lit(1.0), error / (threshold * 3.0))).otherwise(F.lit(0.0))
    return F.when(anomaly > 0, 0.65 * classifier + 0.35 * anomaly).otherwise(classifier)


def status_label(health: Column, flagged: Column, mode: Column) -> Column:
    return (
        F.when(mode == "Shutdown", "DOWN")
        .when(flagged, "MAINT")
        .when(health > 0.8, "OK")
        .when(health > 0.4, "WARN")
        .otherwise("CRIT")
    )


def minmax_scale(value: Column, lo: float, hi: float) -> Column:
    return clamp((value - lo) / max(hi - lo, 1e-6), 0.0, 1.0)


def half_up(value: Column, digits: int) -> Column:
    """Round half up on the binary value, so that the text of a message is unambiguous."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / scale

"""Alerts from telemetry and risk levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scores import MAX_C, THROTTLE_C, half_up
from fleetlens.operators.ordering import INDEX, TIE_BREAK


def _alert(when, severity: str, message):
    return F.when(when, F.struct(F.lit(severity).alias("severity"), message.alias("message")))


def alerts(df: DataFrame, step: str = INDEX, ai_ready: bool = True, critical_c: float = 90.0) -> DataFrame:
    """One row per alert.

    Needs temperature, realization, mode and, for the risk part, ``risk_level``
    and ``sustained`` (or ``predicted_failure`` and ``anomaly_score`` when no
    model is in use).  ``step`` paces the repeated alerts.
    """
    t, r, n = F.col("temperature_c"), F.col("hashrate_realization"), F.col(step)
    shutdown = t > MAX_C
    hot = ~shutdown & (t > critical_c)
    warm = ~shutdown & ~hot & (t > THROTTLE_C) & (n % 10 == 0)
    degrees = half_up(t, 1)
    found = [
        _alert(shutdown, "CRITICAL", F.format_string(f"THERMAL SHUTDOWN %.1fC > {MAX_C}C", degrees)),
        _alert(hot, "HIGH", F.format_string("Temperature critical: %.1fC", degrees)),
        _alert(warm, "MEDIUM", F.format_string("Temperature warning: %.1fC", degrees)),
        _alert((r < 0.7) & (F.col("operating_mode") != "Shutdown"), "HIGH",
               F.format_string("Hashrate drop: %d%% of nameplate", F.floor(r * 100 + 0.5))),
    ]
    if ai_ready:
        risk, minutes = F.col("risk_level"), F.col("sustained")
        found += [
            _alert((risk == "CRITICAL") & (n % 20 == 0), "CRITICAL", F.format_string(
                "AI Risk: CRITICAL - anomaly sustained %d min, immediate action needed", minutes)),
            _alert((risk == "HIGH") & (n % 20 == 0), "HIGH", F.format_string(
                "AI Risk: HIGH - anomaly sustained %d min, schedule inspection", minutes)),
            _alert((risk == "ELEVATED") & (n % 60 == 0), "MEDIUM", F.format_string(
                "AI Risk: ELEVATED - watching anomaly (%d min)", minutes)),
        ]
    else:
        found.append(_alert(F.col("predicted_failure") & (n % 20 == 0), "HIGH", F.format_string(
            "Heuristic: anomaly detected (score=%.2f)", half_up(F.col("anomaly_score"), 2))))
    listed = F.filter(F.array(*found), lambda a: a.isNotNull())
    ids = [c for c in ("timestamp", TIE_BREAK, "miner_id", "failure_type") if c in df.columns]
    return df.select(*ids, F.posexplode(listed).alias("alert_no", "a")).select(
        *ids, "alert_no", "a.severity", "a.message"
    )


def newest(df: DataFrame, n: int = 500, ties: tuple = ()) -> DataFrame:
    """Retention: the newest ``n`` alerts or actions."""
    order = [c for c in ("timestamp", TIE_BREAK, *ties) if c in df.columns]
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)

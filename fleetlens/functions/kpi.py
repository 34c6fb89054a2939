"""True-efficiency formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.schema import KpiConfig


def clamp(value: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; null stays null (greatest/least would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def voltage_stability(voltage: Column, default: Column, penalty: float = 0.5) -> Column:
    base = F.when(default > 0, default).otherwise(F.lit(1.0))
    return clamp(1.0 - F.lit(penalty) * (F.abs(voltage - default) / base), 0.0, 1.0)


def mode_weight(mode: Column, weights: dict) -> Column:
    """Weight of an operating mode; unknown modes count fully."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mode), F.lit(1.0))


def te_base(
    hashrate: Column, power: Column, voltage: Column, default_voltage: Column,
    mode_factor: Column, cfg: KpiConfig = KpiConfig(),
) -> Column:
    site_power = power * (1.0 + cfg.alpha_cooling + cfg.beta_infra)
    useful = hashrate * voltage_stability(voltage, default_voltage, cfg.voltage_penalty) * mode_factor
    return F.when(site_power > 0, useful / site_power).otherwise(F.lit(0.0))


def te_adjusted(base: Column, ambient: Column, cfg: KpiConfig = KpiConfig()) -> Column:
    excess = F.when(ambient.isNotNull(), F.greatest(F.lit(0.0), ambient - cfg.temp_baseline_c))
    return base * (1.0 - cfg.delta_temp * excess)


def realization(hashrate: Column, nameplate: Column) -> Column:
    return F.when(nameplate > 0, clamp(hashrate / nameplate, 0.0, 1.0)).otherwise(F.lit(0.0))


def te_health(adjusted: Column, hashrate: Column, nameplate: Column) -> Column:
    return adjusted * realization(hashrate, nameplate)

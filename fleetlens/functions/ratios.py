"""Ratios of sensor signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per(numerator: Column, denominator: Column, above: float = 0.0) -> Column:
    """Quotient where the denominator exceeds ``above``, else null."""
    return F.when(denominator > above, numerator / denominator)


def signal_ratios(df: DataFrame) -> DataFrame:
    """Cross-signal ratios; null where the denominator is not usable."""
    h, p, f = F.col("hashrate_th"), F.col("power_w"), F.col("clock_frequency_mhz")
    return df.withColumns({
        "jth": per(p, h),
        "temp_per_watt": F.when(p > 0, F.col("temperature_c") / p * 1000.0),
        "hashrate_per_mhz": per(h, f),
        "power_per_mhz": per(p, f),
        "current_a": per(p, F.col("voltage_v"), 0.05),
    })


def sequence_ratios(df: DataFrame) -> DataFrame:
    """Ratios of the sequence model; existing columns are kept as they are."""
    h, p, f = F.col("hashrate_th"), F.col("power_w"), F.col("clock_frequency_mhz")
    made = {
        "efficiency_jth": F.when(h.isNotNull(), p / F.greatest(h, F.lit(1.0))),
        "temp_delta_c": F.col("temperature_c") - F.col("ambient_temperature_c"),
        "power_per_ghz": F.when(f.isNotNull(), p / F.greatest(f, F.lit(1.0))),
    }
    missing = {n: c for n, c in made.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df

"""KPI columns on telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import kpi as K
from fleetlens.schema import KpiConfig, spec_aliases


def with_spec(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Left join to the hardware specs by ``model`` (token or full name).

    ``columns`` maps output names to spec columns.  The dimension has a fixed
    eight rows, so broadcasting it is safe at any scale.
    """
    spec = spec_aliases(df.sparkSession).select(
        F.col("model").alias("__model"), *[F.col(s).alias(o) for o, s in columns.items()]
    )
    return df.join(F.broadcast(spec), F.col("model") == F.col("__model"), "left").drop("__model")


def with_mode_weight(df: DataFrame, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    return df.withColumn("mode_weight", K.mode_weight(F.col("operating_mode"), cfg.mode_weights))


def with_true_efficiency(df: DataFrame, cfg: KpiConfig = KpiConfig()) -> DataFrame:
    """Add nameplate, realization, default voltage and the three KPI layers."""
    known = [c for c in ("hashrate_nameplate_th", "voltage_default_v", "hashrate_realization") if c in df.columns]
    joined = with_spec(df.drop(*known), {
        "hashrate_nameplate_th": "spec_hashrate_th",
        "voltage_default_v": "spec_voltage_default_v",
    })
    h, nameplate = F.col("hashrate_th"), F.col("hashrate_nameplate_th")
    return (
        joined
        .withColumn("hashrate_realization", K.realization(h, nameplate))
        .withColumn("te_base", K.te_base(
            h, F.col("power_w"), F.col("voltage_v"), F.col("voltage_default_v"),
            K.mode_weight(F.col("operating_mode"), cfg.mode_weights), cfg,
        ))
        .withColumn("te_adjusted", K.te_adjusted(F.col("te_base"), F.col("ambient_temperature_c"), cfg))
        .withColumn("te_health", K.te_health(F.col("te_adjusted"), h, nameplate))
    )

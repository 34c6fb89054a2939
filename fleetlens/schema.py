"""Schemas, hardware specs and configuration of the fleet engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, limits and weights that results depend on.
# ---------------------------------------------------------------------------
SENSORS = [
    "clock_frequency_mhz", "voltage_v", "hashrate_th",
    "temperature_c", "power_w", "ambient_temperature_c",
]
REQUIRED_COLUMNS = ["timestamp", "miner_id", "hashrate_th", "temperature_c", "power_w"]
PHYSICS_TRACES = [
    "thermal_resistance", "leakage_coefficient", "chip_efficiency",
    "psu_internal_resistance", "solder_resistance", "fan_capacity",
    "voltage_regulation_gain",
]
NON_FEATURES = {
    "timestamp", "miner_id", "model", "container_id", "position",
    "operating_mode", "failure_type", "is_pre_failure",
    "degradation_phase", "days_to_failure", "scenario_name",
    "hashrate_nameplate_th", "hashrate_realization", "voltage_default_v",
    *PHYSICS_TRACES,
}
BOUNDS = {
    "temperature_c": (0.0, 130.0),
    "voltage_v": (0.0, 1.0),
    "hashrate_th": (0.0, 600.0),
    "power_w": (0.0, 15000.0),
    "clock_frequency_mhz": (0.0, 1000.0),
    "ambient_temperature_c": (-20.0, 60.0),
}
FAILURE_TYPES = [
    "gradual_degradation", "thermal_runaway", "fan_stall", "psu_degradation",
    "sudden_chip_failure", "coolant_restriction", "firmware_oscillation",
    "connector_corrosion",
]
PHASES = ["healthy", "incubation", "acceleration", "cascade", "failed"]
PRE_FAILURE_PHASES = ["incubation", "acceleration"]

# token, full name, nameplate TH/s, nameplate W, frequency default/min/max,
# voltage default/min/max, throttle C, max C
HARDWARE = [
    ("Pro", "Antminer S21 Pro", 234.0, 3510.0, 500.0, 200.0, 700.0, 0.38, 0.28, 0.50, 85.0, 95.0),
    ("M56S", "Whatsminer M56S", 212.0, 5400.0, 480.0, 200.0, 650.0, 0.40, 0.28, 0.50, 85.0, 95.0),
    ("M63", "Whatsminer M63", 390.0, 7215.0, 520.0, 200.0, 700.0, 0.36, 0.28, 0.50, 85.0, 95.0),
    ("XP", "Antminer S19 XP", 141.0, 3010.0, 450.0, 200.0, 600.0, 0.42, 0.28, 0.50, 85.0, 95.0),
]
SPEC_COLUMNS = [
    "model_token", "model_name", "spec_hashrate_th", "spec_power_w",
    "spec_freq_default_mhz", "spec_freq_min_mhz", "spec_freq_max_mhz",
    "spec_voltage_default_v", "spec_voltage_min_v", "spec_voltage_max_v",
    "spec_temp_throttle_c", "spec_temp_max_c",
]
# Bounds used when a model has no spec.
DEFAULT_FREQ_MIN_MHZ = 200.0
DEFAULT_FREQ_MAX_MHZ = 700.0

# Minutes per degradation phase: incubation, acceleration, cascade.
PHASE_MINUTES = {
    "gradual_degradation": (20160, 10080, 1440),
    "thermal_runaway": (7200, 1440, 240),
    "fan_stall": (14400, 4320, 720),
    "psu_degradation": (30240, 14400, 1440),
    "sudden_chip_failure": (1, 1, 1),
    "coolant_restriction": (20160, 7200, 360),
    "firmware_oscillation": (2880, 1440, 360),
    "connector_corrosion": (30240, 10080, 1440),
}

MODE_WEIGHTS = {"Normal": 1.0, "Idle": 0.0, "Shutdown": 0.0}


@dataclass(frozen=True)
class KpiConfig:
    alpha_cooling: float = 0.15
    beta_infra: float = 0.05
    delta_temp: float = 0.008
    temp_baseline_c: float = 25.0
    voltage_penalty: float = 0.5
    mode_weights: dict = field(default_factory=lambda: dict(MODE_WEIGHTS))


@dataclass(frozen=True)
class FeatureConfig:
    """Window lengths are rows of one miner (one row per minute)."""

    windows: tuple = (2, 15, 60, 360, 1440, 10080)
    minmax_below: int = 1440
    rate_columns: tuple = ("temperature_c", "hashrate_th", "power_w", "efficiency_jth")
    slope_window: int = 360
    slope_min_obs: int = 90
    trend_window: int = 10080
    trend_min_obs: int = 2520
    variance_windows: tuple = (1440, 10080)
    variance_min_obs: tuple = (60, 1440)
    corr_window: int = 360
    corr_min_obs: int = 60
    acf_window: int = 60
    acf_min_obs: int = 20
    peak_window: int = 60
    peak_min_obs: int = 30
    peak_sigma: float = 3.0
    amplitude_window: int = 2880
    amplitude_min_obs: int = 720
    peers: bool = True
    warmup_cap: int = 10080

    @property
    def longest(self) -> int:
        return max(
            *self.windows, self.slope_window, self.trend_window, *self.variance_windows,
            self.corr_window, self.acf_window, self.peak_window, self.amplitude_window,
        )

    @property
    def warmup(self) -> int:
        return min(self.warmup_cap, self.windows[-1])


@dataclass(frozen=True)
class ControlConfig:
    warning_c: float = 80.0
    critical_c: float = 90.0
    shutdown_c: float = 95.0
    step_mhz: float = 25.0
    min_interval_s: int = 300
    cheap_usd: float = 0.035
    expensive_usd: float = 0.07
    cheap_margin_c: float = 10.0
    anomaly_flag: float = 0.7
    te_floor: float = 0.005


@dataclass(frozen=True)
class DashboardControlConfig:
    critical_c: float = 90.0
    critical_step: float = 50.0
    warning_c: float = 82.0
    warning_step: float = 20.0
    cheap_usd: float = 0.035
    cheap_below_c: float = 75.0
    cheap_step: float = 15.0
    expensive_usd: float = 0.07
    expensive_step: float = 10.0


@dataclass(frozen=True)
class RiskConfig:
    score_floor: float = 0.25
    elevated_rows: int = 10
    high_rows: int = 30
    critical_rows: int = 60
    clear_rows: int = 15
    health_elevated: float = 0.8
    health_high: float = 0.5
    health_critical: float = 0.3


@dataclass(frozen=True)
class SequenceConfig:
    length: int = 60
    stride: int = 5
    columns: tuple = (
        "clock_frequency_mhz", "voltage_v", "hashrate_th", "temperature_c",
        "power_w", "ambient_temperature_c",
        "efficiency_jth", "temp_delta_c", "power_per_ghz",
    )


TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("miner_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("container_id", T.StringType()),
    T.StructField("position", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in SENSORS],
    T.StructField("operating_mode", T.StringType()),
    T.StructField("failure_type", T.StringType()),
    T.StructField("is_pre_failure", T.BooleanType()),
    T.StructField("degradation_phase", T.StringType()),
    T.StructField("days_to_failure", T.DoubleType()),
    T.StructField("scenario_name", T.StringType()),
    T.StructField("container_supply_temp_c", T.DoubleType()),
    T.StructField("freq_setpoint_mhz", T.DoubleType()),
    T.StructField("voltage_setpoint_v", T.DoubleType()),
])

LIVE_TELEMETRY_SCHEMA = T.StructType(TELEMETRY_SCHEMA.fields[:14])

FAILURE_EVENT_SCHEMA = T.StructType([
    T.StructField("miner_id", T.StringType()),
    T.StructField("failure_type", T.StringType()),
    T.StructField("onset_ts", T.TimestampType()),
    T.StructField("incubation_min", T.LongType()),
    T.StructField("acceleration_min", T.LongType()),
    T.StructField("cascade_min", T.LongType()),
])


def _sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small constant table that Catalyst sees as a local relation."""
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def spec_dimension(spark: SparkSession) -> DataFrame:
    """Hardware specs, one row per model."""
    return inline_table(spark, SPEC_COLUMNS, HARDWARE)


def spec_aliases(spark: SparkSession) -> DataFrame:
    """Hardware specs keyed by ``model``: both the token and the full name resolve."""
    rows = [(alias, *spec) for spec in HARDWARE for alias in (spec[0], spec[1])]
    return inline_table(spark, ["model", *SPEC_COLUMNS], rows)

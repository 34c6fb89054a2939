"""Registry, shared inputs and shared SQL of the named queries.

Computed doubles are shown on a grid (``grid`` here, ``g`` in SQL): the value
is floored to a multiple of 10^-d after adding an offset that is not one half,
so values that end in exactly 5 fall on the same side in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import scores as S
from fleetlens.operators.clean import preprocess
from fleetlens.operators.kpi import with_true_efficiency
from fleetlens.operators.ordering import with_time_slot
from fleetlens.schema import FeatureConfig, RiskConfig, SequenceConfig
from fleetlens.session import scratch_path, stored
from fleetlens.sources.fixture import read_telemetry

QUERIES: dict = {}
ORACLES: dict = {}

OFFSET = 0.43672194

# The event-log telemetry has about 67 irregular rows per device, so the
# row-count windows are scaled down; the library defaults stay untouched.
FEATURES = FeatureConfig(
    windows=(2, 5, 15, 30), minmax_below=30,
    slope_window=15, slope_min_obs=11, trend_window=30, trend_min_obs=11,
    variance_windows=(10, 30), variance_min_obs=(3, 8),
    corr_window=15, corr_min_obs=5, acf_window=10, acf_min_obs=5,
    peak_window=20, peak_min_obs=11, peak_sigma=2.0,
    amplitude_window=30, amplitude_min_obs=8, warmup_cap=10,
)
RISK = RiskConfig(elevated_rows=3, high_rows=6, critical_rows=10, clear_rows=4)
SEQUENCES = SequenceConfig(length=10, stride=5)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def grid(col, digits: int = 6):
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.floor(c * scale + OFFSET) / scale


def g(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * 1e{digits} + {OFFSET}e0) / 1e{digits})"


def gridded(df: DataFrame, columns: dict[str, int] | list, digits: int = 6) -> DataFrame:
    if not isinstance(columns, dict):
        columns = {c: digits for c in columns}
    return df.withColumns({c: grid(c, d) for c, d in columns.items()})


# -- inputs ------------------------------------------------------------------

def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_telemetry(spark, sf_dir)


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with time slots that fit each device's row rate, written once.

    Cleaning reads it several times. Read from a table, its steps also are stages of
    their own: from one join by device they all would be sorts of one stage, each
    with a page of memory of its own.
    """
    return stored(with_time_slot(read_telemetry(spark, sf_dir)), scratch_path(spark, "ordered"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess(ordered(spark, sf_dir))


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_true_efficiency(clean(spark, sf_dir))


def raw_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI straight on the raw rows (missing readings stay missing)."""
    return with_true_efficiency(read_telemetry(spark, sf_dir))


def with_health(df: DataFrame) -> DataFrame:
    return df.withColumn("health_score", S.health_score(F.col("temperature_c"), F.col("hashrate_realization")))


# -- SQL ---------------------------------------------------------------------

TEL = """
ev AS (
  SELECT event_id, ts, user_id AS u, event_type, value AS v,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dd, hour(ts) AS hh
  FROM events),
ph AS (
  SELECT *, CASE
    WHEN u % 2 = 1 OR dd < 6 + u % 7 THEN 'healthy'
    WHEN dd < 13 + u % 7 THEN 'incubation'
    WHEN dd < 17 + u % 7 THEN 'acceleration'
    WHEN dd < 18 + u % 7 THEN 'cascade' ELSE 'failed' END AS degradation_phase
  FROM ev),
md AS (
  SELECT *,
    CASE degradation_phase WHEN 'healthy' THEN 0e0 WHEN 'incubation' THEN 0.05e0
      WHEN 'acceleration' THEN 0.2e0 WHEN 'cascade' THEN 0.5e0 ELSE 0.8e0 END AS deg,
    CASE WHEN degradation_phase = 'failed' AND k < 30 THEN 'Shutdown'
      WHEN event_type = 'signup' AND k < 15 THEN 'Idle' ELSE 'Normal' END AS operating_mode
  FROM ph),
tel AS (
  SELECT event_id, ts AS "timestamp",
    'MNR-' || lpad(CAST(u + 1 AS VARCHAR), 5, '0') AS miner_id,
    ['Pro', 'M56S', 'M63', 'XP'][CAST(u % 4 + 1 AS INTEGER)] AS model,
    'C-' || CAST(u // 10 AS VARCHAR) AS container_id,
    CAST(u % 10 + 1 AS INTEGER) AS "position",
    CASE WHEN operating_mode <> 'Normal' THEN 0e0
      ELSE [500e0, 480e0, 520e0, 450e0][CAST(u % 4 + 1 AS INTEGER)] * (0.92e0 + 0.0016e0 * k) END AS clock_frequency_mhz,
    CASE WHEN operating_mode <> 'Normal' THEN 0e0
      ELSE [0.38e0, 0.40e0, 0.36e0, 0.42e0][CAST(u % 4 + 1 AS INTEGER)] * (1 + (k - 50) * 0.001e0 - 0.1e0 * deg) END AS voltage_v,
    CASE WHEN event_id % 53 = 0 THEN NULL WHEN operating_mode <> 'Normal' THEN 0e0
      ELSE [234e0, 212e0, 390e0, 141e0][CAST(u % 4 + 1 AS INTEGER)] * (0.80e0 + 0.0025e0 * k) * (1 - deg) END AS hashrate_th,
    CASE WHEN event_id % 59 = 0 THEN NULL ELSE 45 + 0.35e0 * k + 30 * deg END AS temperature_c,
    CASE WHEN event_id % 61 = 0 THEN NULL WHEN operating_mode = 'Shutdown' THEN 50e0 WHEN operating_mode = 'Idle' THEN 100e0
      ELSE [3510e0, 5400e0, 7215e0, 3010e0][CAST(u % 4 + 1 AS INTEGER)] * (0.90e0 + v / 2500) END AS power_w,
    20 + 0.5e0 * hh AS ambient_temperature_c,
    operating_mode,
    CASE WHEN degradation_phase = 'healthy' THEN 'none' ELSE
      ['gradual_degradation', 'thermal_runaway', 'fan_stall', 'psu_degradation', 'sudden_chip_failure',
       'coolant_restriction', 'firmware_oscillation', 'connector_corrosion'][CAST((u // 2) % 8 + 1 AS INTEGER)] END AS failure_type,
    degradation_phase,
    degradation_phase IN ('incubation', 'acceleration') AS is_pre_failure,
    0.030e0 + 0.002e0 * hh AS energy_price,
    round(least(1e0, 0.006e0 * k + 0.6e0 * deg), 2) AS ai_score,
    round(0.5e0 + 0.01e0 * k + 4 * deg, 2) AS recon_error
  FROM md)"""

PASS_THROUGH = (
    "event_id, \"timestamp\", miner_id, model, container_id, \"position\", operating_mode, failure_type, "
    "degradation_phase, is_pre_failure, energy_price, ai_score, recon_error"
)

_SENSORS = ["clock_frequency_mhz", "voltage_v", "hashrate_th", "temperature_c", "power_w", "ambient_temperature_c"]
_BOUNDS = {
    "temperature_c": (0, 130), "voltage_v": (0, 1), "hashrate_th": (0, 600),
    "power_w": (0, 15000), "clock_frequency_mhz": (0, 1000), "ambient_temperature_c": (-20, 60),
}
_ZSCORES = ["temperature_c", "hashrate_th", "power_w", "efficiency_jth"]


def clamp_sql(c: str, lo, hi) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {lo}e0), {hi}e0) END"


CLEAN = TEL + f""",
filled0 AS (
  SELECT {PASS_THROUGH},
    {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _SENSORS)}
  FROM tel WINDOW w AS (PARTITION BY miner_id ORDER BY "timestamp", event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
filled AS (
  SELECT * FROM filled0 WHERE hashrate_th IS NOT NULL AND temperature_c IS NOT NULL AND power_w IS NOT NULL),
clamped AS (
  SELECT {PASS_THROUGH}, {", ".join(f"{clamp_sql(c, *_BOUNDS[c])} AS {c}" for c in _SENSORS)} FROM filled),
derived AS (
  SELECT *, CASE WHEN hashrate_th > 0 THEN power_w / hashrate_th END AS efficiency_jth,
    temperature_c - ambient_temperature_c AS temp_delta_c FROM clamped),
clean AS (
  SELECT *, {", ".join(
    f"({c} - avg({c}) OVER m) / CASE WHEN stddev_samp({c}) OVER m = 0 THEN 1 ELSE stddev_samp({c}) OVER m END AS {c}_zscore"
    for c in _ZSCORES)}
  FROM derived WINDOW m AS (PARTITION BY miner_id))"""

SPEC = """
spec(token, full_name, np_th, np_w, f_def, f_min, f_max, v_def) AS (VALUES
  ('Pro', 'Antminer S21 Pro', 234e0, 3510e0, 500e0, 200e0, 700e0, 0.38e0),
  ('M56S', 'Whatsminer M56S', 212e0, 5400e0, 480e0, 200e0, 650e0, 0.40e0),
  ('M63', 'Whatsminer M63', 390e0, 7215e0, 520e0, 200e0, 700e0, 0.36e0),
  ('XP', 'Antminer S19 XP', 141e0, 3010e0, 450e0, 200e0, 600e0, 0.42e0))"""


def kpi_ctes(source: str, name: str) -> str:
    """CTEs that add the KPI columns to ``source``."""
    return f"""
{name}0 AS (
  SELECT t.*, s.np_th AS hashrate_nameplate_th, s.v_def AS voltage_default_v,
    CASE WHEN s.np_th > 0 THEN {clamp_sql('(t.hashrate_th / s.np_th)', 0, 1)} ELSE 0e0 END AS hashrate_realization,
    {clamp_sql('(1e0 - 0.5e0 * (abs(t.voltage_v - s.v_def) / s.v_def))', 0, 1)} AS vf,
    CASE t.operating_mode WHEN 'Normal' THEN 1e0 WHEN 'Idle' THEN 0e0 WHEN 'Shutdown' THEN 0e0 ELSE 1e0 END AS mw
  FROM {source} t LEFT JOIN spec s ON t.model = s.token OR t.model = s.full_name),
{name}1 AS (
  SELECT *, CASE WHEN power_w * 1.2e0 > 0 THEN hashrate_th * vf * mw / (power_w * (1e0 + 0.15e0 + 0.05e0)) ELSE 0e0 END AS te_base
  FROM {name}0),
{name}2 AS (
  SELECT *, te_base * (1e0 - 0.008e0 * greatest(0e0, ambient_temperature_c - 25e0)) AS te_adjusted FROM {name}1),
{name} AS (SELECT *, te_adjusted * hashrate_realization AS te_health FROM {name}2)"""


KPI = CLEAN + "," + SPEC + "," + kpi_ctes("clean", "kpi")
RAW_KPI = TEL + "," + SPEC + "," + kpi_ctes("tel", "kpi")

HEALTH_SQL = (
    "CASE WHEN hashrate_realization IS NOT NULL THEN least(greatest((CASE WHEN temperature_c > 85e0 THEN 1e0 - 0.3e0 * ((temperature_c - 85e0) / (95e0 - 85e0)) "
    "ELSE 1e0 END) * (0.3e0 + 0.7e0 * hashrate_realization), 0e0), 1e0) END"
)

RATIOS = KPI + """,
rat AS (
  SELECT *, CASE WHEN hashrate_th > 0 THEN power_w / hashrate_th END AS jth,
    CASE WHEN power_w > 0 THEN temperature_c / power_w * 1000e0 END AS temp_per_watt,
    CASE WHEN clock_frequency_mhz > 0 THEN hashrate_th / clock_frequency_mhz END AS hashrate_per_mhz,
    CASE WHEN clock_frequency_mhz > 0 THEN power_w / clock_frequency_mhz END AS power_per_mhz,
    CASE WHEN voltage_v > 0.05e0 THEN power_w / voltage_v END AS current_a
  FROM kpi)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body.strip()}" if "RECURSIVE" in body else f"WITH {ctes.strip()}\n{body.strip()}"

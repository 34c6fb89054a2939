"""Queries: cleaning, joins, KPI and scalar formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import (
    CLEAN, HEALTH_SQL, KPI, PASS_THROUGH, RATIOS, RAW_KPI, SPEC, TEL, _BOUNDS, _SENSORS, clamp_sql, clean, g, grid,
    gridded, kpi, ordered, query, raw_kpi, sql, telemetry, with_health,
)
from fleetlens.functions import scores as S
from fleetlens.functions.ratios import sequence_ratios, signal_ratios
from fleetlens.operators import clean as C
from fleetlens.operators import joins as J
from fleetlens.operators import perturb as P
from fleetlens.operators.kpi import with_mode_weight, with_spec
from fleetlens.operators.scaling import fit_scaler
from fleetlens.schema import FAILURE_TYPES, FeatureConfig  # noqa: F401

TELEMETRY_COLUMNS = [
    "event_id", "timestamp", "miner_id", "model", "container_id", "position", *_SENSORS,
    "operating_mode", "failure_type", "degradation_phase", "is_pre_failure",
]
TELEMETRY_SQL = ", ".join(f'"{c}"' for c in TELEMETRY_COLUMNS)


@query("cln1_ffill_limited", sql(CLEAN, f"SELECT {TELEMETRY_SQL} FROM filled"))
def ffill_limited(spark, sf):
    return C.forward_fill(ordered(spark, sf)).select(*TELEMETRY_COLUMNS)


@query("cln2_clamp_bounds", sql(TEL, "SELECT event_id, miner_id, "
       + ", ".join(f"{clamp_sql(c + ' * 1.3e0', *_BOUNDS[c])} AS {c}" for c in _BOUNDS) + " FROM tel"))
def clamp_bounds(spark, sf):
    # Stretched readings, so that the bounds are met.
    stretched = telemetry(spark, sf).withColumns({c: F.col(c) * 1.3 for c in _BOUNDS})
    return C.clamp_bounds(stretched).select("event_id", "miner_id", *_BOUNDS)


@query("cln2_count_violations", sql(TEL, "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} * 1.3e0 < {lo} OR {c} * 1.3e0 > {hi}) AS {c}_out_of_bounds"
    for c, (lo, hi) in _BOUNDS.items()) + " FROM tel"))
def count_violations(spark, sf):
    return C.count_violations(telemetry(spark, sf).withColumns({c: F.col(c) * 1.3 for c in _BOUNDS}))


@query("cln3_derived_cols", sql(TEL, f"""
SELECT event_id, miner_id, {g('CASE WHEN hashrate_th > 0 THEN power_w / hashrate_th END')} AS efficiency_jth,
  {g('temperature_c - ambient_temperature_c')} AS temp_delta_c FROM tel"""))
def derived_cols(spark, sf):
    out = C.derived_columns(telemetry(spark, sf))
    return gridded(out.select("event_id", "miner_id", "efficiency_jth", "temp_delta_c"), ["efficiency_jth", "temp_delta_c"])


ZS = [f"{c}_zscore" for c in C.ZSCORE_COLUMNS]


@query("cln4_zscore_per_miner", sql(CLEAN, f"""
, z AS (SELECT event_id, miner_id, {", ".join(
    f"({c} - avg({c}) OVER m) / CASE WHEN stddev_samp({c}) OVER m = 0 THEN 1 ELSE stddev_samp({c}) OVER m END AS {c}_zscore"
    for c in C.ZSCORE_COLUMNS)}
  FROM (SELECT *, CASE WHEN hashrate_th > 0 THEN power_w / hashrate_th END AS efficiency_jth FROM tel) t
  WINDOW m AS (PARTITION BY miner_id))
SELECT event_id, miner_id, {", ".join(f"{g(z)} AS {z}" for z in ZS)} FROM z"""))
def zscore_per_miner(spark, sf):
    out = C.zscore_per_miner(C.derived_columns(telemetry(spark, sf)))
    return gridded(out.select("event_id", "miner_id", *ZS), ZS)


@query("cln4_zscore_causal", sql(CLEAN, f"""
, z AS (SELECT event_id, miner_id, {", ".join(
    f"({c} - avg({c}) OVER m) / CASE WHEN stddev_samp({c}) OVER m = 0 THEN 1 ELSE stddev_samp({c}) OVER m END AS {c}_zscore"
    for c in C.ZSCORE_COLUMNS[:3])}
  FROM tel WINDOW m AS (PARTITION BY miner_id ORDER BY "timestamp", event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, miner_id, {", ".join(f"{g(z)} AS {z}" for z in ZS[:3])} FROM z"""))
def zscore_causal(spark, sf):
    out = C.zscore_causal(ordered(spark, sf), 20, C.ZSCORE_COLUMNS[:3])
    return gridded(out.select("event_id", "miner_id", *ZS[:3]), ZS[:3])


CLEAN_OUT = [*_SENSORS, "efficiency_jth", "temp_delta_c", *ZS]


@query("cln5_preprocess", sql(CLEAN, f"""
SELECT event_id, "timestamp", miner_id, {", ".join(f"{g(c)} AS {c}" for c in CLEAN_OUT)} FROM clean"""))
def preprocess(spark, sf):
    return gridded(clean(spark, sf).select("event_id", "timestamp", "miner_id", *CLEAN_OUT), CLEAN_OUT)


@query("cln6_final_fill", sql(TEL, """
SELECT event_id, miner_id, coalesce(hashrate_th, 0e0) AS hashrate_th, coalesce(temperature_c, 0e0) AS temperature_c,
  coalesce(power_w, 0e0) AS power_w FROM tel"""))
def final_fill(spark, sf):
    return C.final_fill(telemetry(spark, sf).select("event_id", "miner_id", "hashrate_th", "temperature_c", "power_w"))


# -- joins ---------------------------------------------------------------------

@query("jon1_spec_lookup", sql(TEL + "," + SPEC, """
SELECT event_id, t.model, np_th AS hashrate_nameplate_th, v_def AS voltage_default_v, np_w AS power_nameplate_w
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (SELECT full_name FROM spec s WHERE s.token = tel.model)
        WHEN 1 THEN 'unlisted' ELSE model END AS model FROM tel) t
LEFT JOIN spec ON t.model = token OR t.model = full_name"""))
def spec_lookup(spark, sf):
    # A mix of tokens, full names and a model nobody knows.
    tel = telemetry(spark, sf)
    named = with_spec(tel, {"__full": "model_name"})
    mixed = named.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("__full"))
                         .when(F.col("event_id") % 3 == 1, "unlisted").otherwise(F.col("model")).alias("model"))
    return with_spec(mixed, {
        "hashrate_nameplate_th": "spec_hashrate_th", "voltage_default_v": "spec_voltage_default_v",
        "power_nameplate_w": "spec_power_w",
    })


@query("jon2_mode_weight_lookup", sql(TEL, """
SELECT event_id, operating_mode, CASE operating_mode WHEN 'Normal' THEN 1e0 WHEN 'Idle' THEN 0e0 WHEN 'Shutdown' THEN 0e0
  ELSE 1e0 END AS mode_weight
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Turbo' ELSE operating_mode END AS operating_mode FROM tel) t"""))
def mode_weight_lookup(spark, sf):
    tel = telemetry(spark, sf).select("event_id", F.when(F.col("event_id") % 5 == 0, "Turbo")
                                      .otherwise(F.col("operating_mode")).alias("operating_mode"))
    return with_mode_weight(tel)


@query("jon3_nameplate_map", sql(TEL + "," + SPEC, """
SELECT event_id, model, np_th AS nameplate FROM tel LEFT JOIN spec ON model = token OR model = full_name"""))
def nameplate_map(spark, sf):
    return with_spec(telemetry(spark, sf).select("event_id", "model"), {"nameplate": "spec_hashrate_th"})


SCALED = ("hashrate_th", "temperature_c", "power_w")
# Models with fewer devices than this use the fallback, so both paths are taken.
SCALER_MIN_MINERS = 38


def scaler_sql(columns, minimum: int, source: str = "healthy") -> str:
    one = lambda c: (f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS std_{c}")
    cols = ", ".join(one(c) for c in columns)
    return f"""
per_model AS (SELECT model, {cols} FROM {source} GROUP BY model HAVING count(DISTINCT miner_id) >= {minimum}),
overall AS (SELECT {cols} FROM {source})"""


@query("jon4_scaler_lookup", sql(CLEAN + ", healthy AS (SELECT * FROM clean WHERE failure_type = 'none')," + scaler_sql(SCALED, SCALER_MIN_MINERS), f"""
SELECT event_id, t.model, {", ".join(
    g(f"coalesce(p.{k}_{c}, o.{k}_{c})") + f" AS {k}_{c}" for c in SCALED for k in ("mean", "std"))}
FROM clean t LEFT JOIN per_model p ON t.model = p.model CROSS JOIN overall o"""))
def scaler_lookup(spark, sf):
    tel = clean(spark, sf)
    scaler = fit_scaler(tel.where("failure_type = 'none'"), SCALED, SCALER_MIN_MINERS)
    names = [f"{k}_{c}" for c in SCALED for k in ("mean", "std")]
    return gridded(scaler.lookup(tel.select("event_id", "model")), names)


EVENTS_OF_FLEET = """
fev AS (
  SELECT DISTINCT 'MNR-' || lpad(CAST(user_id + 1 AS VARCHAR), 5, '0') AS miner_id,
    TIMESTAMP '2024-01-01' + to_days(CAST(6 + user_id % 7 AS INTEGER)) AS onset_ts,
    ['gradual_degradation', 'thermal_runaway', 'fan_stall', 'psu_degradation', 'sudden_chip_failure',
       'coolant_restriction', 'firmware_oscillation', 'connector_corrosion'][CAST((user_id // 2) % 8 + 1 AS INTEGER)] AS failure_type
  FROM events WHERE user_id % 2 = 0)"""


def failure_events(spark, sf):
    """One failure event per failing device, derived from the event log."""
    from fleetlens.sources.fixture import _pick, read_events
    u = F.col("user_id")
    return read_events(spark, sf).where(u % 2 == 0).select("user_id").distinct().select(
        F.concat(F.lit("MNR-"), F.lpad((u + 1).cast("string"), 5, "0")).alias("miner_id"),
        _pick(F.floor(u / 2) % 8, FAILURE_TYPES).alias("failure_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (6 + u % 7).cast("int")).cast("timestamp").alias("onset_ts"),
        F.lit(7 * 1440).alias("incubation_min"), F.lit(4 * 1440).alias("acceleration_min"),
        F.lit(1440).alias("cascade_min"),
    )


@query("jon6_phase_range_join", sql(TEL + "," + EVENTS_OF_FLEET, f"""
SELECT event_id, t.miner_id, CASE WHEN e.miner_id IS NULL OR "timestamp" < onset_ts THEN 'healthy'
    WHEN "timestamp" < onset_ts + INTERVAL 7 DAY THEN 'incubation'
    WHEN "timestamp" < onset_ts + INTERVAL 11 DAY THEN 'acceleration'
    WHEN "timestamp" < onset_ts + INTERVAL 12 DAY THEN 'cascade' ELSE 'failed' END AS phase,
  {g('''CASE WHEN e.miner_id IS NULL OR "timestamp" < onset_ts THEN NULL
    ELSE greatest(0e0, (epoch_us(onset_ts + INTERVAL 12 DAY) - epoch_us("timestamp")) / 6e7) / 1440e0 END''')} AS days_left
FROM tel t LEFT JOIN fev e ON t.miner_id = e.miner_id"""))
def phase_range_join(spark, sf):
    out = J.label_phases(telemetry(spark, sf), failure_events(spark, sf))
    return out.select("event_id", "miner_id", "phase", grid("days_left").alias("days_left"))


@query("jon7_maintenance_range_join", sql(TEL, """
, win AS (SELECT miner_id, "timestamp" AS s, "timestamp" + INTERVAL 30 HOUR AS e FROM tel WHERE operating_mode = 'Idle')
SELECT event_id, miner_id, CASE WHEN hit THEN 'Idle' ELSE operating_mode END AS operating_mode, hit AS in_maintenance
FROM (SELECT *, EXISTS (SELECT 1 FROM win w WHERE w.miner_id = tel.miner_id AND tel."timestamp" BETWEEN w.s AND w.e) AS hit
  FROM tel) t"""))
def maintenance_range_join(spark, sf):
    tel = telemetry(spark, sf)
    windows = tel.where("operating_mode = 'Idle'").select(
        "miner_id", F.col("timestamp").alias("start_ts"),
        (F.col("timestamp") + F.expr("INTERVAL '30' HOUR")).alias("end_ts"))
    return J.apply_maintenance(tel, windows).select("event_id", "miner_id", "operating_mode", "in_maintenance")


# -- KPI -------------------------------------------------------------------------

TE = ["te_base", "te_adjusted", "te_health"]


@query("kpi1_voltage_stability", sql(RAW_KPI, f"SELECT event_id, {g('vf')} AS voltage_stability FROM kpi"))
def voltage_stability(spark, sf):
    from fleetlens.functions.kpi import voltage_stability as vs
    out = raw_kpi(spark, sf)
    return out.select("event_id", grid(vs(F.col("voltage_v"), F.col("voltage_default_v"))).alias("voltage_stability"))


@query("kpi2_te_base", sql(RAW_KPI, f"SELECT event_id, {g('te_base', 9)} AS te_base FROM kpi"))
def te_base(spark, sf):
    return raw_kpi(spark, sf).select("event_id", grid("te_base", 9).alias("te_base"))


@query("kpi3_te_adjusted", sql(RAW_KPI, f"SELECT event_id, {g('te_adjusted', 9)} AS te_adjusted FROM kpi"))
def te_adjusted(spark, sf):
    return raw_kpi(spark, sf).select("event_id", grid("te_adjusted", 9).alias("te_adjusted"))


@query("kpi4_te_health", sql(RAW_KPI, f"SELECT event_id, {g('te_health', 9)} AS te_health FROM kpi"))
def te_health(spark, sf):
    return raw_kpi(spark, sf).select("event_id", grid("te_health", 9).alias("te_health"))


@query("kpi5_te_all", sql(KPI, f"""
SELECT event_id, miner_id, hashrate_nameplate_th, voltage_default_v, {g('hashrate_realization')} AS hashrate_realization,
  {", ".join(f"{g(c, 9)} AS {c}" for c in TE)} FROM kpi"""))
def te_all(spark, sf):
    out = kpi(spark, sf).select("event_id", "miner_id", "hashrate_nameplate_th", "voltage_default_v", "hashrate_realization", *TE)
    return gridded(out, {"hashrate_realization": 6, **{c: 9 for c in TE}})


RATS = ["jth", "temp_per_watt", "hashrate_per_mhz", "power_per_mhz", "current_a"]


@query("rat1_signal_ratios", sql(RATIOS, f"SELECT event_id, {', '.join(f'{g(c)} AS {c}' for c in RATS)} FROM rat"))
def rat1(spark, sf):
    return gridded(signal_ratios(kpi(spark, sf)).select("event_id", *RATS), RATS)


@query("rat2_lstm_ratios", sql(TEL, f"""
SELECT event_id, {g('CASE WHEN hashrate_th IS NOT NULL THEN power_w / greatest(hashrate_th, 1e0) END')} AS efficiency_jth,
  {g('temperature_c - ambient_temperature_c')} AS temp_delta_c,
  {g('power_w / greatest(clock_frequency_mhz, 1e0)')} AS power_per_ghz FROM tel"""))
def rat2(spark, sf):
    out = sequence_ratios(telemetry(spark, sf)).select("event_id", "efficiency_jth", "temp_delta_c", "power_per_ghz")
    return gridded(out, ["efficiency_jth", "temp_delta_c", "power_per_ghz"])


# Remaining share of capacity, taken from the anomaly score, as degradation input.
DEGR = "(1e0 - 0.3e0 * ai_score)"


@query("sco1_health_score", sql(KPI, f"""
SELECT event_id, {g(HEALTH_SQL)} AS health_score, {g(f'''least(greatest((CASE WHEN temperature_c > 85e0
  THEN 1e0 - 0.3e0 * ((temperature_c - 85e0) / (95e0 - 85e0)) ELSE 1e0 END) * (0.3e0 + 0.7e0 * hashrate_realization) * {DEGR}, 0e0), 1e0)''')}
  AS degraded_health FROM kpi"""))
def sco1(spark, sf):
    d = kpi(spark, sf)
    t, r = F.col("temperature_c"), F.col("hashrate_realization")
    return d.select("event_id", grid(S.health_score(t, r)).alias("health_score"),
                    grid(S.health_score(t, r, 1.0 - 0.3 * F.col("ai_score"))).alias("degraded_health"))


@query("sco2_heuristic_anomaly", sql(KPI, f"""
SELECT event_id, {g(f'''least(greatest(
  CASE WHEN temperature_c > 85e0 THEN 0.3e0 * least(1e0, (temperature_c - 85e0) / 15e0) ELSE 0e0 END
  + CASE WHEN hashrate_realization < 0.9e0 THEN 0.4e0 * (1e0 - hashrate_realization) ELSE 0e0 END
  + CASE WHEN {DEGR} < 0.95e0 THEN 0.3e0 * (1e0 - {DEGR}) ELSE 0e0 END, 0e0), 1e0)''')} AS anomaly_score FROM kpi"""))
def sco2(spark, sf):
    return kpi(spark, sf).select("event_id", grid(S.heuristic_anomaly(
        F.col("temperature_c"), F.col("hashrate_realization"), 1.0 - 0.3 * F.col("ai_score"))).alias("anomaly_score"))


@query("sco3_threshold_rule", sql(RAW_KPI, """
SELECT event_id, coalesce(temperature_c > 85e0, false) OR coalesce(hashrate_th < hashrate_nameplate_th * 0.80e0, false)
  AS threshold_flag FROM kpi"""))
def sco3(spark, sf):
    return raw_kpi(spark, sf).select("event_id", S.threshold_rule(
        F.col("temperature_c"), F.col("hashrate_th"), F.col("hashrate_nameplate_th")).alias("threshold_flag"))


@query("sco4_ensemble_score", sql(TEL, f"""
SELECT event_id, {g('''CASE WHEN l > 0 THEN 0.65e0 * ai_score + 0.35e0 * l ELSE ai_score END''')} AS combined
FROM (SELECT event_id, ai_score, CASE WHEN is_pre_failure OR event_id % 2 = 0 THEN least(1e0, recon_error / (0.9e0 * 3e0)) ELSE 0e0 END AS l FROM tel) t"""))
def sco4(spark, sf):
    # Half of the healthy rows have no sequence yet and so no reconstruction error.
    tel = telemetry(spark, sf)
    err = F.when(F.col("is_pre_failure") | (F.col("event_id") % 2 == 0), F.col("recon_error"))
    return tel.select("event_id", grid(S.ensemble_score(F.col("ai_score"), err, 0.9)).alias("combined"))


@query("sco5_status_label", sql(KPI, f"""
SELECT event_id, CASE WHEN operating_mode = 'Shutdown' THEN 'DOWN' WHEN ai_score > 0.7e0 THEN 'MAINT'
  WHEN h > 0.8e0 THEN 'OK' WHEN h > 0.4e0 THEN 'WARN' ELSE 'CRIT' END AS status
FROM (SELECT *, {HEALTH_SQL} AS h FROM kpi) t"""))
def sco5(spark, sf):
    d = with_health(kpi(spark, sf))
    return d.select("event_id", S.status_label(
        F.col("health_score"), F.col("ai_score") > 0.7, F.col("operating_mode")).alias("status"))


@query("sco6_minmax_scale", sql(TEL, f"""
SELECT event_id, {g(clamp_sql('((temperature_c - 40e0) / 60e0)', 0, 1))} AS scaled FROM tel"""))
def sco6(spark, sf):
    return telemetry(spark, sf).select("event_id", grid(S.minmax_scale(F.col("temperature_c"), 40.0, 100.0)).alias("scaled"))


# -- effects -----------------------------------------------------------------------

SIGNALS = {
    "temperature": "temperature_c", "power": "power_w", "voltage": "voltage_v",
    "degradation_factor": "degradation_factor", "thermal_resistance": "thermal_resistance",
}


def perturb_input(tel):
    """Minutes since the start as step; each failing device's own scenario and onset."""
    step = F.floor((F.unix_micros("timestamp") - F.lit(1704067200000000)) / 60000000)
    number = F.regexp_extract("miner_id", r"(\d+)$", 1).cast("long") - 1
    kinds = F.array(*[F.lit(t) for t in FAILURE_TYPES])
    return tel.withColumns({
        "step": step,
        "onset_step": (6 + number % 7) * 1440,
        "duration_steps": F.lit(11 * 1440),
        "scenario_name": F.element_at(kinds, (F.floor(number / 2) % 8 + 1).cast("int")),
        "degradation_factor": F.lit(1.0),
        "thermal_resistance": F.lit(0.012),
    })


_EXP = "((exp(3e0 * p) - 1e0) / (exp(3e0) - 1e0))"
_SINE = lambda f, ph: f"(abs(sin(step * 0.05e0 * {f}e0 + {ph}e0)) * p)"
_INT = lambda f: f"(CASE WHEN p >= 0.1e0 AND sin(step * 0.1e0 * {f}e0 + 0e0) > 1e0 - p THEN 1e0 ELSE 0e0 END)"


@query("scn1_inject_effects", sql(TEL, f"""
, st AS (SELECT t.*, CAST(floor((epoch_us("timestamp") - 1704067200000000) / 60000000) AS BIGINT) AS step, (6 + n % 7) * 1440 AS onset,
    ['gradual_degradation', 'thermal_runaway', 'fan_stall', 'psu_degradation', 'sudden_chip_failure',
     'coolant_restriction', 'firmware_oscillation', 'connector_corrosion'][CAST((n // 2) % 8 + 1 AS INTEGER)] AS sc
  FROM (SELECT *, CAST(regexp_extract(miner_id, '([0-9]+)$', 1) AS BIGINT) - 1 AS n FROM tel) t),
pr AS (SELECT *, CASE WHEN step < onset THEN 0e0 ELSE least(1e0, (step - onset) / 15840e0) END AS p FROM st)
SELECT event_id, sc AS scenario_name, {g('p')} AS progress,
  {g(f'''CASE WHEN p <= 0 THEN temperature_c WHEN sc = 'gradual_degradation' THEN temperature_c + {_EXP} * 3e0
    WHEN sc = 'thermal_runaway' THEN temperature_c + {_EXP} * 25e0 WHEN sc = 'fan_stall' THEN temperature_c + p * 8e0
    WHEN sc = 'coolant_restriction' THEN temperature_c + {_EXP} * 12e0
    WHEN sc = 'firmware_oscillation' THEN temperature_c + {_SINE(3, 1.5)} * 5e0
    WHEN sc = 'connector_corrosion' THEN temperature_c + p * 2e0 ELSE temperature_c END''')} AS temperature_c,
  {g(f'''CASE WHEN p <= 0 THEN power_w WHEN sc = 'thermal_runaway' THEN power_w + {_EXP} * 500e0
    WHEN sc = 'sudden_chip_failure' THEN power_w * (1e0 + -0.6e0) ELSE power_w END''')} AS power_w,
  {g('voltage_v')} AS voltage_v,
  {g(f'''CASE WHEN p <= 0 THEN 1e0 WHEN sc = 'gradual_degradation' THEN 1e0 * (1e0 + p * -0.35e0)
    WHEN sc = 'thermal_runaway' THEN 1e0 + {_EXP} * -0.5e0 WHEN sc = 'psu_degradation' THEN 1e0 + {_INT(1)} * -0.15e0
    WHEN sc = 'sudden_chip_failure' THEN 1e0 + -0.66e0 WHEN sc = 'coolant_restriction' THEN 1e0 + p * -0.1e0
    WHEN sc = 'firmware_oscillation' THEN 1e0 + {_SINE(3, 0)} * -0.2e0
    WHEN sc = 'connector_corrosion' THEN 1e0 + {_INT(0.7)} * -0.1e0 ELSE 1e0 END''')} AS degradation_factor,
  {g(f'''CASE WHEN p <= 0 THEN 0.012e0 WHEN sc = 'fan_stall' THEN 0.012e0 * (1e0 + p * 2e0)
    WHEN sc = 'coolant_restriction' THEN 0.012e0 * (1e0 + {_EXP} * 1.5e0) ELSE 0.012e0 END''', 9)} AS thermal_resistance
FROM pr"""))
def scn1(spark, sf):
    out = P.inject_effects(perturb_input(telemetry(spark, sf)), SIGNALS, noise=False)
    cols = {"progress": 6, "temperature_c": 6, "power_w": 6, "voltage_v": 6, "degradation_factor": 6, "thermal_resistance": 9}
    return gridded(out.select("event_id", "scenario_name", *cols), cols)


@query("scn2_inject_noise")
def scn2(spark, sf):
    return P.inject_noise(telemetry(spark, sf), 0.05).select("event_id", *P.NOISE_COLUMNS)

"""Queries: rolling features, peers, sequences and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import (
    CLEAN, FEATURES, RATIOS, SEQUENCES, TEL, clean, g, grid, gridded, kpi, ordered, query, sql,
)
from fleetlens.catalog.cleaning import scaler_sql
from fleetlens.functions.ratios import signal_ratios
from fleetlens.operators import features as Ft
from fleetlens.operators.ordering import Series
from fleetlens.operators.peers import newest_per_period, peer_features
from fleetlens.operators.phases import phase_runs
from fleetlens.operators.rolling import Roll, rolling
from fleetlens.operators.scaling import fit_scaler
from fleetlens.session import scratch_path, stored
from fleetlens.operators.sequences import newest_sequence, sequence_windows

ORDER = 'PARTITION BY miner_id ORDER BY "timestamp", event_id'
FLAT = 1e-20


def frame(w: int) -> str:
    return f"({ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def ratios(spark, sf):
    return signal_ratios(kpi(spark, sf))


# -- SQL of one rolling value ---------------------------------------------------

def std_sql(c, w):
    f = f"OVER {frame(w)}"
    return (f"CASE WHEN var_pop({c}) {f} <= {FLAT} * (avg({c}) {f}) * (avg({c}) {f}) AND count({c}) {f} > 1 THEN 0e0 "
            f"ELSE stddev_samp({c}) {f} END")


def mean_sql(c, w, need):
    return f"CASE WHEN count({c}) OVER {frame(w)} >= {need} THEN avg({c}) OVER {frame(w)} END"


def slope_sql(c, w, need, x="x"):
    f = f"OVER {frame(w)}"
    return f"coalesce(CASE WHEN count({c}) {f} >= {need} THEN regr_slope({c}, {x}) {f} END, 0e0)"


def corr_sql(a, b, w, need):
    f = f"OVER {frame(w)}"
    x, y = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"

    def flat(v):
        return f"var_pop({v}) {f} <= {FLAT} * (avg({v}) {f}) * (avg({v}) {f})"

    return (f"coalesce(CASE WHEN count({x}) {f} >= {need} AND NOT ({flat(x)}) AND NOT ({flat(y)}) "
            f"THEN covar_pop({x}, {y}) {f} / sqrt(var_pop({x}) {f}) / sqrt(var_pop({y}) {f}) END, 0e0)")


def stat_columns(columns, windows, minmax_below):
    out = {}
    for c in columns:
        for w in windows:
            n, need = f"{c}_roll_{w}m", max(1, w // 4)
            out[f"{n}_mean"] = mean_sql(c, w, need)
            out[f"{n}_std"] = f"coalesce(CASE WHEN count({c}) OVER {frame(w)} >= {need} THEN {std_sql(c, w)} END, 0e0)"
            if w < minmax_below:
                for k in ("min", "max"):
                    out[f"{n}_{k}"] = f"CASE WHEN count({c}) OVER {frame(w)} >= {need} THEN {k}({c}) OVER {frame(w)} END"
    return out


# Displayed decimals follow the size of the values.
DIGITS = {"power_w": 4, "hashrate_th": 4, "jth": 4, "te_health": 8}


def digits_of(name: str) -> int:
    if name.startswith("corr_"):
        return 6
    if name.endswith(("_trend_7d", "_slope", "_acf1", "_std_trend")):
        return 5
    return next((d for p, d in DIGITS.items() if name.startswith(p)), 5)


def rolled(columns: dict, source: str = "rat") -> str:
    """CTE ``rolled`` with computed columns, selected on the display grid."""
    made = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    shown = ", ".join(f"{g(n, digits_of(n))} AS {n}" for n in columns)
    return f""",
numbered AS (SELECT *, CAST(row_number() OVER ({ORDER}) - 1 AS DOUBLE) AS x FROM {source}),
rolled AS (SELECT event_id, miner_id, {made} FROM numbered)
SELECT event_id, miner_id, {shown} FROM rolled"""


def show(df, columns):
    return gridded(df.select("event_id", "miner_id", *columns), {c: digits_of(c) for c in columns})


STATS = stat_columns(Ft.ROLL_COLUMNS, FEATURES.windows, FEATURES.minmax_below)


@query("win1_rolling_stats", sql(RATIOS, rolled(STATS)))
def win1(spark, sf):
    out = Ft.rolling_stats(ratios(spark, sf), Ft.ROLL_COLUMNS, FEATURES.windows, FEATURES.minmax_below)
    return show(out, list(STATS))


# Long windows: order lines as series, far more rows per key than one window.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def line_series(keys):
    return Series(keys=keys, order=LINE_ORDER, slots=("l_shipdate", "l_orderkey div 100000"))


def long_sql(keys: str, w: int, need: int, stats: bool) -> str:
    f = f"(PARTITION BY {keys} ORDER BY {', '.join(LINE_ORDER)} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    n = f"count(l_extendedprice) OVER {f} >= {need}"
    cols = {
        "price_mean": (f"CASE WHEN {n} THEN avg(l_extendedprice) OVER {f} END", 3),
        "price_std": (f"CASE WHEN {n} THEN stddev_samp(l_extendedprice) OVER {f} END", 3),
        "price_range": (f"CASE WHEN {n} THEN max(l_extendedprice) OVER {f} - min(l_extendedprice) OVER {f} END", 3),
    }
    if stats:
        cols["price_slope"] = (f"CASE WHEN {n} THEN regr_slope(l_extendedprice, x) OVER {f} END", 4)
        cols["price_quantity_corr"] = (
            f"CASE WHEN {n} THEN covar_pop(l_extendedprice, l_quantity) OVER {f} / sqrt(var_pop(l_extendedprice) OVER {f}) "
            f"/ sqrt(var_pop(l_quantity) OVER {f}) END", 6)
    made = ", ".join(f"{e} AS {n_}" for n_, (e, _) in cols.items())
    shown = ", ".join(f"{g(n_, d)} AS {n_}" for n_, (_, d) in cols.items())
    return f"""WITH line AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(LINE_ORDER)}) AS DOUBLE) AS x FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, {made} FROM line)
SELECT l_orderkey, l_linenumber, l_partkey, {shown} FROM r"""


def long_rolls(w, need, stats):
    c = "l_extendedprice"
    rolls = [Roll("mean", c, w, "price_mean", need), Roll("std", c, w, "price_std", need),
             Roll("range", c, w, "price_range", need)]
    if stats:
        rolls += [Roll("slope", c, w, "price_slope", need),
                  Roll("corr", c, w, "price_quantity_corr", need, other="l_quantity")]
    return rolls


def long_windows(spark, sf, keys, w, need, stats):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select(*dict.fromkeys([*LINE_ORDER, *keys]))
    out = rolling(line, long_rolls(w, need, stats), series=line_series(keys))
    shown = {"price_mean": 3, "price_std": 3, "price_range": 3}
    if stats:
        shown |= {"price_slope": 4, "price_quantity_corr": 6}
    return gridded(out.select("l_orderkey", "l_linenumber", "l_partkey", *shown), shown)


@query("win1_long_windows_by_supplier", long_sql("l_suppkey", 360, 90, True))
def win1_supplier(spark, sf):
    return long_windows(spark, sf, ("l_suppkey",), 360, 90, True)


@query("win1_long_windows_by_status", long_sql("l_returnflag, l_linestatus", 2880, 720, True))
def win1_status(spark, sf):
    return long_windows(spark, sf, ("l_returnflag", "l_linestatus"), 2880, 720, True)


RATES = {f"{c}_rate": f"coalesce({c} - lag({c}) OVER ({ORDER}), 0e0)" for c in FEATURES.rate_columns}


@query("win2_rate_of_change", sql(RATIOS, rolled(RATES)))
def win2(spark, sf):
    return show(Ft.rate_of_change(kpi(spark, sf), FEATURES.rate_columns), list(RATES))


SLOPE = {"jth_degradation_slope": slope_sql("jth", FEATURES.slope_window, FEATURES.slope_min_obs)}


@query("win3_degradation_slope", sql(RATIOS, rolled(SLOPE)))
def win3(spark, sf):
    return show(Ft.degradation_slope(ratios(spark, sf), FEATURES.slope_window, FEATURES.slope_min_obs), list(SLOPE))


TRENDS = {f"{c}_trend_7d": slope_sql(c, FEATURES.trend_window, FEATURES.trend_min_obs) for c in Ft.TREND_COLUMNS}


@query("win4_trend_7d", sql(RATIOS, rolled(TRENDS)))
def win4(spark, sf):
    out = Ft.trend_features(ratios(spark, sf), window=FEATURES.trend_window, min_obs=FEATURES.trend_min_obs)
    return show(out, list(TRENDS))


_W0, _W1 = FEATURES.variance_windows
_N0, _N1 = FEATURES.variance_min_obs


def _std_need(c, w, need):
    return f"(CASE WHEN count({c}) OVER {frame(w)} >= {need} THEN {std_sql(c, w)} END)"


VARS = {
    f"{c}_std_trend": f"CASE WHEN {_std_need(c, _W1, _N1)} > 1e-6 THEN {_std_need(c, _W0, _N0)} / {_std_need(c, _W1, _N1)} ELSE 1e0 END"
    for c in Ft.VARIANCE_COLUMNS
}


@query("win5_variance_trend", sql(RATIOS, rolled(VARS)))
def win5(spark, sf):
    out = Ft.variance_trend(kpi(spark, sf), windows=FEATURES.variance_windows, min_obs=FEATURES.variance_min_obs)
    return show(out, list(VARS))


CORRS = {f"corr_{a}_{b}_6h": corr_sql(a, b, FEATURES.corr_window, FEATURES.corr_min_obs) for a, b in Ft.CORR_PAIRS}


@query("win6_rolling_corr", sql(RATIOS, rolled(CORRS)))
def win6(spark, sf):
    out = Ft.rolling_correlation(ratios(spark, sf), window=FEATURES.corr_window, min_obs=FEATURES.corr_min_obs)
    return show(out, list(CORRS))


def acf_table(c: str, source: str) -> str:
    """CTEs: autocorrelation of one column on its non-null rows."""
    return f""",
p_{c} AS (SELECT *, lag({c}) OVER ({ORDER}) AS prev_{c} FROM {source} WHERE {c} IS NOT NULL),
a_{c} AS (SELECT event_id, {corr_sql(c, f'prev_{c}', FEATURES.acf_window, FEATURES.acf_min_obs)} AS {c}_acf1 FROM p_{c})"""


@query("win7_autocorr_lag1", sql(TEL, "".join(acf_table(c, "tel") for c in Ft.ACF_COLUMNS) + f"""
SELECT event_id, miner_id, {", ".join(f"{g(f'coalesce({c}_acf1, 0e0)', 5)} AS {c}_acf1" for c in Ft.ACF_COLUMNS)}
FROM tel {" ".join(f"LEFT JOIN a_{c} USING (event_id)" for c in Ft.ACF_COLUMNS)}"""))
def win7(spark, sf):
    # Raw rows, so that readings are missing.
    out = Ft.autocorrelation(ordered(spark, sf), window=FEATURES.acf_window, min_obs=FEATURES.acf_min_obs)
    return show(out, [f"{c}_acf1" for c in Ft.ACF_COLUMNS])


def peak_ctes(columns, source: str) -> str:
    w, need, sigma = FEATURES.peak_window, FEATURES.peak_min_obs, FEATURES.peak_sigma
    flags = ", ".join(
        f"CASE WHEN count({c}) OVER {frame(w)} >= {need} AND {c} > avg({c}) OVER {frame(w)} + {sigma}e0 * ({std_sql(c, w)}) "
        f"THEN 1 ELSE 0 END AS pk_{c}" for c in columns)
    sums = ", ".join(f"CAST(sum(pk_{c}) OVER {frame(w)} AS DOUBLE) AS {c}_peaks_per_hour" for c in columns)
    return f""",
pk AS (SELECT event_id, miner_id, "timestamp", {flags} FROM {source}),
peaks AS (SELECT event_id, miner_id, {sums} FROM pk)"""


@query("win8_peak_count", sql(RATIOS, peak_ctes(Ft.PEAK_COLUMNS, "rat") + "\nSELECT * FROM peaks"))
def win8(spark, sf):
    out = Ft.peak_count(kpi(spark, sf), window=FEATURES.peak_window, sigma=FEATURES.peak_sigma, min_obs=FEATURES.peak_min_obs)
    return out.select("event_id", "miner_id", *[f"{c}_peaks_per_hour" for c in Ft.PEAK_COLUMNS])


AMPS = {
    f"{c}_diurnal_amp": f"coalesce(CASE WHEN count({c}) OVER {frame(FEATURES.amplitude_window)} >= {FEATURES.amplitude_min_obs} "
                        f"THEN max({c}) OVER {frame(FEATURES.amplitude_window)} - min({c}) OVER {frame(FEATURES.amplitude_window)} END, 0e0)"
    for c in Ft.AMPLITUDE_COLUMNS
}


@query("win9_diurnal_amplitude", sql(RATIOS, rolled(AMPS)))
def win9(spark, sf):
    out = Ft.diurnal_amplitude(ratios(spark, sf), window=FEATURES.amplitude_window, min_obs=FEATURES.amplitude_min_obs)
    return show(out, list(AMPS))


@query("win10_warmup_drop", sql(TEL, f"""
SELECT event_id, miner_id FROM tel QUALIFY row_number() OVER ({ORDER}) - 1 >= {FEATURES.warmup}"""))
def win10(spark, sf):
    return Ft.drop_warmup(ordered(spark, sf), FEATURES.warmup).select("event_id", "miner_id")


@query("win12_phase_runs", sql(TEL, f"""
, c AS (SELECT *, CASE WHEN lag(degradation_phase) OVER o IS DISTINCT FROM degradation_phase THEN 1 ELSE 0 END AS changed
  FROM tel WINDOW o AS ({ORDER})),
r AS (SELECT *, sum(changed) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS run_no FROM c)
SELECT miner_id, CAST(run_no AS BIGINT) AS run_no, min(degradation_phase) AS phase, min("timestamp") AS start_ts, max("timestamp") AS end_ts,
  {g('(epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 / 60 / 1440e0')} AS days, count(*) AS n_rows
FROM r GROUP BY miner_id, run_no"""))
def win12(spark, sf):
    return gridded(phase_runs(ordered(spark, sf)), ["days"])


# -- sequences ---------------------------------------------------------------------

SEQ_COLUMNS = SEQUENCES.columns
LEN, STRIDE = SEQUENCES.length, SEQUENCES.stride
SEQ_INPUT = """,
seq_in AS (SELECT *, CASE WHEN hashrate_th IS NOT NULL THEN efficiency_jth END AS eff,
    power_w / greatest(clock_frequency_mhz, 1e0) AS power_per_ghz FROM clean),
healthy AS (SELECT * FROM seq_in WHERE failure_type = 'none' AND hashrate_th > 1 AND voltage_v > 0.05e0),
alive AS (SELECT * FROM seq_in WHERE hashrate_th > 1 AND voltage_v > 0.05e0),"""


def alive_clean(spark, sf):
    from fleetlens.functions.ratios import sequence_ratios
    from fleetlens.operators.filters import alive_rows
    return stored(sequence_ratios(alive_rows(clean(spark, sf))), scratch_path(spark, "alive"))


def healthy_scaler(spark, sf, alive=None):
    alive = alive_clean(spark, sf) if alive is None else alive
    return fit_scaler(alive.where("failure_type = 'none'"), SEQ_COLUMNS)


@query("win13_sequence_windows", sql(CLEAN, SEQ_INPUT + scaler_sql(SEQ_COLUMNS, 3) + f""",
scaled AS (SELECT t.event_id, t.miner_id, t."timestamp", {", ".join(
    f"(t.{c} - coalesce(p.mean_{c}, o.mean_{c})) / coalesce(p.std_{c}, o.std_{c}) AS s_{c}" for c in SEQ_COLUMNS)},
    row_number() OVER (PARTITION BY t.miner_id ORDER BY t."timestamp", t.event_id) - 1 AS i,
    count(*) OVER (PARTITION BY t.miner_id) AS n
  FROM alive t LEFT JOIN per_model p ON t.model = p.model CROSS JOIN overall o),
starts AS (SELECT miner_id, i AS s FROM scaled WHERE i % {STRIDE} = 0 AND i < n - {LEN}),
w AS (SELECT b.miner_id, b.s, r.i - b.s AS pos, r.* EXCLUDE (miner_id) FROM starts b JOIN scaled r
  ON r.miner_id = b.miner_id AND r.i BETWEEN b.s AND b.s + {LEN - 1})
SELECT miner_id, s AS window_start, min("timestamp") AS start_ts, max("timestamp") AS end_ts, CAST(count(*) AS INTEGER) AS length,
  {g('max(CASE WHEN pos = 0 THEN s_power_w END)', 5)} AS first_power, {g(f'max(CASE WHEN pos = {LEN - 1} THEN s_power_per_ghz END)', 5)} AS last_power_per_ghz,
  {g('sum(s_temperature_c * (pos + 1))', 4)} AS weighted_temperature, {g('sum(s_efficiency_jth * (pos + 1))', 4)} AS weighted_efficiency
FROM w GROUP BY miner_id, s"""))
def win13(spark, sf):
    alive = alive_clean(spark, sf)
    out = sequence_windows(alive, healthy_scaler(spark, sf, alive), SEQUENCES)

    def cell(step, column):
        return F.col("sequence")[step][SEQ_COLUMNS.index(column)]

    def weighted(column):
        k = SEQ_COLUMNS.index(column)
        terms = F.transform("sequence", lambda v, i: v[k] * (i + 1))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return out.select(
        "miner_id", "window_start", "start_ts", "end_ts", F.size("sequence").alias("length"),
        grid(cell(0, "power_w"), 5).alias("first_power"),
        grid(cell(LEN - 1, "power_per_ghz"), 5).alias("last_power_per_ghz"),
        grid(weighted("temperature_c"), 4).alias("weighted_temperature"),
        grid(weighted("efficiency_jth"), 4).alias("weighted_efficiency"),
    )


@query("str3_live_sequence", sql(CLEAN, SEQ_INPUT + scaler_sql(SEQ_COLUMNS, 3) + f""",
scaled AS (SELECT t.miner_id, t."timestamp", (t.temperature_c - coalesce(p.mean_temperature_c, o.mean_temperature_c)) / coalesce(p.std_temperature_c, o.std_temperature_c) AS s,
    row_number() OVER (PARTITION BY t.miner_id ORDER BY t."timestamp" DESC, t.event_id DESC) AS r
  FROM alive t LEFT JOIN per_model p ON t.model = p.model CROSS JOIN overall o)
SELECT miner_id, max("timestamp") AS end_ts, {g(f'sum(s * ({LEN + 1} - r))', 4)} AS weighted_temperature
FROM scaled WHERE r <= {LEN} GROUP BY miner_id HAVING count(*) = {LEN}"""))
def str3(spark, sf):
    alive = alive_clean(spark, sf)
    out = newest_sequence(alive, healthy_scaler(spark, sf, alive), SEQUENCES)
    k = SEQ_COLUMNS.index("temperature_c")
    total = F.aggregate(F.transform("sequence", lambda v, i: v[k] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("miner_id", "end_ts", grid(total, 4).alias("weighted_temperature"))


# -- peers -------------------------------------------------------------------------

PEERS = RATIOS + """,
newest AS (SELECT *, date_trunc('day', "timestamp") AS period FROM rat
  QUALIFY row_number() OVER (PARTITION BY miner_id, date_trunc('day', "timestamp") ORDER BY "timestamp" DESC, event_id DESC) = 1)"""
PEER_GROUP = ("container_id", "period")
_P = "OVER (PARTITION BY container_id, period)"


def peer_input(spark, sf):
    return newest_per_period(ratios(spark, sf))


def peers(spark, sf):
    return peer_features(peer_input(spark, sf), PEER_GROUP)


@query("peer1_container_stats", sql(PEERS, f"""
SELECT event_id, miner_id, {g(f'avg(temperature_c) {_P}')} AS container_avg_temp, max(temperature_c) {_P} AS container_max_temp FROM newest"""))
def peer1(spark, sf):
    return gridded(peers(spark, sf).select("event_id", "miner_id", "container_avg_temp", "container_max_temp"), ["container_avg_temp"])


@query("peer2_neighbor_delta", sql(PEERS, f"""
SELECT event_id, miner_id, {g(f'coalesce(temperature_c - avg(temperature_c) {_P}, 0e0)')} AS neighbor_temp_delta FROM newest"""))
def peer2(spark, sf):
    return gridded(peers(spark, sf).select("event_id", "miner_id", "neighbor_temp_delta"), ["neighbor_temp_delta"])


@query("peer3_container_rank", sql(PEERS, f"""
SELECT event_id, miner_id, {g('''coalesce(CASE WHEN temperature_c IS NOT NULL THEN (rank() OVER (PARTITION BY container_id, period ORDER BY temperature_c NULLS LAST)
  + (count(*) OVER (PARTITION BY container_id, period, temperature_c) - 1) / 2e0) / count(temperature_c) OVER (PARTITION BY container_id, period) END, 0.5e0)''')}
  AS container_temp_rank FROM newest"""))
def peer3(spark, sf):
    return gridded(peers(spark, sf).select("event_id", "miner_id", "container_temp_rank"), ["container_temp_rank"])


@query("peer4_efficiency_deviation", sql(PEERS, f"""
SELECT event_id, miner_id, {g(f'coalesce(jth - median(jth) {_P}, 0e0)')} AS efficiency_deviation FROM newest"""))
def peer4(spark, sf):
    return gridded(peers(spark, sf).select("event_id", "miner_id", "efficiency_deviation"), ["efficiency_deviation"])


# -- the matrix ----------------------------------------------------------------------

MATRIX = {**STATS, **RATES, **SLOPE, **TRENDS, **VARS, **CORRS, **AMPS}
_PEER_SQL = {
    "container_avg_temp": f"avg(temperature_c) {_P}",
    "container_max_temp": f"max(temperature_c) {_P}",
    "neighbor_temp_delta": f"temperature_c - avg(temperature_c) {_P}",
    "container_temp_rank": "(rank() OVER (PARTITION BY container_id, period ORDER BY temperature_c) "
                           "+ (count(*) OVER (PARTITION BY container_id, period, temperature_c) - 1) / 2e0) / count(*) OVER (PARTITION BY container_id, period)",
    "efficiency_deviation": f"jth - median(jth) {_P}",
}
_ACF = [f"{c}_acf1" for c in Ft.ACF_COLUMNS]
_PEAKS = [f"{c}_peaks_per_hour" for c in Ft.PEAK_COLUMNS]
_ZS = [f"{c}_zscore" for c in ("temperature_c", "hashrate_th", "power_w", "efficiency_jth")]
MATRIX_SHOWN = [*MATRIX, *_ACF, *_PEAKS, *_PEER_SQL, *_ZS]


@query("win14_feature_matrix", sql(RATIOS, f""",
numbered AS (SELECT *, row_number() OVER ({ORDER}) - 1 AS n, CAST(row_number() OVER ({ORDER}) - 1 AS DOUBLE) AS x, date_trunc('day', "timestamp") AS period FROM rat),
rolled AS (SELECT event_id, miner_id, n, {", ".join(_ZS)}, {", ".join(f"{e} AS {c}" for c, e in MATRIX.items())},
  {", ".join(f"{e} AS {c}" for c, e in _PEER_SQL.items())} FROM numbered)
{"".join(acf_table(c, "rat") for c in Ft.ACF_COLUMNS)}{peak_ctes(Ft.PEAK_COLUMNS, "rat")}
SELECT event_id, miner_id, {", ".join(f"{g(f'coalesce({c}, 0e0)', digits_of(c))} AS {c}" for c in MATRIX_SHOWN)}
FROM rolled {" ".join(f"JOIN a_{c} USING (event_id)" for c in Ft.ACF_COLUMNS)} JOIN (SELECT * EXCLUDE (miner_id) FROM peaks) pk2 USING (event_id)
WHERE n >= {FEATURES.warmup}"""))
def win14(spark, sf):
    return show(matrix(spark, sf), MATRIX_SHOWN)


def matrix_input(spark, sf):
    """Cleaned rows with the KPI, written once: the matrix reads them several times."""
    df = kpi(spark, sf).withColumn("period", F.date_trunc("day", "timestamp"))
    return stored(df, scratch_path(spark, "kpi"))


def matrix(spark, sf, cfg=FEATURES):
    """Feature matrix; peers are the container's readings of the same day."""
    return Ft.feature_matrix(matrix_input(spark, sf), cfg, peer_group=PEER_GROUP)

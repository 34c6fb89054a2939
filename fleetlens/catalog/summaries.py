"""Queries: aggregations, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import HEALTH_SQL, KPI, TEL, _SENSORS, g, gridded, kpi, query, sql, telemetry, with_health
from fleetlens.catalog.cleaning import TELEMETRY_COLUMNS, TELEMETRY_SQL
from fleetlens.functions.scores import threshold_rule
from fleetlens.operators import splits as Sp
from fleetlens.operators import summary as Su
from fleetlens.operators import timelines as Ti
from fleetlens.operators.alerts import newest
from fleetlens.operators.curves import exact_percentile
from fleetlens.schema import PHASES

FLEET = ["avg_hashrate", "avg_power", "avg_temp", "avg_jth"]


@query("agg1_fleet_summary", sql(TEL, f"""
SELECT miner_id, model, count(*) AS n_readings, {g('avg(hashrate_th)')} AS avg_hashrate, {g('avg(power_w)', 4)} AS avg_power,
  {g('avg(temperature_c)')} AS avg_temp, {g('avg(power_w / NULLIF(hashrate_th, 0))')} AS avg_jth, max(temperature_c) AS max_temp,
  count(*) FILTER (WHERE is_pre_failure) AS pre_failure_count, max(failure_type) AS failure_type
FROM tel WHERE operating_mode <> 'Shutdown' GROUP BY miner_id, model"""))
def agg1(spark, sf):
    return gridded(Su.fleet_summary(telemetry(spark, sf)), {"avg_hashrate": 6, "avg_power": 4, "avg_temp": 6, "avg_jth": 6})


TE_SUM = {
    "te_base_mean": 9, "te_adjusted_mean": 9, "te_health_mean": 9, "te_health_std": 9, "te_health_min": 9,
    "jth_mean": 6, "avg_temp": 6, "hashrate_realization_mean": 6,
}
TE_SUMMARY = KPI + """,
tes AS (SELECT miner_id, arg_min(model, ("timestamp", event_id)) AS model, avg(te_base) AS te_base_mean, avg(te_adjusted) AS te_adjusted_mean,
  avg(te_health) AS te_health_mean, stddev_samp(te_health) AS te_health_std, min(te_health) AS te_health_min,
  avg(efficiency_jth) AS jth_mean, avg(temperature_c) AS avg_temp, max(temperature_c) AS max_temp,
  avg(hashrate_realization) AS hashrate_realization_mean,
  coalesce(arg_max(failure_type, ("timestamp", event_id)) FILTER (WHERE failure_type <> 'none'), 'none') AS failure_type,
  count(te_health) AS n_readings FROM kpi GROUP BY miner_id)"""


@query("agg2_te_summary", sql(TE_SUMMARY, f"""
SELECT miner_id, model, {", ".join(f"{g(c, d)} AS {c}" for c, d in TE_SUM.items())}, max_temp, failure_type, n_readings FROM tes"""))
def agg2(spark, sf):
    return gridded(Su.te_summary(kpi(spark, sf)), TE_SUM)


SEPS = {"te_base_sep_pct": "te_base_mean", "te_adjusted_sep_pct": "te_adjusted_mean", "te_health_sep_pct": "te_health_mean"}


def _h(c):
    return f"avg({c}) FILTER (WHERE failure_type = 'none')"


def _f(c):
    return f"avg({c}) FILTER (WHERE failure_type <> 'none')"


@query("agg3_te_separation", sql(TE_SUMMARY, f"""
SELECT count(*) FILTER (WHERE failure_type = 'none') AS n_healthy, count(*) FILTER (WHERE failure_type <> 'none') AS n_failing,
  {", ".join(g(f"({_h(c)} / greatest({_f(c)}, 1e-10) - 1) * 100", 5) + f" AS {n}" for n, c in SEPS.items())},
  {g(f"({_f('jth_mean')} / greatest({_h('jth_mean')}, 1e-10) - 1) * 100", 5)} AS jth_sep_pct FROM tes"""))
def agg3(spark, sf):
    return gridded(Su.te_separation(Su.te_summary(kpi(spark, sf))), [*SEPS, "jth_sep_pct"], 5)


@query("agg4_value_counts", sql(TEL, "SELECT failure_type, count(*) AS n_rows, count(DISTINCT miner_id) AS n_miners FROM tel GROUP BY 1"))
def agg4(spark, sf):
    return Su.value_counts(telemetry(spark, sf), "failure_type")


@query("agg4_phase_counts", sql(TEL, "SELECT degradation_phase, count(*) AS n_rows, count(DISTINCT miner_id) AS n_miners FROM tel GROUP BY 1"))
def agg4_phase(spark, sf):
    return Su.value_counts(telemetry(spark, sf), "degradation_phase")


_CROSS = ", ".join(f"count(*) FILTER (WHERE degradation_phase = '{p}') AS {p}" for p in PHASES)


@query("agg5_crosstab_margins", sql(TEL, f"""
SELECT failure_type, {_CROSS}, count(*) AS "All" FROM tel GROUP BY 1
UNION ALL SELECT 'All', {_CROSS}, count(*) FROM tel"""))
def agg5(spark, sf):
    return Su.crosstab_margins(telemetry(spark, sf), "failure_type", "degradation_phase", PHASES)


@query("agg6_label_rate", sql(TEL, f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_pre_failure) AS n_positive,
  {g('avg(CASE WHEN is_pre_failure THEN 1e0 ELSE 0e0 END)')} AS positive_rate FROM tel"""))
def agg6(spark, sf):
    return gridded(Su.label_rate(telemetry(spark, sf)), ["positive_rate"])


def _corr(a, b):
    x, y = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    return f"covar_pop({x}, {y}) / sqrt(var_pop({x})) / sqrt(var_pop({y}))"


@query("agg7_corr_matrix", sql(TEL, "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {g(_corr(a, b))} AS r FROM tel WHERE failure_type = 'none'"
    for i, a in enumerate(_SENSORS) for b in _SENSORS[i + 1:])))
def agg7(spark, sf):
    return gridded(Su.correlation_matrix(telemetry(spark, sf).where("failure_type = 'none'")), ["r"])


@query("agg8_histogram", sql(KPI, f"""
, b AS (SELECT is_pre_failure, CAST(least(floor((te_health - 0e0) / (0.08e0 / 40)), 39) AS BIGINT) AS bin, count(*) AS n
  FROM kpi WHERE te_health >= 0 AND te_health <= 0.08e0 GROUP BY 1, 2)
SELECT is_pre_failure, bin, {g('bin * (0.08e0 / 40)')} AS bin_start, n, {g('n / (sum(n) OVER (PARTITION BY is_pre_failure) * (0.08e0 / 40))', 5)} AS density FROM b"""))
def agg8(spark, sf):
    return gridded(Su.histogram(kpi(spark, sf), "te_health", 0.0, 0.08, 40, "is_pre_failure"), {"bin_start": 6, "density": 5})


KPI_TICK = {"total_hashrate_th": 4, "total_power_w": 3, "fleet_efficiency_jth": 5, "fleet_te_health": 8}
TICK_SQL = f"""
, h AS (SELECT *, {HEALTH_SQL} AS health_score, operating_mode <> 'Shutdown' AS active, date_trunc('hour', "timestamp") AS tick_start FROM kpi),
t AS (SELECT tick_start, coalesce(sum(hashrate_th) FILTER (WHERE active), 0e0) AS total_hashrate_th,
  coalesce(sum(power_w) FILTER (WHERE active), 0e0) AS total_power_w,
  coalesce(avg(te_health) FILTER (WHERE active AND te_health > 0), 0e0) AS fleet_te_health,
  count(*) FILTER (WHERE health_score > 0.8e0) AS healthy_count,
  count(*) FILTER (WHERE health_score >= 0.4e0 AND health_score <= 0.8e0) AS warning_count,
  count(*) FILTER (WHERE health_score < 0.4e0) AS critical_count FROM h GROUP BY 1)
SELECT tick_start, {g('total_hashrate_th', 4)} AS total_hashrate_th, {g('total_power_w', 3)} AS total_power_w,
  {g('CASE WHEN total_hashrate_th > 0 THEN total_power_w / total_hashrate_th END', 5)} AS fleet_efficiency_jth,
  {g('fleet_te_health', 8)} AS fleet_te_health, healthy_count, warning_count, critical_count FROM t"""


@query("agg9_fleet_kpis", sql(KPI, TICK_SQL))
def agg9(spark, sf):
    return gridded(Su.fleet_kpis(with_health(kpi(spark, sf)), "1 hour"), KPI_TICK)


FLAGS = TEL + """,
fl AS (SELECT miner_id, count(*) FILTER (WHERE ai_score >= 0.5e0) AS n_flags, max(ai_score) AS max_score,
  bool_or(failure_type <> 'none') AS failing FROM tel GROUP BY 1)"""


def flags(spark, sf):
    tel = telemetry(spark, sf).withColumn("flag", (F.col("ai_score") >= 0.5).cast("int"))
    return Su.flag_summary(tel, "flag", "ai_score")


@query("agg10_flag_summary", sql(FLAGS, "SELECT *, rank() OVER (ORDER BY n_flags DESC) AS flag_rank FROM fl"))
def agg10(spark, sf):
    return flags(spark, sf)


@query("agg10_flagged_share", sql(FLAGS, f"""
SELECT count(*) FILTER (WHERE NOT failing) AS n_healthy, count(*) FILTER (WHERE NOT failing AND n_flags > 0) AS n_healthy_flagged,
  {g('avg(CASE WHEN n_flags > 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE NOT failing)')} AS false_positive_rate FROM fl"""))
def agg10_share(spark, sf):
    return gridded(Su.flagged_share(flags(spark, sf)), ["false_positive_rate"])


@query("agg11_percentile", sql(TEL, f"""
SELECT {g('quantile_cont(power_w, 0.95e0)', 4)} AS p95 FROM tel WHERE failure_type = 'none'"""))
def agg11(spark, sf):
    healthy = telemetry(spark, sf).where("failure_type = 'none'")
    return gridded(exact_percentile(healthy, "power_w", 0.95, "p95"), ["p95"], 4)


# -- splits --------------------------------------------------------------------------

@query("spl1_split_temporal", sql(TEL, """
, d AS (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT "timestamp" FROM tel) x),
cut AS (SELECT "timestamp" AS c FROM d WHERE pos = floor(n * 0.7e0))
SELECT event_id, CASE WHEN "timestamp" < c THEN 'train' ELSE 'test' END AS split FROM tel, cut"""))
def spl1(spark, sf):
    train, test = Sp.split_temporal(telemetry(spark, sf), 0.7)
    return train.select("event_id", F.lit("train").alias("split")).unionByName(
        test.select("event_id", F.lit("test").alias("split")))


def split_sql(ts: str) -> str:
    """CTEs: the three-way split of ``src`` by cumulative positives on time column ``ts``."""
    return f"""
per_ts AS (SELECT {ts} AS t, count(*) AS n, count(*) FILTER (WHERE is_pre_failure) AS pos FROM src GROUP BY 1),
run AS (SELECT *, sum(pos) OVER (ORDER BY t) AS cp, sum(n) OVER (ORDER BY t) AS cn, sum(pos) OVER () AS total FROM per_ts),
t1 AS (SELECT min(t) AS t1, min(cn) AS n1 FROM run WHERE cp > round_even(total * 0.55e0, 0)),
t2 AS (SELECT min(t) AS t2 FROM run WHERE cp > round_even(total * 0.7000000000000001e0, 0)),
t3 AS (SELECT t1, CASE WHEN t2 <= t1 THEN (SELECT min(t) FROM run WHERE cn > n1 + 1) ELSE t2 END AS t2 FROM t1, t2)"""


@query("spl2_split_by_positives", sql(TEL, f"""
, src AS (SELECT * FROM tel), {split_sql('"timestamp"')}
SELECT event_id, CASE WHEN "timestamp" <= t1 THEN 'train' WHEN t2 IS NULL OR "timestamp" <= t2 THEN 'val' ELSE 'test' END AS split FROM tel, t3"""))
def spl2(spark, sf):
    return Sp.split_by_positives(telemetry(spark, sf)).select("event_id", "split")


@query("spl2_split_shared_timestamps", sql(TEL, f"""
, src AS (SELECT *, date_trunc('day', "timestamp") AS dts FROM tel), {split_sql('dts')}
SELECT event_id, CASE WHEN dts <= t1 THEN 'train' WHEN t2 IS NULL OR dts <= t2 THEN 'val' ELSE 'test' END AS split FROM src, t3"""))
def spl2_shared(spark, sf):
    # Whole days as timestamps: boundaries fall inside shared timestamps.
    daily = telemetry(spark, sf).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return Sp.split_by_positives(daily).select("event_id", "split")


@query("agg6_label_rate_by_split", sql(TEL, f"""
, src AS (SELECT * FROM tel), {split_sql('"timestamp"')},
s AS (SELECT is_pre_failure, CASE WHEN "timestamp" <= t1 THEN 'train' WHEN t2 IS NULL OR "timestamp" <= t2 THEN 'val' ELSE 'test' END AS split FROM tel, t3)
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE is_pre_failure) AS n_positive,
  {g('avg(CASE WHEN is_pre_failure THEN 1e0 ELSE 0e0 END)')} AS positive_rate FROM s GROUP BY 1"""))
def agg6_split(spark, sf):
    return gridded(Su.label_rate(Sp.split_by_positives(telemetry(spark, sf)), by="split"), ["positive_rate"])


# -- set operations ---------------------------------------------------------------------

@query("set1_detector_overlap", sql(KPI, """
, f AS (SELECT DISTINCT miner_id FROM kpi WHERE is_pre_failure),
a AS (SELECT DISTINCT miner_id FROM kpi WHERE is_pre_failure AND ai_score >= 0.7e0),
b AS (SELECT DISTINCT miner_id FROM kpi WHERE is_pre_failure AND (temperature_c > 85e0 OR hashrate_th < hashrate_nameplate_th * 0.8e0))
SELECT (SELECT count(*) FROM f) AS n_failures,
  (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x) AS caught_by_both,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x) AS only_first,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x) AS only_second,
  (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM a EXCEPT SELECT * FROM b) x) AS missed"""))
def set1(spark, sf):
    positive = kpi(spark, sf).where("is_pre_failure")
    rule = threshold_rule(F.col("temperature_c"), F.col("hashrate_th"), F.col("hashrate_nameplate_th"))
    return Ti.detector_overlap(positive, positive.where("ai_score >= 0.7"), positive.where(rule))


@query("set2_union_frames", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel"))
def set2(spark, sf):
    tel = telemetry(spark, sf).select(*TELEMETRY_COLUMNS)
    healthy, rest = tel.where("failure_type = 'none'"), tel.where("failure_type <> 'none'")
    return healthy.unionByName(rest.select(*reversed(rest.columns)))


@query("alr2_alert_retention", sql(TEL, """
SELECT event_id, miner_id, "timestamp", temperature_c FROM tel WHERE temperature_c > 90 ORDER BY "timestamp" DESC, event_id DESC LIMIT 500"""))
def alr2(spark, sf):
    return newest(telemetry(spark, sf).where("temperature_c > 90").select("event_id", "miner_id", "timestamp", "temperature_c"), 500)

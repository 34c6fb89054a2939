"""Queries: metrics, thresholds, detection timelines, scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import CLEAN, KPI, RATIOS, TEL, clean, g, gridded, kpi, query, sql, telemetry
from fleetlens.catalog.cleaning import scaler_sql
from fleetlens.functions.scores import threshold_rule
from fleetlens.operators import curves as Cu
from fleetlens.operators import timelines as Ti
from fleetlens.operators.filters import is_alive
from fleetlens.operators.joins import compare_models
from fleetlens.operators.models import class_weight
from fleetlens.operators.scaling import fit_scaler
from fleetlens.operators.sequences import burn_in_threshold, flag_anomalies, split_burn_in
from fleetlens.schema import SequenceConfig

LABEL, SCORE = "is_pre_failure", "ai_score"
CUT = 0.5

SCORED = TEL + """,
sc AS (SELECT *, CASE WHEN is_pre_failure THEN 1 ELSE 0 END AS y, CASE WHEN ai_score >= 0.5e0 THEN 1 ELSE 0 END AS z FROM tel),
gr AS (SELECT ai_score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY 1),
cv AS (SELECT threshold, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
  CAST(sum(pos) OVER (ORDER BY threshold DESC) AS DOUBLE) AS tp, CAST(sum(neg) OVER (ORDER BY threshold DESC) AS DOUBLE) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM gr),
c2 AS (SELECT *, tp / (tp + fp) AS prec, tp / p AS rec, fp / n AS fpr FROM cv),
c3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0e0 END AS f1 FROM c2)"""
BEST = "(SELECT threshold FROM c3 ORDER BY f1 DESC, threshold LIMIT 1)"


def scored(spark, sf):
    return telemetry(spark, sf).withColumn("predicted", (F.col(SCORE) >= CUT).cast("int"))


@query("eva1_classification_metrics", sql(SCORED, f"""
, k AS (SELECT count(*) FILTER (WHERE y = 1 AND z = 1) AS tp, count(*) FILTER (WHERE y = 0 AND z = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND z = 0) AS fn, avg(CASE WHEN y = z THEN 1e0 ELSE 0e0 END) AS acc FROM sc)
SELECT {g('acc')} AS accuracy, {g('tp / (tp + fp)')} AS precision, {g('tp / (tp + fn)')} AS recall, {g('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM k"""))
def eva1(spark, sf):
    return gridded(Cu.classification_metrics(scored(spark, sf), LABEL, "predicted"), ["accuracy", "precision", "recall", "f1"])


@query("eva2_auc_roc", sql(SCORED, f"""
, r AS (SELECT y, rank() OVER (ORDER BY ai_score) + (count(*) OVER (PARTITION BY ai_score) - 1) / 2e0 AS rk FROM sc)
SELECT {g('''(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2e0)
  / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0))''')} AS auc_roc FROM r"""))
def eva2(spark, sf):
    return gridded(Cu.ranking_metrics(scored(spark, sf), LABEL, SCORE).select("auc_roc"), ["auc_roc"])


@query("eva3_auc_pr", sql(SCORED, f"SELECT {g('sum(pos / p * prec)')} AS auc_pr FROM c3"))
def eva3(spark, sf):
    return gridded(Cu.ranking_metrics(scored(spark, sf), LABEL, SCORE).select("auc_pr"), ["auc_pr"])


@query("eva4_confusion_matrix", sql(SCORED, "SELECT y AS actual, z AS predicted, count(*) AS n FROM sc GROUP BY 1, 2"))
def eva4(spark, sf):
    return Cu.confusion_matrix(scored(spark, sf), LABEL, "predicted")


@query("eva5_pr_curve", sql(SCORED, f"SELECT threshold, {g('prec')} AS precision, {g('rec')} AS recall FROM c3"))
def eva5_pr(spark, sf):
    return gridded(Cu.pr_curve(scored(spark, sf), LABEL, SCORE), ["precision", "recall"])


@query("eva5_roc_curve", sql(SCORED, f"SELECT threshold, {g('fpr')} AS fpr, {g('rec')} AS tpr FROM c3"))
def eva5_roc(spark, sf):
    return gridded(Cu.roc_curve(scored(spark, sf), LABEL, SCORE), ["fpr", "tpr"])


@query("thr1_thr_by_recall", sql(SCORED, "SELECT coalesce(max(threshold) FILTER (WHERE rec >= 0.85e0), 0.5e0) AS threshold FROM c3"))
def thr1(spark, sf):
    return Cu.optimize_threshold(scored(spark, sf), LABEL, SCORE, "recall_target", target_recall=0.85)


@query("thr2_thr_f1_max", sql(SCORED, f"SELECT coalesce({BEST}, 0.5e0) AS threshold"))
def thr2(spark, sf):
    return Cu.optimize_threshold(scored(spark, sf), LABEL, SCORE, "f1_max")


@query("thr3_thr_precision_floor", sql(SCORED, f"SELECT coalesce(min(threshold) FILTER (WHERE prec >= 0.2e0), {BEST}, 0.5e0) AS threshold FROM c3"))
def thr3(spark, sf):
    return Cu.optimize_threshold(scored(spark, sf), LABEL, SCORE, "precision_floor", min_precision=0.2)


@query("thr4_thr_f1_with_floor", sql(SCORED, f"""
SELECT CASE WHEN (SELECT prec FROM c3 ORDER BY f1 DESC, threshold LIMIT 1) >= 0.3e0 THEN {BEST}
  ELSE coalesce((SELECT min(threshold) FROM c3 WHERE prec >= 0.3e0), {BEST}, 0.5e0) END AS threshold"""))
def thr4(spark, sf):
    return Cu.optimize_threshold(scored(spark, sf), LABEL, SCORE, "f1_with_floor", min_precision=0.3)


# -- windows with errors: every reading of the fixture carries one -------------------------

def error_windows(spark, sf):
    tel = telemetry(spark, sf)
    return tel.select("miner_id", F.col("event_id").alias("window_start"), "failure_type", "is_pre_failure",
                      is_alive().alias("alive"), F.col("recon_error").alias("error"))


BURN = TEL + """,
w AS (SELECT miner_id, event_id AS window_start, failure_type, is_pre_failure, coalesce(hashrate_th > 1 AND voltage_v > 0.05e0, false) AS alive,
  recon_error AS error FROM tel),
h AS (SELECT *, row_number() OVER (ORDER BY miner_id, window_start) AS pos, count(*) OVER () AS n FROM w WHERE failure_type = 'none'),
hb AS (SELECT *, pos <= greatest(n // 5, 50) AS burn_in FROM h)"""


@query("thr5_burn_in_threshold", sql(BURN, f"SELECT {g('quantile_cont(error, 0.95e0)')} AS threshold FROM hb WHERE burn_in"))
def thr5(spark, sf):
    healthy = error_windows(spark, sf).where("failure_type = 'none'")
    return gridded(burn_in_threshold(healthy, 95.0, minimum=50), ["threshold"])


@query("thr5_burn_in_split", sql(BURN, "SELECT miner_id, window_start, burn_in FROM hb"))
def thr5_split(spark, sf):
    healthy = error_windows(spark, sf).where("failure_type = 'none'")
    return split_burn_in(healthy, minimum=50).select("miner_id", "window_start", "burn_in")


@query("ano4_anomaly_flag", sql(TEL, "SELECT event_id AS window_start, recon_error AS error, CASE WHEN recon_error > 1.4e0 THEN 1 ELSE 0 END AS anomaly FROM tel"))
def ano4(spark, sf):
    return flag_anomalies(error_windows(spark, sf), 1.4).select("window_start", "error", "anomaly")


# -- timelines ------------------------------------------------------------------------------

TIMELINE = TEL + """,
z AS (SELECT *, ai_score >= 0.75e0 AS flag FROM tel),
tl0 AS (SELECT miner_id, min("timestamp") FILTER (WHERE is_pre_failure) AS window_start, max("timestamp") FILTER (WHERE is_pre_failure) AS window_end,
  arg_min(failure_type, ("timestamp", event_id)) FILTER (WHERE is_pre_failure) AS failure_type,
  min("timestamp") FILTER (WHERE is_pre_failure AND flag) AS first_flag,
  count(*) FILTER (WHERE is_pre_failure) AS n_pre_failure_rows, count(*) FILTER (WHERE is_pre_failure AND flag) AS n_flagged_in_window
  FROM z GROUP BY 1 HAVING count(*) FILTER (WHERE is_pre_failure) > 0),
tl AS (SELECT *, coalesce((epoch_us(window_end) - epoch_us(first_flag)) / 1e6 / 60, 0e0) AS lead_time_minutes,
  coalesce((epoch_us(window_end) - epoch_us(first_flag)) / 1e6 / 60, 0e0) / 60 AS lead_time_hours, first_flag IS NOT NULL AS detected FROM tl0)"""


def timeline(spark, sf):
    return Ti.detection_timeline(telemetry(spark, sf).withColumn("predicted", (F.col(SCORE) >= 0.75).cast("int")))


@query("tml1_detection_timeline", sql(TIMELINE, f"""
SELECT miner_id, failure_type, window_start, window_end, first_flag, {g('lead_time_minutes', 5)} AS lead_time_minutes,
  {g('lead_time_hours')} AS lead_time_hours, detected, n_pre_failure_rows, n_flagged_in_window FROM tl"""))
def tml1(spark, sf):
    return gridded(timeline(spark, sf), {"lead_time_minutes": 5, "lead_time_hours": 6})


@query("tml2_detection_by_type", sql(TIMELINE, f"""
SELECT failure_type, count(*) AS n_failures, count(*) FILTER (WHERE detected) AS n_detected,
  {g('coalesce(avg(lead_time_hours) FILTER (WHERE lead_time_hours > 0), 0e0)')} AS avg_lead_hours,
  {g('count(*) FILTER (WHERE detected) / count(*)')} AS detection_rate FROM tl GROUP BY 1"""))
def tml2(spark, sf):
    return gridded(Ti.detection_by_type(timeline(spark, sf)), ["avg_lead_hours", "detection_rate"])


@query("tml3_row_recall_by_type", sql(SCORED, f"""
SELECT failure_type, count(*) AS n_rows, count(*) FILTER (WHERE z = 1) AS n_caught, {g('count(*) FILTER (WHERE z = 1) / count(*)')} AS recall
FROM sc WHERE y = 1 GROUP BY 1"""))
def tml3(spark, sf):
    return gridded(Ti.row_recall_by_type(scored(spark, sf)), ["recall"])


RACE = KPI + """,
fl AS (SELECT *, ai_score >= 0.55e0 AS ai, temperature_c > 85e0 OR hashrate_th < hashrate_nameplate_th * 0.8e0 AS thr FROM kpi),
onset AS (SELECT miner_id, min("timestamp") AS onset, arg_min(failure_type, ("timestamp", event_id)) AS failure_type FROM fl WHERE failure_type <> 'none' GROUP BY 1),
ra AS (SELECT o.miner_id, o.failure_type, o.onset,
  coalesce((epoch_us(o.onset) - epoch_us(min(f."timestamp") FILTER (WHERE ai AND f."timestamp" < o.onset))) / 1e6 / 3600, 0e0) AS ai_lead_hours,
  coalesce((epoch_us(o.onset) - epoch_us(min(f."timestamp") FILTER (WHERE thr AND f."timestamp" < o.onset))) / 1e6 / 3600, 0e0) AS threshold_lead_hours
  FROM onset o JOIN fl f ON f.miner_id = o.miner_id GROUP BY 1, 2, 3),
race AS (SELECT *, CASE WHEN ai_lead_hours > threshold_lead_hours THEN 'AI' WHEN threshold_lead_hours > ai_lead_hours THEN 'THRESHOLD' ELSE 'TIE' END AS winner FROM ra)"""


def race(spark, sf):
    rule = threshold_rule(F.col("temperature_c"), F.col("hashrate_th"), F.col("hashrate_nameplate_th"))
    return Ti.lead_race(kpi(spark, sf).withColumns({"ai_flag": F.col(SCORE) >= 0.55, "threshold_flag": rule}))


@query("tml4_lead_race", sql(RACE, f"""
SELECT miner_id, failure_type, onset, {g('ai_lead_hours')} AS ai_lead_hours, {g('threshold_lead_hours')} AS threshold_lead_hours, winner FROM race"""))
def tml4(spark, sf):
    return gridded(race(spark, sf), ["ai_lead_hours", "threshold_lead_hours"])


@query("tml4_race_summary", sql(RACE, f"""
SELECT count(*) AS n_failures, count(*) FILTER (WHERE winner = 'AI') AS ai_wins,
  {g('coalesce(avg(ai_lead_hours) FILTER (WHERE ai_lead_hours > 0), 0e0)', 5)} AS avg_ai_lead_hours,
  {g('coalesce(avg(threshold_lead_hours) FILTER (WHERE threshold_lead_hours > 0), 0e0)', 5)} AS avg_threshold_lead_hours FROM race"""))
def tml4_summary(spark, sf):
    return gridded(Ti.race_summary(race(spark, sf)), ["avg_ai_lead_hours", "avg_threshold_lead_hours"], 5)


DENSITY = ["flag_density", "row_recall", "false_alarm_rate", "false_alarms_per_hit"]


@query("tml5_flag_density", sql(RACE, f"""
, u AS (SELECT failure_type, is_pre_failure, 'ai_flag' AS detector, ai AS flag FROM fl UNION ALL SELECT failure_type, is_pre_failure, 'threshold_flag', thr FROM fl)
SELECT detector, count(*) AS n_rows, count(*) FILTER (WHERE flag) AS n_flags, {g('count(*) FILTER (WHERE flag) / count(*)')} AS flag_density,
  {g('count(*) FILTER (WHERE flag AND is_pre_failure) / count(*) FILTER (WHERE is_pre_failure)')} AS row_recall,
  {g("count(*) FILTER (WHERE flag AND failure_type = 'none') / count(*) FILTER (WHERE failure_type = 'none')")} AS false_alarm_rate,
  {g("count(*) FILTER (WHERE flag AND failure_type = 'none') / count(*) FILTER (WHERE flag AND is_pre_failure)")} AS false_alarms_per_hit
FROM u GROUP BY 1"""))
def tml5(spark, sf):
    rule = threshold_rule(F.col("temperature_c"), F.col("hashrate_th"), F.col("hashrate_nameplate_th"))
    d = kpi(spark, sf).withColumns({"ai_flag": F.col(SCORE) >= 0.55, "threshold_flag": rule})
    return gridded(Ti.flag_density(d, ["ai_flag", "threshold_flag"]), DENSITY)


SEP = ["healthy_mean_error", "failure_alive_mean_error", "failure_dead_mean_error", "sep_alive", "sep_all",
       "healthy_far", "detection_rate_alive", "detection_rate_all"]


def _avg(x, cond):
    return f"avg({x}) FILTER (WHERE {cond})"


_HIT = "CASE WHEN error > 1.4e0 THEN 1e0 ELSE 0e0 END"
_OK, _AL, _DE, _FA = "failure_type = 'none'", "failure_type <> 'none' AND alive", "failure_type <> 'none' AND NOT alive", "failure_type <> 'none'"


@query("tml6_separation_metrics", sql(BURN, f"""
SELECT 1.4e0 AS threshold, count(*) FILTER (WHERE {_OK}) AS n_healthy, count(*) FILTER (WHERE {_AL}) AS n_failure_alive,
  count(*) FILTER (WHERE {_DE}) AS n_failure_dead, {g(_avg('error', _OK))} AS healthy_mean_error,
  {g(_avg('error', _AL))} AS failure_alive_mean_error, {g(_avg('error', _DE))} AS failure_dead_mean_error,
  {g(f"{_avg('error', _AL)} / {_avg('error', _OK)}")} AS sep_alive, {g(f"{_avg('error', _FA)} / {_avg('error', _OK)}")} AS sep_all,
  {g(_avg(_HIT, _OK))} AS healthy_far, {g(_avg(_HIT, _AL))} AS detection_rate_alive, {g(_avg(_HIT, _FA))} AS detection_rate_all FROM w"""))
def tml6(spark, sf):
    return gridded(Ti.separation_metrics(error_windows(spark, sf), 1.4), SEP)


BY_MINER = BURN + """,
pr AS (SELECT *, count(*) OVER (PARTITION BY miner_id) AS np FROM w WHERE is_pre_failure),
bm AS (SELECT miner_id, min(failure_type) AS failure_type, count(*) AS n_seq, count(*) FILTER (WHERE error > 1.4e0) AS n_flagged,
  avg(error) AS mean_error FROM pr WHERE np >= 20 GROUP BY 1)"""


def by_miner(spark, sf):
    windows = error_windows(spark, sf).where("is_pre_failure")
    counts = windows.groupBy("miner_id").agg(F.count(F.lit(1)).alias("n_positive_rows"))
    return Ti.anomaly_by_miner(windows.join(counts, "miner_id"), 1.4, min_rows=20)


@query("tml7_anomaly_by_miner", sql(BY_MINER, f"""
SELECT miner_id, failure_type, n_seq, n_flagged, {g('n_flagged / n_seq')} AS detect_rate, n_flagged > 0 AS detected_any, {g('mean_error')} AS mean_error FROM bm"""))
def tml7(spark, sf):
    return gridded(by_miner(spark, sf), ["detect_rate", "mean_error"])


@query("tml7_anomaly_by_type", sql(BY_MINER, f"""
SELECT failure_type, count(*) AS n_miners, count(*) FILTER (WHERE n_flagged > 0) AS n_detected, {g('avg(n_flagged / n_seq)')} AS avg_detect_rate FROM bm GROUP BY 1"""))
def tml7_type(spark, sf):
    return gridded(Ti.anomaly_by_type(by_miner(spark, sf)), ["avg_detect_rate"])


# -- model metrics on the deterministic score ------------------------------------------------

def metrics_sql(where: str, name: str) -> str:
    return f"""
{name}k AS (SELECT count(*) FILTER (WHERE y = 1 AND z = 1) AS tp, count(*) FILTER (WHERE y = 0 AND z = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND z = 0) AS fn, avg(CASE WHEN y = z THEN 1e0 ELSE 0e0 END) AS acc,
  sum(y) AS p, sum(1 - y) AS n FROM sc WHERE {where}),
{name}g AS (SELECT ai_score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM sc WHERE {where} GROUP BY 1),
{name}c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY ai_score DESC) AS tp, sum(neg) OVER (ORDER BY ai_score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM {name}g),
{name} AS (SELECT 'accuracy' AS metric, acc AS "value" FROM {name}k UNION ALL SELECT 'precision', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END FROM {name}k
  UNION ALL SELECT 'recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END FROM {name}k UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM {name}k
  UNION ALL SELECT 'auc_roc', sum(neg * (tp - pos / 2)) / (max(p) * max(n)) FROM {name}c
  UNION ALL SELECT 'auc_pr', sum(pos / p * tp / (tp + fp)) FROM {name}c)"""


@query("mod3_evaluate", sql(SCORED, "," + metrics_sql("true", "m") + f'SELECT metric, {g(chr(34) + "value" + chr(34))} AS "value" FROM m'))
def mod3(spark, sf):
    return gridded(Cu.evaluate(scored(spark, sf), LABEL, SCORE, CUT), ["value"])


@query("jon5_compare_models", sql(SCORED, "," + metrics_sql("model = 'Pro'", "a") + "," + metrics_sql("model = 'XP'", "b") + f"""
SELECT coalesce(a.metric, b.metric) AS metric, {g('a."value"')} AS pro, {g('b."value"')} AS xp
FROM a FULL JOIN (SELECT * FROM b WHERE metric <> 'f1') b ON a.metric = b.metric"""))
def jon5(spark, sf):
    d = scored(spark, sf)
    pro = Cu.evaluate(d.where("model = 'Pro'"), LABEL, SCORE, CUT)
    xp = Cu.evaluate(d.where("model = 'XP'"), LABEL, SCORE, CUT).where("metric <> 'f1'")
    return gridded(compare_models(pro, xp, ("pro", "xp")), ["pro", "xp"])


@query("mod5_class_weight", sql(SCORED, f"SELECT {g('least(sqrt(sum(1 - y) / CAST(greatest(sum(y), 1) AS DOUBLE)), 50e0)')} AS scale_pos_weight FROM sc"))
def mod5(spark, sf):
    return gridded(class_weight(scored(spark, sf), LABEL), ["scale_pos_weight"])


# -- scalers -------------------------------------------------------------------------------------

SEQ = SequenceConfig().columns
FIT = CLEAN + """,
seq_in AS (SELECT *, power_w / greatest(clock_frequency_mhz, 1e0) AS power_per_ghz FROM clean WHERE failure_type = 'none' AND hashrate_th > 1 AND voltage_v > 0.05e0),""" + scaler_sql(SEQ, 3, "seq_in")


def scaler_input(spark, sf):
    from fleetlens.functions.ratios import sequence_ratios
    return sequence_ratios(clean(spark, sf).where("failure_type = 'none'").where(is_alive()))


@query("ano1_fit_scaler", sql(FIT, "\nUNION ALL ".join(
    f"SELECT model, '{c}' AS feature, {g(f'mean_{c}', 5)} AS mean, {g(f'std_{c}', 5)} AS std FROM per_model "
    f"UNION ALL SELECT '*', '{c}', {g(f'mean_{c}', 5)}, {g(f'std_{c}', 5)} FROM overall" for c in SEQ)))
def ano1(spark, sf):
    return gridded(fit_scaler(scaler_input(spark, sf), SEQ).tidy(), ["mean", "std"], 5)


@query("ano2_apply_scaler", sql(FIT, f"""
SELECT event_id, {", ".join(g(f"(t.{c} - coalesce(p.mean_{c}, o.mean_{c})) / coalesce(p.std_{c}, o.std_{c})", 5) + f" AS {c}_scaled" for c in SEQ)}
FROM seq_in t LEFT JOIN per_model p ON t.model = p.model CROSS JOIN overall o"""))
def ano2(spark, sf):
    d = scaler_input(spark, sf)
    out = fit_scaler(d, SEQ).apply(d)
    return gridded(out.select("event_id", *[f"{c}_scaled" for c in SEQ]), [f"{c}_scaled" for c in SEQ], 5)

"""Queries: risk, control actions, the safety guard, alerts, active failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import HEALTH_SQL, KPI, RISK, TEL, g, gridded, kpi, query, sql, telemetry, with_health
from fleetlens.catalog.cleaning import EVENTS_OF_FLEET, failure_events
from fleetlens.catalog.windows import ORDER
from fleetlens.operators import control as Ct
from fleetlens.operators.alerts import alerts, newest
from fleetlens.operators.joins import active_failures
from fleetlens.operators.ordering import INDEX
from fleetlens.operators.risk import risk_levels

# The sustained count as a state machine over the rows of each device.
RISK_SQL = KPI + f""",
rk AS (SELECT *, {HEALTH_SQL} AS health_score, row_number() OVER ({ORDER}) AS rn FROM kpi),
st(miner_id, rn, above, below) AS (
  SELECT miner_id, rn, CASE WHEN ai_score >= 0.25e0 THEN 1 ELSE 0 END, CASE WHEN ai_score >= 0.25e0 THEN 0 ELSE 1 END FROM rk WHERE rn = 1
  UNION ALL
  SELECT r.miner_id, r.rn,
    CASE WHEN r.ai_score >= 0.25e0 THEN s.above + 1 WHEN s.below + 1 >= {RISK.clear_rows} THEN 0 ELSE s.above END,
    CASE WHEN r.ai_score >= 0.25e0 THEN 0 ELSE s.below + 1 END
  FROM st s JOIN rk r ON r.miner_id = s.miner_id AND r.rn = s.rn + 1),
lv AS (SELECT r.*, CAST(s.above AS BIGINT) AS sustained,
  CASE WHEN s.above >= {RISK.critical_rows} THEN 3 WHEN s.above >= {RISK.high_rows} THEN 2 WHEN s.above >= {RISK.elevated_rows} THEN 1 ELSE 0 END AS ml,
  CASE WHEN health_score < 0.3e0 THEN 3 WHEN health_score < 0.5e0 THEN 2 WHEN health_score < 0.8e0 THEN 1 ELSE 0 END AS hl
  FROM rk r JOIN st s ON s.miner_id = r.miner_id AND s.rn = r.rn),
risk AS (SELECT *, ['LOW', 'ELEVATED', 'HIGH', 'CRITICAL'][ml + 1] AS ml_risk, ['LOW', 'ELEVATED', 'HIGH', 'CRITICAL'][hl + 1] AS health_risk,
  ['LOW', 'ELEVATED', 'HIGH', 'CRITICAL'][greatest(ml, hl) + 1] AS risk_level, greatest(ml, hl) >= 2 AS predicted_failure,
  CASE WHEN hl > ml THEN 'health' WHEN ml > hl THEN 'ai_model' ELSE 'both' END AS risk_source FROM lv)"""
RISK_COLUMNS = ["sustained", "ml_risk", "health_risk", "risk_level", "predicted_failure", "risk_source"]


def recursive(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body.strip()}"


def risk(spark, sf, keep_index=False):
    return risk_levels(with_health(kpi(spark, sf)), "ai_score", "health_score", RISK, keep_index=keep_index)


@query("rsk1_risk_escalation", recursive(RISK_SQL, f"SELECT event_id, miner_id, {', '.join(RISK_COLUMNS)} FROM risk"))
def rsk1(spark, sf):
    return risk(spark, sf).select("event_id", "miner_id", *RISK_COLUMNS)


# -- actions -----------------------------------------------------------------------

def _fmt(x, d):
    return f"printf('%.{d}f', floor(({x}) * 1e{d} + 0.5e0) / 1e{d})"


# Predicted failures of the fixture: the score alone decides.
ACTIONS = KPI + f""",
sp AS (SELECT k.*, s.f_min, s.f_max, ai_score > 0.9e0 AS predicted FROM kpi k JOIN spec s ON k.model = s.token),
th AS (SELECT event_id, "timestamp", miner_id, temperature_c, f_min, f_max, 0 AS o, 'set_frequency' AS action,
  greatest(f_min, clock_frequency_mhz - CASE WHEN temperature_c > 90 THEN 50e0 ELSE 25e0 END) AS "value",
  CASE WHEN temperature_c > 90 THEN 'Thermal critical: ' ELSE 'Thermal warning: ' END || {_fmt('temperature_c', 1)} || 'C' AS reason,
  CASE WHEN temperature_c > 90 THEN 'high' ELSE 'medium' END AS priority FROM sp WHERE temperature_c > 80),
en AS (SELECT event_id, "timestamp", miner_id, temperature_c, f_min, f_max, 1 AS o, 'set_frequency' AS action,
  CASE WHEN energy_price < 0.035e0 AND temperature_c < 70 THEN least(f_max, clock_frequency_mhz + 12.5e0)
    ELSE greatest(f_min, clock_frequency_mhz - 12.5e0) END AS "value",
  CASE WHEN energy_price < 0.035e0 AND temperature_c < 70 THEN 'Cheap energy: $' ELSE 'Expensive energy: $' END || {_fmt('energy_price', 3)} || '/kWh' AS reason,
  'low' AS priority FROM sp WHERE (energy_price < 0.035e0 AND temperature_c < 70) OR energy_price > 0.07e0),
dg AS (SELECT event_id, "timestamp", miner_id, temperature_c, f_min, f_max, 2 AS o, 'flag_maintenance' AS action, 1e0 AS "value",
  'AI prediction: anomaly_score=' || {_fmt('ai_score', 2)} AS reason, 'high' AS priority FROM sp WHERE predicted OR ai_score > 0.7e0),
te AS (SELECT event_id, "timestamp", miner_id, temperature_c, f_min, f_max, 3 AS o, 'flag_maintenance' AS action, 1e0 AS "value",
  'TE floor breach: te_health=' || {_fmt('te_health', 5)} || ' < 0.005' AS reason, 'medium' AS priority FROM sp WHERE te_health > 0 AND te_health < 0.005e0),
act0 AS (SELECT * FROM th UNION ALL SELECT * FROM en UNION ALL SELECT * FROM dg UNION ALL SELECT * FROM te),
act AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS INTEGER) AS rule_no FROM act0)"""


def action_input(spark, sf):
    return kpi(spark, sf).withColumns({
        "anomaly_score": F.col("ai_score"), "predicted_failure": F.col("ai_score") > 0.9})


def one_rule(spark, sf, rule):
    out = Ct.propose_actions(action_input(spark, sf), rules=[rule])
    return gridded(out.select("event_id", "miner_id", "action", "value", "reason", "priority"), ["value"])


def rule_sql(cte: str) -> str:
    return sql(ACTIONS, f"""SELECT event_id, miner_id, action, {g('"value"')} AS "value", reason, priority FROM {cte}""")


@query("ctl1_thermal_rule", rule_sql("th"))
def ctl1(spark, sf):
    return one_rule(spark, sf, Ct.thermal_rule())


@query("ctl2_energy_rule", rule_sql("en"))
def ctl2(spark, sf):
    return one_rule(spark, sf, Ct.energy_rule())


@query("ctl3_degradation_rule", rule_sql("dg"))
def ctl3(spark, sf):
    return one_rule(spark, sf, Ct.degradation_rule())


@query("ctl4_te_floor_rule", rule_sql("te"))
def ctl4(spark, sf):
    return one_rule(spark, sf, Ct.te_floor_rule())


@query("ctl5_propose_actions", sql(ACTIONS, f"""
SELECT event_id, miner_id, rule_no, action, {g('"value"')} AS "value", reason, priority FROM act"""))
def ctl5(spark, sf):
    out = Ct.propose_actions(action_input(spark, sf))
    return gridded(out.select("event_id", "miner_id", "rule_no", "action", "value", "reason", "priority"), ["value"])


GUARD = ACTIONS + """,
hot AS (SELECT *, coalesce(temperature_c >= 95 AND action <> 'flag_maintenance', false) AS too_hot FROM act),
lv0 AS (SELECT *, epoch_us("timestamp") AS t, row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp", event_id, rule_no) AS rn FROM hot WHERE NOT too_hot),
gd(miner_id, rn, ok, last_t, seen) AS (
  SELECT miner_id, rn, true, t, CAST(NULL AS BIGINT) FROM lv0 WHERE rn = 1
  UNION ALL
  SELECT a.miner_id, a.rn, a.action = 'flag_maintenance' OR a.t - s.last_t >= 300000000,
    CASE WHEN a.action = 'flag_maintenance' OR a.t - s.last_t >= 300000000 THEN a.t ELSE s.last_t END, s.last_t
  FROM gd s JOIN lv0 a ON a.miner_id = s.miner_id AND a.rn = s.rn + 1),
gres AS (
  SELECT a.*, d.ok AS approved, CASE WHEN NOT d.ok THEN 'Rate limited: last action '
    || CAST(CAST(floor((a.t - d.seen) / 1e6 + 0.5e0) AS BIGINT) AS VARCHAR) || 's ago' END AS rejection_reason
  FROM lv0 a JOIN gd d ON d.miner_id = a.miner_id AND d.rn = a.rn
  UNION ALL
  SELECT *, epoch_us("timestamp"), 0, false, 'Thermal shutdown: ' || """ + _fmt("temperature_c", 1) + """ || 'C >= 95.0C' FROM hot WHERE too_hot)"""


@query("ctl6_safety_guard", recursive(GUARD, f"""
SELECT event_id, miner_id, rule_no, action, approved, rejection_reason,
  {g('''CASE WHEN approved AND action = 'set_frequency' THEN least(greatest("value", f_min), f_max) ELSE "value" END''')} AS final_value FROM gres"""))
def ctl6(spark, sf):
    out = Ct.safety_guard(Ct.propose_actions(action_input(spark, sf)))
    return gridded(out.select("event_id", "miner_id", "rule_no", "action", "approved", "rejection_reason", "final_value"), ["final_value"])


# Dense series: all devices of one container as one unit, so that the interval binds.
@query("ctl6_safety_guard_dense", recursive(GUARD.replace("JOIN spec s ON k.model = s.token", "JOIN spec s ON k.model = s.token")
       .replace("kpi k JOIN", "(SELECT * REPLACE (container_id AS miner_id) FROM kpi) k JOIN"), """
SELECT event_id, miner_id, rule_no, action, approved, rejection_reason FROM gres"""))
def ctl6_dense(spark, sf):
    from fleetlens.operators.ordering import SLOT
    grouped = action_input(spark, sf).drop(SLOT).withColumn("miner_id", F.col("container_id"))
    out = Ct.safety_guard(Ct.propose_actions(grouped), chunk_rows=64, group=4)
    return out.select("event_id", "miner_id", "rule_no", "action", "approved", "rejection_reason")


@query("ctl7_emergency_shutdown", sql(TEL, f"""
SELECT event_id, miner_id, 'set_mode' AS action, 0e0 AS "value", 'EMERGENCY: ' || {_fmt('temperature_c', 1)} || 'C >= 95.0C' AS reason, 'critical' AS priority
FROM tel WHERE temperature_c >= 95"""))
def ctl7(spark, sf):
    return Ct.emergency_shutdown(telemetry(spark, sf)).select("event_id", "miner_id", "action", "value", "reason", "priority")


@query("ctl8_dashboard_rules", sql(ACTIONS, f"""
, d AS (SELECT *, clock_frequency_mhz AS f, CASE WHEN temperature_c > 90 THEN greatest(f_min, clock_frequency_mhz - 50)
    WHEN temperature_c > 82 THEN greatest(f_min, clock_frequency_mhz - 20) END AS cooled FROM sp),
d2 AS (SELECT *, coalesce(cooled, f) AS nw, energy_price < 0.035e0 AND temperature_c < 75 AS cheap, energy_price > 0.07e0 AS dear FROM d),
o AS (
  SELECT event_id, miner_id, 'REDUCE_FREQ' AS action, f AS old_value, cooled AS new_value,
    CASE WHEN temperature_c > 90 THEN 'Thermal critical: ' ELSE 'Thermal warning: ' END || {_fmt('temperature_c', 1)} || 'C' AS reason FROM d2 WHERE cooled IS NOT NULL AND cooled <> f
  UNION ALL SELECT event_id, miner_id, 'BOOST_FREQ', nw, least(f_max, nw + 15), 'Cheap energy: $' || {_fmt('energy_price', 3)} || '/kWh' FROM d2 WHERE cheap AND least(f_max, nw + 15) <> nw
  UNION ALL SELECT event_id, miner_id, 'THROTTLE_FREQ', nw, greatest(f_min, nw - 10), 'Expensive energy: $' || {_fmt('energy_price', 3)} || '/kWh' FROM d2 WHERE NOT cheap AND dear AND greatest(f_min, nw - 10) <> nw
  UNION ALL SELECT event_id, miner_id, 'FLAG_MAINTENANCE', 0e0, 1e0, 'Anomaly score: ' || {_fmt('ai_score', 4)} FROM
    (SELECT * FROM d2 WHERE predicted QUALIFY row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp", event_id) = 1) x)
SELECT event_id, miner_id, action, {g('old_value')} AS old_value, {g('new_value')} AS new_value, reason FROM o"""))
def ctl8(spark, sf):
    out = Ct.dashboard_actions(action_input(spark, sf))
    return gridded(out.select("event_id", "miner_id", "action", "old_value", "new_value", "reason"), ["old_value", "new_value"])


# -- alerts --------------------------------------------------------------------------

ALERTS_SQL = f"""
, s AS (SELECT *, rn - 1 AS step, {_fmt('temperature_c', 1)} AS deg FROM risk),
a AS (
  SELECT event_id, miner_id, 0 AS o, 'CRITICAL' AS severity, 'THERMAL SHUTDOWN ' || deg || 'C > 95.0C' AS message FROM s WHERE temperature_c > 95
  UNION ALL SELECT event_id, miner_id, 1, 'HIGH', 'Temperature critical: ' || deg || 'C' FROM s WHERE temperature_c > 90 AND temperature_c <= 95
  UNION ALL SELECT event_id, miner_id, 2, 'MEDIUM', 'Temperature warning: ' || deg || 'C' FROM s WHERE temperature_c > 85 AND temperature_c <= 90 AND step % 10 = 0
  UNION ALL SELECT event_id, miner_id, 3, 'HIGH', 'Hashrate drop: ' || CAST(CAST(floor(hashrate_realization * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || '% of nameplate'
    FROM s WHERE hashrate_realization < 0.7e0 AND operating_mode <> 'Shutdown'
  UNION ALL SELECT event_id, miner_id, 4, 'CRITICAL', 'AI Risk: CRITICAL - anomaly sustained ' || CAST(sustained AS VARCHAR) || ' min, immediate action needed' FROM s WHERE risk_level = 'CRITICAL' AND step % 20 = 0
  UNION ALL SELECT event_id, miner_id, 5, 'HIGH', 'AI Risk: HIGH - anomaly sustained ' || CAST(sustained AS VARCHAR) || ' min, schedule inspection' FROM s WHERE risk_level = 'HIGH' AND step % 20 = 0
  UNION ALL SELECT event_id, miner_id, 6, 'MEDIUM', 'AI Risk: ELEVATED - watching anomaly (' || CAST(sustained AS VARCHAR) || ' min)' FROM s WHERE risk_level = 'ELEVATED' AND step % 60 = 0),
numbered AS (SELECT a.event_id, a.miner_id, CAST(row_number() OVER (PARTITION BY a.event_id ORDER BY o) - 1 AS INTEGER) AS alert_no, severity, message, s."timestamp" AS ts
  FROM a JOIN s ON s.event_id = a.event_id)"""


@query("alr1_alerts", recursive(RISK_SQL, ALERTS_SQL + "SELECT event_id, miner_id, alert_no, severity, message FROM numbered"))
def alr1(spark, sf):
    return alerts(risk(spark, sf, keep_index=True), step=INDEX).select("event_id", "miner_id", "alert_no", "severity", "message")


@query("alr2_newest_alerts", recursive(RISK_SQL, ALERTS_SQL + "SELECT event_id, miner_id, alert_no, severity FROM numbered ORDER BY ts DESC, event_id DESC, alert_no DESC LIMIT 500"))
def alr2_alerts(spark, sf):
    found = alerts(risk(spark, sf, keep_index=True), step=INDEX)
    return newest(found, 500, ties=("alert_no",)).select("event_id", "miner_id", "alert_no", "severity")


@query("alr2_newest_actions", recursive(GUARD, """
SELECT event_id, miner_id, rule_no, action, approved FROM gres ORDER BY "timestamp" DESC, event_id DESC, rule_no DESC LIMIT 500"""))
def alr2_actions(spark, sf):
    done = Ct.safety_guard(Ct.propose_actions(action_input(spark, sf)))
    return newest(done, 500, ties=("rule_no",)).select("event_id", "miner_id", "rule_no", "action", "approved")


AS_OF = "2024-01-16 12:00:00"


@query("act1_active_failures", sql(TEL + "," + EVENTS_OF_FLEET, f"""
, s AS (SELECT miner_id, max(CASE WHEN ai_score > 0.7e0 THEN 1 ELSE 0 END) = 1 AS flag FROM tel WHERE "timestamp" <= TIMESTAMP '{AS_OF}' GROUP BY 1),
e AS (SELECT f.*, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(onset_ts)) / 6e7 AS el FROM fev f),
p AS (SELECT *, CASE WHEN el < 0 THEN 0e0 ELSE least(1e0, el / 17280e0) END AS progress FROM e)
SELECT p.miner_id, failure_type, {g('progress')} AS progress, CASE WHEN el < 0 THEN 'pending' WHEN progress < 1 THEN 'active' ELSE 'complete' END AS status,
  coalesce(flag, false) AND el >= 0 AS detected FROM p LEFT JOIN s ON s.miner_id = p.miner_id"""))
def act1(spark, sf):
    tel = telemetry(spark, sf).withColumn("predicted_failure", F.col("ai_score") > 0.7)
    return gridded(active_failures(tel, failure_events(spark, sf), AS_OF), ["progress"])

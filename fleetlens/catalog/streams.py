"""Queries: streaming operators run over the event log as a stream."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from fleetlens.catalog.base import (
    FEATURES, KPI, RATIOS, RAW_KPI, RISK, TEL, g, gridded, query, sql, with_health,
)
from fleetlens.catalog.cleaning import TELEMETRY_COLUMNS, TELEMETRY_SQL
from fleetlens.catalog.control import GUARD, RISK_COLUMNS, RISK_SQL, recursive
from fleetlens.catalog.summaries import KPI_TICK, TICK_SQL
from fleetlens.catalog.windows import (
    MATRIX, MATRIX_SHOWN, ORDER, PEER_GROUP, _PEER_SQL, _ZS, acf_table, digits_of, matrix_input, peak_ctes,
)
from fleetlens.operators import features as Ft
from fleetlens.operators.control import propose_actions
from fleetlens.operators.features import feature_matrix
from fleetlens.operators.filters import latest
from fleetlens.operators.kpi import with_true_efficiency
from fleetlens.operators.live import parity
from fleetlens.session import scratch_path
from fleetlens.sources.fixture import EVENT_SCHEMA, events_to_telemetry, read_events
from fleetlens.streaming import ingest as In
from fleetlens.streaming.live import live_features
from fleetlens.streaming.stateful import live_guard, live_risk

PARITY_FEATURES = [*MATRIX, *[f"{c}_acf1" for c in Ft.ACF_COLUMNS], *[f"{c}_peaks_per_hour" for c in Ft.PEAK_COLUMNS], *_ZS]
NOT_FEATURES = ("event_id", "time_slot", "energy_price", "ai_score", "recon_error", "period")


def telemetry_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A pattern, because a file stream takes folders or patterns but no single file.
    return events_to_telemetry(In.read_stream(spark, f"{sf}/events.parque[t]", EVENT_SCHEMA))


@query("str1_stream_ingest", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel"))
def str1(spark, sf):
    stream = In.deduplicated(telemetry_stream(spark, sf), ["miner_id", "event_id"])
    return spark.read.parquet(In.drain(stream.select(*TELEMETRY_COLUMNS), "str1"))


# Arrivals end inside a day, so a micro-batch goes on where the one before cut it.
CUTS = ("2024-01-01 00:00:00", "2024-01-09 13:30:00", "2024-01-21 05:00:00", "9999-01-01 00:00:00")


BY_TIME = [f"ts >= TIMESTAMP_NTZ '{lo}' AND ts < TIMESTAMP_NTZ '{hi}'" for lo, hi in zip(CUTS, CUTS[1:])]


def arrivals(spark, sf, folder, parts=BY_TIME):
    """Delivers the event log in parts, one at a time; yields the stream that sees what is there."""
    events = read_events(spark, sf)
    for condition in parts:
        events.where(condition).write.mode("append").parquet(folder)
        yield events_to_telemetry(In.read_stream(spark, folder, EVENT_SCHEMA))


def streamed(spark, sf, name, min_history, cfg=FEATURES):
    """One micro-batch per arrival, each in a query of its own that goes on from the last one's state."""
    root = scratch_path(spark, name)
    for stream in arrivals(spark, sf, f"{root}/arrivals"):
        path = live_features(
            stream, name, cfg, min_history=min_history, peer_group=PEER_GROUP, root=root,
            prepare=lambda d: d.withColumn("period", F.date_trunc("day", "timestamp")))
    return spark.read.parquet(path)


def newest_sql(batch: int, lo: str, hi: str) -> str:
    """The newest feature row of each device that got one in an arrival, from all that has arrived."""
    seen = RATIOS.replace("FROM events)", f"FROM events WHERE ts < TIMESTAMP '{hi}')")
    shown = ", ".join(f"{g(f'coalesce({c}, 0e0)', digits_of(c))} AS {c}" for c in MATRIX_SHOWN)
    body = sql(seen, f""",
numbered AS (SELECT *, row_number() OVER ({ORDER}) - 1 AS n, CAST(row_number() OVER ({ORDER}) - 1 AS DOUBLE) AS x, date_trunc('day', "timestamp") AS period FROM rat),
rolled AS (SELECT event_id, miner_id, "timestamp", n, {", ".join(_ZS)}, {", ".join(f"{e} AS {c}" for c, e in MATRIX.items())},
  {", ".join(f"{e} AS {c}" for c, e in _PEER_SQL.items())} FROM numbered)
{"".join(acf_table(c, "rat") for c in Ft.ACF_COLUMNS)}{peak_ctes(Ft.PEAK_COLUMNS, "rat")}
SELECT {batch} AS batch, event_id, miner_id, {shown}
FROM (SELECT * FROM rolled QUALIFY row_number() OVER (PARTITION BY miner_id ORDER BY n DESC) = 1) newest
{" ".join(f"JOIN a_{c} USING (event_id)" for c in Ft.ACF_COLUMNS)} JOIN (SELECT * EXCLUDE (miner_id) FROM peaks) pk2 USING (event_id)
WHERE n + 1 >= 10 AND "timestamp" >= TIMESTAMP '{lo}'""")
    return f"SELECT * FROM ({body})"


@query("str2_live_features", "\nUNION ALL\n".join(newest_sql(k, lo, hi) for k, (lo, hi) in enumerate(zip(CUTS, CUTS[1:]))))
def str2(spark, sf):
    live = streamed(spark, sf, "str2", min_history=10)
    return gridded(live.select("batch", "event_id", "miner_id", *MATRIX_SHOWN), {c: digits_of(c) for c in MATRIX_SHOWN})


@query("str4_live_risk", recursive(RISK_SQL.replace(KPI, RAW_KPI), f"SELECT event_id, miner_id, {', '.join(RISK_COLUMNS)} FROM risk"))
def str4(spark, sf):
    stream = with_health(with_true_efficiency(telemetry_stream(spark, sf))).select(
        "event_id", "miner_id", "timestamp", "ai_score", "health_score")
    out = live_risk(stream, "ai_score", "health_score", RISK).select("event_id", "miner_id", *RISK_COLUMNS)
    return spark.read.parquet(In.drain(out, "str4"))


@query("str5_live_control", recursive(GUARD.replace(KPI, RAW_KPI), f"""
SELECT event_id, miner_id, rule_no, action, approved, rejection_reason,
  {g('''CASE WHEN approved AND action = 'set_frequency' THEN least(greatest("value", f_min), f_max) ELSE "value" END''')} AS final_value FROM gres"""))
def str5(spark, sf):
    rows = with_true_efficiency(telemetry_stream(spark, sf)).withColumns({
        "anomaly_score": F.col("ai_score"), "predicted_failure": F.col("ai_score") > 0.9})
    out = live_guard(propose_actions(rows)).select(
        "event_id", "miner_id", "rule_no", "action", "approved", "rejection_reason", "final_value")
    return gridded(spark.read.parquet(In.drain(out, "str5")), ["final_value"])


@query("str6_buffered_append", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel"))
def str6(spark, sf):
    # The table is emptied on start, then every flush writes its own batch.
    path = scratch_path(spark, "str6")
    In.flush_batches(telemetry_stream(spark, sf).select(*TELEMETRY_COLUMNS), path)
    return In.flushed(spark, path).drop("batch")


@query("str7_live_fleet_kpis", sql(RAW_KPI, TICK_SQL))
def str7(spark, sf):
    rows = with_health(with_true_efficiency(telemetry_stream(spark, sf)))
    return gridded(In.drain_updates(In.live_fleet_kpis(rows, "1 hour"), "str7", ["tick_start"]), KPI_TICK)


@query("str8_batch_live_parity", sql(TEL, """
, f(feature) AS (VALUES """ + ", ".join(f"('{c}')" for c in PARITY_FEATURES) + """)
SELECT feature, (SELECT count(DISTINCT miner_id) FROM tel WHERE hashrate_th IS NOT NULL) AS n_rows, (SELECT count(DISTINCT miner_id) FROM tel WHERE hashrate_th IS NOT NULL) AS n_match FROM f"""))
def str8(spark, sf):
    """Every feature but the peers' of every device's newest row: live after several arrivals that cut days, and batch."""
    cfg = dataclasses.replace(FEATURES, warmup_cap=0, peers=False)
    batch = latest(feature_matrix(matrix_input(spark, sf), cfg, peer_group=PEER_GROUP))
    live = latest(streamed(spark, sf, "str8", min_history=1, cfg=cfg)).drop("batch")
    return parity(batch, live, PARITY_FEATURES)

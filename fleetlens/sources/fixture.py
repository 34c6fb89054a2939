"""Telemetry view over a generic event log.

Maps an event table (event_id, ts, user_id, event_type, value, props) to the
telemetry schema.  Every column is a deterministic expression of its row, so
the view grows with the log and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.schema import FAILURE_TYPES, HARDWARE
from fleetlens.session import small_tasks

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
DAY_ZERO = "2024-01-01"


def _pick(position, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def events_to_telemetry(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    base = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        u.alias("u"),
        "event_type",
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.datediff(F.col("ts").cast("date"), F.lit(DAY_ZERO).cast("date")).alias("dd"),
        F.hour("ts").alias("hh"),
    )
    u, k, v, dd, hh = (F.col(c) for c in ("u", "k", "v", "dd", "hh"))
    hw = u % 4
    start = 6 + u % 7
    base = base.withColumn(
        "degradation_phase",
        F.when((u % 2 == 1) | (dd < start), "healthy")
        .when(dd < start + 7, "incubation")
        .when(dd < start + 11, "acceleration")
        .when(dd < start + 12, "cascade")
        .otherwise("failed"),
    )
    phase = F.col("degradation_phase")
    base = base.withColumns({
        "deg": F.when(phase == "healthy", 0.0).when(phase == "incubation", 0.05)
        .when(phase == "acceleration", 0.2).when(phase == "cascade", 0.5).otherwise(0.8),
        "operating_mode": F.when((phase == "failed") & (k < 30), "Shutdown")
        .when((F.col("event_type") == "signup") & (k < 15), "Idle").otherwise("Normal"),
    })
    deg, mode, eid = F.col("deg"), F.col("operating_mode"), F.col("event_id")
    off = mode != "Normal"
    np_th = _pick(hw, [h[2] for h in HARDWARE])
    np_w = _pick(hw, [h[3] for h in HARDWARE])
    f_def = _pick(hw, [h[4] for h in HARDWARE])
    v_def = _pick(hw, [h[7] for h in HARDWARE])
    return base.select(
        "event_id",
        "timestamp",
        F.concat(F.lit("MNR-"), F.lpad((u + 1).cast("string"), 5, "0")).alias("miner_id"),
        _pick(hw, [h[0] for h in HARDWARE]).alias("model"),
        F.concat(F.lit("C-"), F.floor(u / 10).cast("string")).alias("container_id"),
        (u % 10 + 1).cast("int").alias("position"),
        F.when(off, 0.0).otherwise(f_def * (0.92 + 0.0016 * k)).alias("clock_frequency_mhz"),
        F.when(off, 0.0).otherwise(v_def * (1 + (k - 50) * 0.001 - 0.1 * deg)).alias("voltage_v"),
        F.when(eid % 53 == 0, F.lit(None)).when(off, 0.0)
        .otherwise(np_th * (0.80 + 0.0025 * k) * (1 - deg)).alias("hashrate_th"),
        F.when(eid % 59 == 0, F.lit(None)).otherwise(45 + 0.35 * k + 30 * deg).alias("temperature_c"),
        F.when(eid % 61 == 0, F.lit(None)).when(mode == "Shutdown", 50.0).when(mode == "Idle", 100.0)
        .otherwise(np_w * (0.90 + v / 2500)).alias("power_w"),
        (20 + 0.5 * hh).alias("ambient_temperature_c"),
        "operating_mode",
        F.when(phase == "healthy", "none").otherwise(_pick(F.floor(u / 2) % 8, FAILURE_TYPES)).alias("failure_type"),
        "degradation_phase",
        phase.isin("incubation", "acceleration").alias("is_pre_failure"),
        (0.030 + 0.002 * hh).alias("energy_price"),
        F.round(F.least(F.lit(1.0), 0.006 * k + 0.6 * deg), 2).alias("ai_score"),
        F.round(0.5 + 0.01 * k + 4 * deg, 2).alias("recon_error"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def read_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = read_events(spark, sf_dir)
    small_tasks(spark, events.count())
    return events_to_telemetry(events)

"""What one task holds: narrow rows only, and a bounded number of them."""

from pyspark.sql import functions as F

from fleetlens import session as Se
from fleetlens.catalog.base import FEATURES
from fleetlens.operators.clean import preprocess
from fleetlens.operators.features import feature_matrix
from fleetlens.operators.kpi import with_true_efficiency
from fleetlens.operators.ordering import with_time_slot
from fleetlens.operators.peers import peer_features
from fleetlens.sources import fixture as Fx

PEERS = ["container_avg_temp", "container_max_temp", "neighbor_temp_delta", "container_temp_rank", "efficiency_deviation"]


def cleaned(spark):
    n = F.col("id")
    raw = spark.range(120).select(
        n.alias("event_id"), F.timestamp_seconds(n * 60).alias("timestamp"), F.concat(F.lit("d"), (n % 3).cast("string")).alias("miner_id"),
        F.lit("Pro").alias("model"), F.lit("C-0").alias("container_id"), (n % 3).cast("int").alias("position"),
        F.lit(500.0).alias("clock_frequency_mhz"), F.lit(0.38).alias("voltage_v"), (200.0 + n % 11).alias("hashrate_th"),
        (50.0 + n % 7).alias("temperature_c"), (3000.0 + n).alias("power_w"), F.lit(25.0).alias("ambient_temperature_c"),
        F.lit("Normal").alias("operating_mode"), F.lit("none").alias("failure_type"), F.lit("healthy").alias("degradation_phase"), F.lit(False).alias("is_pre_failure"))
    return with_true_efficiency(preprocess(with_time_slot(raw))).withColumn("period", F.date_trunc("hour", "timestamp"))


def test_features_are_not_shuffled(spark):
    """No task sorts or exchanges rows that carry their features; peers keep their values and their place."""
    kpi = cleaned(spark)
    made = feature_matrix(kpi, FEATURES, peer_group=("container_id", "period"))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    after_rolls = plan[:plan.index("MapInArrow")]
    assert "Window" not in after_rolls and "Sort" not in after_rolls and "Exchange" not in after_rolls
    assert made.columns[-5:] == PEERS
    plain = peer_features(kpi.withColumn("jth", F.col("power_w") / F.col("hashrate_th")), ("container_id", "period"))
    want = {r["event_id"]: [r[c] for c in PEERS] for r in plain.collect()}
    got = made.select("event_id", *PEERS).collect()
    assert len(got) == 120 - 3 * FEATURES.warmup
    assert all(abs(a - b) < 1e-9 for r in got for a, b in zip(r[1:], want[r["event_id"]]))


def test_partitions_follow_the_rows(spark, tmp_path, monkeypatch):
    """A larger table has more partitions, not larger ones."""
    events = spark.range(64).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 4).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 50}').alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get(Se.PARTITIONS_KEY, None)
    try:
        monkeypatch.setattr(Se, "TASK_ROWS", 2)
        rows = Fx.read_telemetry(spark, str(tmp_path))
        assert spark.conf.get(Se.PARTITIONS_KEY) == "32"
        assert rows.count() == 64
        monkeypatch.setattr(Se, "TASK_ROWS", 50_000)
        Fx.read_telemetry(spark, str(tmp_path))
        assert spark.conf.get(Se.PARTITIONS_KEY) == "32"  # a smaller table takes nothing back, AQE joins its partitions
    finally:
        spark.conf.unset(Se.PARTITIONS_KEY) if before is None else spark.conf.set(Se.PARTITIONS_KEY, before)

"""Windows over time, kept summaries, sketches, sessions, clustered tables, live state and the model store."""

import dataclasses
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog.base import FEATURES, telemetry
from fleetlens.operators import sketches as Sk
from fleetlens.operators.kept import refresh_summary
from fleetlens.operators.ordering import with_time_slot
from fleetlens.operators.time_windows import TimeRoll, time_rolling
from fleetlens.session import scratch_path, stored
from fleetlens.sources import tables as Tb
from fleetlens.sources.clustered import clustered_rates, write_clustered
from fleetlens.streaming.ingest import read_stream
from fleetlens.streaming.live import late_rows, live_features, merged_totals, totals_of
from fleetlens.streaming.sessions import known_sessions, live_sessions

START = datetime(2024, 1, 1)
READING = "miner_id string, timestamp timestamp, event_id long, power_w double"


def readings(n, seed, span=40_000):
    """Gaps, several readings of one time, nulls, a device without a name."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.02 else START + timedelta(seconds=60 * rng.randrange(span // 60)), i,
             None if rng.random() < 0.1 else 5.0 if rng.random() < 0.2 else rng.uniform(0, 100)) for i in range(n)]


@pytest.mark.parametrize("seconds", [60, 600, 7200, 1_000_000])
def test_windows_over_time(spark, seconds):
    rows = readings(400, seconds)
    kinds = ("mean", "std", "min", "max", "count")
    df = spark.createDataFrame(rows, READING).repartition(5)
    out = {r.event_id: r for r in time_rolling(df, [TimeRoll(k, "power_w", seconds, k, min_obs=2) for k in kinds]).collect()}
    for k, t, i, _ in rows:
        seen = [] if t is None else [x for m, s, _, x in rows if m == k and s is not None and timedelta(0) <= t - s <= timedelta(seconds=seconds) and x is not None]
        if len(seen) < 2:
            assert all(out[i][c] is None for c in kinds)
            continue
        mean = sum(seen) / len(seen)
        std = (sum((x - mean) ** 2 for x in seen) / (len(seen) - 1)) ** 0.5
        assert [out[i][c] for c in kinds] == pytest.approx([mean, std, min(seen), max(seen), len(seen)], abs=1e-9)
    assert time_rolling(df.limit(0), [TimeRoll("mean", "power_w", seconds, "m")]).count() == 0


def test_only_changed_days_are_made_again(spark, sf):
    tel, root = telemetry(spark, sf), scratch_path(spark, "kept")
    days = tel.select(F.to_date("timestamp")).distinct().count()
    day = F.to_date("timestamp")
    first, made = refresh_summary(tel, root)
    assert made == days
    key = lambda d: sorted(map(tuple, d.collect()))
    before = key(first)
    again, made = refresh_summary(tel, root)
    assert made == 0 and key(again) == before
    # A reading that nothing is filled from touches its own day; one day more is made again where it goes.
    wrong = tel.withColumn("ambient_temperature_c", F.when(day == "2024-01-30", F.col("ambient_temperature_c") + 1).otherwise(F.col("ambient_temperature_c")))
    _, made = refresh_summary(wrong, root)
    assert made == 1  # the last day: no later day is filled from it
    _, made = refresh_summary(tel.where(day != "2024-01-30"), root)
    assert made == 0
    back, made = refresh_summary(tel, root)
    assert made == 1
    close = lambda a, b: all(x == pytest.approx(y) for x, y in zip(a, b))
    assert all(close(a, b) for a, b in zip(key(back), before))


def test_percentiles_are_exact_whatever_the_sketch_says(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 1000 + [None] * 5
    df = spark.createDataFrame([("m", START.date(), v) for v in values], "miner_id string, day date, v double")
    good = Sk.day_sketches(df, "v", "v")
    bad = Sk.day_sketches(df.withColumn("v", F.col("v") + 50), "v", "v")
    known = sorted(v for v in values if v is not None)
    for fraction in (0.0, 0.95, 1.0):
        at = fraction * (len(known) - 1)
        low, high = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
        for sketches in (good, bad):
            assert Sk.refined_percentile(df, sketches, "v", fraction).first()[0] == pytest.approx(low + (high - low) * (at - int(at)))
    none = df.where("v is null")
    assert Sk.refined_percentile(none, Sk.day_sketches(none, "v", "v"), "v", 0.5).first()[0] is None


def test_sessions_over_batches_and_late_rows(spark):
    rng = random.Random(6)
    rows = [r for r in readings(600, 9, 900_000)]
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1])
    late = [r for r in order[:200] if rng.random() < 0.1]
    kept = [r for r in order if r not in late]
    parts = [kept[:150], kept[150:400], kept[400:] + late, []]
    folder, root = scratch_path(spark, "arrivals"), scratch_path(spark, "sessions")
    for part in parts:
        spark.createDataFrame(part, READING).write.mode("append").parquet(folder)
        live_sessions(read_stream(spark, folder, spark.createDataFrame([], READING).schema), root, 3600, 7200)
    got = sorted((r.miner_id or "", r.start_ts, r.end_ts, r.n_rows) for r in known_sessions(spark, root).collect())
    assert {r.event_id for r in spark.read.parquet(f"{root}/late").collect()} == {r[2] for r in late}
    want = []
    for k in ("hot", "a", None):
        times = sorted(r[1] for r in kept if r[0] == k)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > timedelta(hours=1):
                want.append((k or "", run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((k or "", run[0], run[-1], len(run)))
    assert got == sorted(want)
    # What is closed has left the state.
    state = spark.read.parquet(f"{root}/open")
    last = state.agg(F.max("batch")).first()[0]
    assert state.where(F.col("batch") == last).count() < len(want)


def test_clustered_table_is_read_without_an_exchange(spark, sf):
    rows = with_time_slot(telemetry(spark, sf), rows_per_slot=8)
    write_clustered(rows, "clustered_test", 1, ["power_w"], buckets=8, path=scratch_path(spark, "clustered"))
    out = clustered_rates(spark, "clustered_test", ["power_w"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert rows.select("miner_id", "time_slot").distinct().count() > 3 * rows.select("miner_id").distinct().count()
    assert out.count() == rows.count()


def test_live_state_is_bounded_and_late_rows_change_nothing(spark, sf):
    raw = stored(telemetry(spark, sf).drop("batch"), scratch_path(spark, "raw"))
    cuts = ["2024-01-01", "2024-01-08 07:00:00", "2024-01-17 19:30:00", "2024-02-01"]
    cfg = dataclasses.replace(FEATURES, peers=False)

    def run(with_late):
        folder, root = scratch_path(spark, "arrivals"), scratch_path(spark, "live")
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            part = raw.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
            if with_late and k == 2:  # the first days once more
                part = part.unionByName(raw.where(F.col("timestamp") < "2024-01-03").withColumn("event_id", F.col("event_id") + 10**6))
            part.write.mode("append").parquet(folder)
            live_features(read_stream(spark, folder, raw.schema), "live", cfg, min_history=1, peer_group=("container_id",), root=root)
        return root

    plain, mixed = run(False), run(True)
    rows = lambda root: sorted(map(str, spark.read.parquet(f"{root}/features").select("batch", "event_id", "miner_id", "power_w_roll_30m_mean", "temperature_c_zscore").collect()))
    assert rows(plain) == rows(mixed)
    assert late_rows(spark, mixed).count() == raw.where(F.col("timestamp") < "2024-01-03").count() and late_rows(spark, plain).count() == 0
    newest = spark.read.parquet(f"{mixed}/state/batch=2/recent").groupBy("miner_id").count().agg(F.max("count")).first()[0]
    assert newest <= 40
    assert not Tb.path_exists(spark, f"{mixed}/state/batch=0") and Tb.path_exists(spark, f"{mixed}/state/batch=1")


def test_totals_merge_like_one_pass(spark, sf):
    rows = telemetry(spark, sf).withColumn("efficiency_jth", F.col("power_w") / 3)
    parts = [rows.where("event_id % 3 = 0 and miner_id < 'MNR-00009'"), rows.where("event_id % 3 = 1"), rows.where("event_id % 3 = 2")]
    state = None
    for part in parts:
        state = merged_totals(state, totals_of(part))
    whole = totals_of(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    key = lambda d: {r.miner_id: [x for c in ("power_w", "temperature_c") for x in r[c]] for r in d.collect()}
    a, b = key(state), key(whole)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_content_stamp_names_rows_not_their_order(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, v double")
    stamp = Tb.content_stamp(df, "cfg")
    assert stamp == Tb.content_stamp(df.orderBy(F.desc("k")).repartition(3), "cfg")
    assert stamp != Tb.content_stamp(df.withColumn("v", F.when(F.col("k") == 5, 0.1).otherwise(F.col("v"))), "cfg")
    assert stamp != Tb.content_stamp(df, "other") and stamp != Tb.content_stamp(df.limit(99), "cfg")


def test_a_model_is_fitted_once_per_content(spark):
    from fleetlens.catalog.models import CONFIG
    from fleetlens.plans import training as Tr

    rows = stored(spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 3 == 0).alias("is_pre_failure")), scratch_path(spark, "fit"))
    cfg, store = dataclasses.replace(CONFIG, max_iter=3, max_depth=2), scratch_path(spark, "models")
    one = Tr.fit_classifier(rows, rows, cfg, store=store, stamp="s")
    fit = Tr.FailureClassifier.fit
    try:
        Tr.FailureClassifier.fit = classmethod(lambda *a, **k: pytest.fail("fitted again"))
        two = Tr.fit_classifier(rows, rows, cfg, store=store, stamp="s")
    finally:
        Tr.FailureClassifier.fit = fit
    assert two.threshold == one.threshold and two.features == one.features
    assert Tr.fit_classifier(rows, rows, dataclasses.replace(cfg, max_iter=4), store=store, stamp="s").trees.getNumTrees == 4

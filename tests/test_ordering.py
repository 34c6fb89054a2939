"""Ordered building blocks against brute force, with chunks and slots far smaller than the series."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import control as Ct
from fleetlens.operators import features as Ft
from fleetlens.operators.clean import forward_fill, missing_as_null
from fleetlens.operators.ordering import Series, running_totals, with_row_index, with_time_slot
from fleetlens.operators.phases import phase_runs
from fleetlens.operators.risk import sustained_rows
from fleetlens.operators.rolling import Roll, rolling
from fleetlens.schema import RiskConfig

START = pd.Timestamp("2024-01-01")


def series_frame(spark, n=400, seed=1, hot_share=0.7):
    """One device holds most rows; values have gaps and constant stretches."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        miner = "hot" if rng.random() < hot_share else f"m{rng.randrange(4)}"
        a = None if rng.random() < 0.1 else (5.0 if (i // 40) % 3 == 1 else rng.gauss(100, 20))
        b = None if rng.random() < 0.1 else rng.gauss(3500, 400)
        rows.append((i, START + pd.Timedelta(minutes=3 * i), miner, a, b, rng.random()))
    pdf = pd.DataFrame(rows, columns=["event_id", "timestamp", "miner_id", "a", "b", "score"])
    return missing_as_null(spark.createDataFrame(pdf)), pdf.sort_values(["miner_id", "timestamp"]).reset_index(drop=True)


def test_row_index_and_totals(spark):
    df, pdf = series_frame(spark)
    out = with_row_index(with_time_slot(df, 7), total="n").toPandas().sort_values("event_id")
    want = pdf.assign(i=pdf.groupby("miner_id").cumcount()).sort_values("event_id")
    assert out.row_idx.tolist() == want.i.tolist()
    assert (out.n == out.groupby("miner_id").event_id.transform("size")).all()


def test_time_slots_follow_the_row_rate(spark):
    df, _ = series_frame(spark)
    sizes = with_time_slot(df, 10).groupBy("miner_id", "time_slot").count().agg(F.max("count")).first()[0]
    assert sizes <= 25


def test_running_totals_descending(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(50)], "v double, n long")
    out = running_totals(df, Series((), ("v",), ("floor(v / 7)",)), {"t": F.col("n")}, ("t",), descending=True)
    assert {r.v: r.t for r in out.collect()} == {float(i): sum(range(i, 50)) for i in range(50)}
    assert out.first().t_all == sum(range(50))


@pytest.mark.parametrize("window,chunk", [(7, 40), (25, 30), (25, 1000)])
@pytest.mark.parametrize("native", [1, 100])
def test_rolling_matches_pandas(spark, window, chunk, native):
    df, pdf = series_frame(spark)
    need = max(2, window // 4)
    rolls = [
        Roll("mean", "a", window, "mean", need), Roll("std", "a", window, "std", need, fill=0.0),
        Roll("min", "a", window, "lo", need), Roll("max", "a", window, "hi", need),
        Roll("count", "a", window, "n", 0), Roll("corr", "a", window, "r", need, other="b", fill=0.0),
        Roll("slope", "b", window, "slope", need, fill=0.0),
    ]
    got = rolling(df, rolls, chunk_rows=chunk, native_rows=native).toPandas().sort_values(
        ["miner_id", "timestamp"]).reset_index(drop=True)
    by = pdf.groupby("miner_id", sort=False)
    roll = by["a"].rolling(window, min_periods=need)
    for name, want in (("mean", roll.mean()), ("std", roll.std().fillna(0)), ("lo", roll.min()), ("hi", roll.max())):
        pd.testing.assert_series_equal(got[name], want.reset_index(drop=True), check_names=False, rtol=1e-7, atol=1e-6)
    corr = by[["a", "b"]].apply(lambda g: g["a"].rolling(window, min_periods=need).corr(g["b"]))
    want = corr.reset_index(drop=True).replace([math.inf, -math.inf], math.nan).fillna(0)
    pd.testing.assert_series_equal(got["r"], want, check_names=False, rtol=1e-6, atol=1e-6)
    for _, g in got.groupby("miner_id"):
        for i in range(len(g)):
            part = g.iloc[max(0, i - window + 1): i + 1]
            x = [(k, v) for k, v in enumerate(part["b"]) if not math.isnan(v)]
            if len(x) < need:
                assert g["slope"].iloc[i] == 0
                continue
            mx, my = sum(k for k, _ in x) / len(x), sum(v for _, v in x) / len(x)
            slope = sum((k - mx) * (v - my) for k, v in x) / sum((k - mx) ** 2 for k, _ in x)
            assert g["slope"].iloc[i] == pytest.approx(slope, rel=1e-7, abs=1e-7)


def test_constant_stretch_has_no_spread_and_no_correlation(spark):
    pdf = pd.DataFrame({
        "event_id": range(60), "timestamp": [START + pd.Timedelta(minutes=i) for i in range(60)], "miner_id": "m",
        "a": [3510.1] * 60, "b": [float(i) for i in range(60)]})
    rolls = [Roll("std", "a", 20, "s", 2), Roll("corr", "a", 20, "r", 2, other="b", fill=0.0)]
    for native in (1, 100):
        out = rolling(spark.createDataFrame(pdf), rolls, chunk_rows=25, native_rows=native).toPandas()
        assert (out.s.dropna() == 0).all() and (out.r == 0).all()


def test_forward_fill_reaches_five_rows(spark):
    values = [1.0] + [None] * 5 + [2.0] + [None] * 6 + [3.0]
    pdf = pd.DataFrame({
        "event_id": range(len(values)), "timestamp": [START + pd.Timedelta(minutes=i) for i in range(len(values))],
        "miner_id": "m", "hashrate_th": values, "temperature_c": 50.0, "power_w": 1.0})
    every = Series(order=("timestamp", "event_id"), slots=("unix_seconds(cast(timestamp as timestamp)) div 120",))  # two rows a slot
    out = forward_fill(missing_as_null(spark.createDataFrame(pdf)), series=every).toPandas().sort_values("event_id")
    assert out.event_id.tolist() == [i for i in range(len(values)) if i != 12]
    assert out.hashrate_th.tolist() == [1.0] * 6 + [2.0] * 6 + [3.0]


def test_peaks_and_amplitude_across_chunks(spark):
    df, pdf = series_frame(spark, seed=5)
    small = Ft.peak_count(df, ["b"], 12, 1.5, 4, chunk_rows=30).toPandas().sort_values("event_id")
    by = pdf.groupby("miner_id", sort=False)["b"]
    mean, std = (getattr(by.rolling(12, min_periods=4), k)().reset_index(drop=True) for k in ("mean", "std"))
    hit = (pdf["b"] > mean + 1.5 * std).astype(int)
    want = hit.groupby(pdf["miner_id"], sort=False).rolling(12, min_periods=1).sum().reset_index(drop=True)
    assert small.b_peaks_per_hour.tolist() == want.set_axis(pdf.event_id).sort_index().tolist()


def machine(scores, cfg):
    above = below = 0
    out = []
    for s in scores:
        if s >= cfg.score_floor:
            above, below = above + 1, 0
        else:
            below += 1
            if below >= cfg.clear_rows:
                above = 0
        out.append(above)
    return out


def test_sustained_matches_state_machine(spark):
    cfg = RiskConfig(clear_rows=3, score_floor=0.6)
    df, pdf = series_frame(spark, seed=3)
    got = sustained_rows(df, "score", cfg, chunk_rows=11).toPandas().sort_values(["miner_id", "timestamp"])
    for miner, g in pdf.groupby("miner_id"):
        assert got[got.miner_id == miner].sustained.tolist() == machine(g.score, cfg)


def test_dips_of_fourteen_and_fifteen_rows(spark):
    scores = [0.9] * 5 + [0.0] * 14 + [0.9] + [0.0] * 15 + [0.9]
    pdf = pd.DataFrame({"event_id": range(len(scores)), "miner_id": "m", "score": scores,
                        "timestamp": [START + pd.Timedelta(minutes=i) for i in range(len(scores))]})
    out = sustained_rows(spark.createDataFrame(pdf), "score", RiskConfig(), chunk_rows=20).toPandas().sort_values("event_id")
    assert out.sustained.tolist() == machine(scores, RiskConfig())
    assert out.sustained.iloc[19] == 6 and out.sustained.iloc[-1] == 1


def test_phase_runs_across_chunks(spark):
    df, pdf = series_frame(spark, seed=9)
    phased = df.withColumn("degradation_phase", F.when(F.col("event_id") % 50 < 25, "healthy").otherwise("failed"))
    got = phase_runs(phased, chunk_rows=9).toPandas().sort_values(["miner_id", "run_no"])
    pdf["phase"] = ["healthy" if e % 50 < 25 else "failed" for e in pdf.event_id]
    change = (pdf.phase != pdf.groupby("miner_id").phase.shift()).astype(int)
    pdf["run_no"] = change.groupby(pdf.miner_id).cumsum()
    want = pdf.groupby(["miner_id", "run_no"]).agg(
        start=("timestamp", "min"), end=("timestamp", "max"), n=("event_id", "size")).reset_index()
    assert got.n_rows.tolist() == want.n.tolist()
    assert got.start_ts.tolist() == want.start.tolist() and got.end_ts.tolist() == want.end.tolist()


def guard(rows, gap=300):
    last, out = {}, []
    for miner, t, action, temp in rows:
        if temp >= 95 and action != "flag_maintenance":
            out.append(False)
        elif action.startswith("set_") and miner in last and t - last[miner] < gap:
            out.append(False)
        else:
            last[miner] = t
            out.append(True)
    return out


@pytest.mark.parametrize("seed,chunk,group", [(1, 5, 2), (2, 16, 3), (3, 3, 2), (4, 8192, 512)])
def test_guard_matches_sequential_check(spark, seed, chunk, group):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([1, 20, 60, 149, 299, 300])
        miner = "hot" if rng.random() < 0.8 else "cold"
        action = "flag_maintenance" if rng.random() < 0.05 else "set_frequency"
        rows.append((miner, t, action, 99.0 if rng.random() < 0.1 else 70.0))
    pdf = pd.DataFrame(rows, columns=["miner_id", "t", "action", "temperature_c"])
    pdf["event_id"], pdf["rule_no"] = range(len(rows)), 0
    pdf["timestamp"] = START + pd.to_timedelta(pdf.t, unit="s")
    pdf = pdf.assign(value=900.0, freq_min_mhz=200.0, freq_max_mhz=700.0, has_spec=True).drop(columns="t")
    out = Ct.safety_guard(spark.createDataFrame(pdf), chunk_rows=chunk, group=group).toPandas().sort_values("event_id")
    assert out.approved.tolist() == guard(rows)
    frequency = (out.action == "set_frequency") & out.approved
    assert (out.final_value[frequency] == 700.0).all()

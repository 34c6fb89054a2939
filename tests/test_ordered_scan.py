"""Prefix sums by range partitions, as-of joins, merged intervals and the halo exchange against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.halo import own_rows, with_halo
from fleetlens.operators.joins import apply_maintenance, as_of, merged_intervals
from fleetlens.operators.ordered_scan import positions, prefix_sums, ranks
from fleetlens.operators.ordering import Series

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_are_exact(spark, descending):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(5)])) for i in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    out = prefix_sums(df, [F.desc("k") if descending else F.asc("k")], {"upto": F.col("v")}, grand=("upto",)).collect()
    run, total = 0, sum(v or 0 for _, v in rows)
    want = {}
    for k, v in sorted(rows, reverse=descending):
        run += v or 0
        want[k] = run
    assert {r.k: r.upto for r in out} == want and {r.upto_all for r in out} == {total}
    assert all(set(r.asDict()) == {"k", "v", "upto", "upto_all"} for r in out)


def test_positions_and_ranks(spark):
    rng = random.Random(2)
    values = [None] * 3 + [rng.randrange(20) for _ in range(500)] + [7] * 2000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long")
    place = {r.i: r.pos for r in positions(df, [F.asc("i")], total="n").collect()}
    assert place == {i: i for i in range(len(values))}
    got = {r.i: r["rank"] for r in ranks(df, "v", descending=True).collect()}
    known = [v for v in values if v is not None]
    assert got == {i: (len(known) if v is None else sum(x > v for x in known)) + 1 for i, v in enumerate(values)}


def test_scan_of_nothing_has_no_empty_key_window(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert prefix_sums(df, [F.asc("k")], {"s": F.col("v")}, grand=("s",)).collect() == []
    plan = prefix_sums(spark.range(100), [F.asc("id")], {"s": F.col("id")})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def slow_as_of(rows, quotes, tolerance=None):
    out = []
    for k, t, i in rows:
        best = max(((q, v) for key, q, v in quotes if key == k and q is not None and t is not None and q <= t), default=None)
        if best and tolerance is not None and (t - best[0]).total_seconds() > tolerance:
            best = None
        out.append((i, best and best[1]))
    return sorted(out)


@pytest.mark.parametrize("bucket,tolerance", [(3600, None), (86_400, 7200), (60, None)])
def test_as_of_join(spark, bucket, tolerance):
    rng = random.Random(bucket)
    at = lambda: None if rng.random() < 0.03 else START + timedelta(minutes=rng.randrange(8000))
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    rows = [(key(), at(), i) for i in range(700)]
    quotes = [(key(), at(), float(rng.randrange(50))) for _ in range(300)] + [("a", START + timedelta(hours=3), 1000.0), ("a", START + timedelta(hours=3), 2000.0)]
    df = spark.createDataFrame(rows, "miner_id string, timestamp timestamp, i long")
    q = spark.createDataFrame(quotes, "miner_id string, timestamp timestamp, price double")
    got = as_of(df, q, ["price"], bucket_s=bucket, tolerance_s=tolerance).select("i", "price").collect()
    assert sorted(map(tuple, got)) == slow_as_of(rows, quotes, tolerance)
    # One series, without keys.
    got = as_of(df.where("miner_id = 'a'"), q.where("miner_id = 'a'"), ["price"], keys=(), bucket_s=bucket).select("i", "price").collect()
    assert sorted(map(tuple, got)) == slow_as_of([r for r in rows if r[0] == "a"], [x for x in quotes if x[0] == "a"])


def test_as_of_without_quotes_or_rows(spark):
    df = spark.createDataFrame([("a", START, 1)], "miner_id string, timestamp timestamp, i long")
    q = spark.createDataFrame([], "miner_id string, timestamp timestamp, price double")
    assert as_of(df, q, ["price"]).collect() == [("a", START, 1, None)]
    assert as_of(df.limit(0), q, ["price"]).collect() == []


def test_many_overlapping_windows(spark):
    rng = random.Random(4)
    minute = lambda m: START + timedelta(minutes=m)
    windows = [("a", minute(s), minute(s + rng.randrange(-2, 200))) for s in (rng.randrange(5000) for _ in range(150))] + [("b", None, minute(5)), ("b", minute(3), minute(3))]
    rows = [(rng.choice("abc"), minute(rng.randrange(5500)), "Normal", i) for i in range(900)] + [("b", minute(3), "Normal", 900), ("a", None, "Normal", 901)]
    df = spark.createDataFrame(rows, "miner_id string, timestamp timestamp, operating_mode string, i long")
    w = spark.createDataFrame(windows, "miner_id string, start_ts timestamp, end_ts timestamp")
    got = {r.i: (r.operating_mode, r.in_maintenance) for r in apply_maintenance(df, w).collect()}
    inside = lambda k, t: t is not None and any(k == m and a is not None and a <= t <= b for m, a, b in windows)
    assert got == {i: ("Idle", True) if inside(k, t) else ("Normal", False) for k, t, _, i in rows}
    flat = sorted((r.start_ts, r.end_ts) for r in merged_intervals(w).where("miner_id = 'a'").collect())
    assert all(a[1] < b[0] for a, b in zip(flat, flat[1:]))


@pytest.mark.parametrize("minutes", [1, 4, 60, 10_000])
def test_halo_holds_the_rows_before_a_slot(spark, minutes):
    rng = random.Random(minutes)
    rows = [(rng.choice(["hot", "hot", "x", None]), START + timedelta(minutes=3 * i), i, rng.choice([None, float(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "miner_id string, timestamp timestamp, event_id long, v double")
    series = Series(order=("timestamp", "event_id"), slots=(f"unix_seconds(timestamp) div {60 * minutes}",))
    both, slot = with_halo(df, 3, ["v"], series)
    out = own_rows(both.withColumn("sum", F.sum(F.coalesce("v", F.lit(0.0))).over(slot.rowsBetween(-3, 0))))
    got = {r.event_id: r["sum"] for r in out.collect()}
    want = {}
    for k in ("hot", "x", None):
        mine = [r for r in rows if r[0] == k]
        for j, r in enumerate(mine):
            want[r[2]] = sum(x[3] or 0 for x in mine[max(0, j - 3):j + 1])
    assert got == want and out.columns == ["miner_id", "timestamp", "event_id", "v", "sum"]

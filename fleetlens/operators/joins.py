"""Interval and as-of joins, metric alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440.0


def _minutes(n):
    return F.make_dt_interval(mins=n)


def phase_intervals(events: DataFrame) -> DataFrame:
    """One row per degradation phase of each failure event; the last one is open-ended."""
    t0 = F.col("onset_ts")
    t1 = t0 + _minutes(F.col("incubation_min").cast("int"))
    t2 = t1 + _minutes(F.col("acceleration_min").cast("int"))
    t3 = t2 + _minutes(F.col("cascade_min").cast("int"))

    def span(name, start, end):
        return F.struct(F.lit(name).alias("phase"), start.alias("from_ts"), end.alias("to_ts"))

    spans = F.array(
        span("incubation", t0, t1), span("acceleration", t1, t2), span("cascade", t2, t3),
        span("failed", t3, F.lit(None).cast("timestamp")),
    )
    return events.select("miner_id", F.col("failure_type").alias("event_type"), t3.alias("failed_ts"), F.inline(spans))


def label_phases(df: DataFrame, events: DataFrame) -> DataFrame:
    """Left range join: phase and days to failure of each reading.

    The event table has one short row per failure; the join is an equi join on
    the device with a range condition, so Spark broadcasts the events when they
    are small and otherwise sorts both sides by device.
    """
    spans = phase_intervals(events).withColumnRenamed("miner_id", "__miner")
    ts = F.col("timestamp")
    inside = (
        (df["miner_id"] == F.col("__miner")) & (ts >= F.col("from_ts"))
        & (F.col("to_ts").isNull() | (ts < F.col("to_ts")))
    )
    left = (F.unix_micros(F.col("failed_ts").cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 6e7
    days = F.when(F.col("phase") == "failed", 0.0).when(
        F.col("phase").isNotNull(), F.greatest(F.lit(0.0), left) / MINUTES_PER_DAY)
    return df.join(spans, inside, "left").select(
        *df.columns,
        F.coalesce("phase", F.lit("healthy")).alias("phase"),
        days.alias("days_left"),
    )


def merged_intervals(windows: DataFrame, start: str = "start_ts", end: str = "end_ts", key: str = "miner_id") -> DataFrame:
    """The windows of each device as disjoint ones: those that overlap or touch become one.

    Windows are short rows, few per device; one with no start or end, or that ends
    before it starts, holds nothing.
    """
    w = windows.where(F.col(start) <= F.col(end)).select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    along = Window.partitionBy("k").orderBy("s", "e")
    reach = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("s") > reach), F.lit(True)).cast("int")
    numbered = w.withColumn("opens", opens).withColumn("no", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(F.col("k").alias(key), "no").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("no")


def apply_maintenance(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows inside a maintenance window (start <= t <= end) switch to Idle.

    ``windows`` has miner_id, start_ts and end_ts.  They are merged first, so of
    all windows a row can only lie in the last one that starts before it: one
    as-of lookup per row, however many windows there are and overlap.
    """
    last = merged_intervals(windows).select("miner_id", F.col("start_ts").alias("timestamp"), F.col("end_ts").alias("__until"))
    met = as_of(df, last, ["__until"])
    inside = F.coalesce(F.col("timestamp") <= F.col("__until"), F.lit(False))
    return met.withColumns({
        "operating_mode": F.when(inside, F.lit("Idle")).otherwise(F.col("operating_mode")), "in_maintenance": inside,
    }).drop("__until")


def as_of(
    df: DataFrame, quotes: DataFrame, values: list[str], keys: tuple = ("miner_id",), time: str = "timestamp",
    bucket_s: int = 86_400, tolerance_s: int | None = None, tie_break: str | None = None,
) -> DataFrame:
    """Left as-of join: each row gets ``values`` of the newest quote of its key at or before its time.

    Time is cut into buckets. The newest quote of each bucket is carried forward
    over the buckets that hold rows or quotes (a scan over buckets, one row each);
    inside a bucket rows and quotes are ordered together. So no task sees more
    than one bucket of one key, and no row meets more than one quote. Of quotes of
    one time the one with the largest ``tie_break`` counts (without one, the largest
    values). A quote older than ``tolerance_s`` does not count. Rows and quotes
    without a key belong together; a quote without a time is left out, a row without
    one gets nothing. With no keys the whole table is one series.
    """
    keys = list(keys)
    ks = [f"__k{i}" for i in range(len(keys))]
    micros = lambda: F.unix_micros(F.col(time).cast("timestamp"))
    bucket = F.floor(F.col("__t") / (bucket_s * 1_000_000)).alias("__b")
    tie = [F.col(tie_break).alias("tie")] if tie_break else []
    quote = F.struct(micros().alias("t"), *tie, *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("__q")
    q = quotes.where(F.col(time).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], micros().alias("__t"), quote)
    # One quote per time is enough, and one time may have many.
    q = q.groupBy(*ks, "__t").agg(F.max("__q").alias("__q")).select(*ks, "__t", bucket, "__q")
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], micros().alias("__t"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__d"))
    rows = rows.select(*ks, "__t", bucket, "__d")

    latest = q.groupBy(*ks, "__b").agg(F.max("__q").alias("__q"))
    held = latest.unionByName(rows.where("__b is not null").select(*ks, "__b").distinct(), allowMissingColumns=True).groupBy(*ks, "__b").agg(F.max("__q").alias("__q"))
    if keys:
        past = Window.partitionBy(*ks).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = held.withColumn("__q", F.last("__q", ignorenulls=True).over(past))
    else:
        # One series: its buckets are scanned by year, years carry their last quote on.
        year = F.floor(F.col("__b") / 512)
        ends = held.groupBy(year.alias("__y")).agg(F.max("__q").alias("__e"))
        ends = ends.withColumn("__one", F.lit(0))
        ends = ends.withColumn("__e", F.last("__e", ignorenulls=True).over(Window.partitionBy("__one").orderBy("__y").rowsBetween(Window.unboundedPreceding, -1))).drop("__one")
        past = Window.partitionBy("__y").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = held.withColumn("__y", year).join(ends, "__y").withColumn("__q", F.coalesce(F.last("__q", ignorenulls=True).over(past), "__e")).drop("__y", "__e")

    # What is carried into a bucket stands before all of it; of one time, quotes come first.
    every = rows.withColumn("__o", F.lit(2)).unionByName(q.withColumn("__o", F.lit(1)), allowMissingColumns=True).unionByName(
        carried.where("__q is not null").withColumn("__t", F.lit(-(2 ** 62))).withColumn("__o", F.lit(0)), allowMissingColumns=True)
    seen = Window.partitionBy(*ks, "__b").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("__q", F.last("__q", ignorenulls=True).over(seen)).where("__o = 2")
    fresh = F.col("__t").isNotNull() & (F.lit(tolerance_s is None) | (F.col("__t") - F.col("__q.t") <= (tolerance_s or 0) * 1_000_000))
    return found.select("__d.*", *[F.when(fresh, F.col(f"__q.v{i}")).alias(v) for i, v in enumerate(values)])


def compare_models(a: DataFrame, b: DataFrame, names: tuple = ("model_a", "model_b")) -> DataFrame:
    """Align two (metric, value) tables on the union of metrics."""
    left = a.select("metric", F.col("value").alias(names[0]))
    right = b.select("metric", F.col("value").alias(names[1]))
    return left.join(right, "metric", "full_outer")


def active_failures(df: DataFrame, events: DataFrame, as_of, flag: str = "predicted_failure") -> DataFrame:
    """State of each failure event at a moment: progress, status and whether it is detected."""
    at = F.lit(as_of).cast("timestamp")
    seen = df.where(F.col("timestamp") <= at).groupBy("miner_id").agg(
        F.max(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).alias("__flag")
    )
    elapsed = (F.unix_micros(at) - F.unix_micros("onset_ts")) / 6e7
    total = F.greatest(F.col("incubation_min") + F.col("acceleration_min") + F.col("cascade_min"), F.lit(1))
    progress = F.when(elapsed < 0, 0.0).otherwise(F.least(F.lit(1.0), elapsed / total))
    return events.join(seen, "miner_id", "left").select(
        "miner_id", "failure_type", progress.alias("progress"),
        F.when(elapsed < 0, "pending").when(progress < 1.0, "active").otherwise("complete").alias("status"),
        (F.coalesce("__flag", F.lit(False)) & (elapsed >= 0)).alias("detected"),
    )

"""Row filters, deterministic picks and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.ordering import INDEX, TIE_BREAK, Series, with_row_index
from fleetlens.schema import REQUIRED_COLUMNS


def validate_schema(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def by_miners(df: DataFrame, miners) -> DataFrame:
    """Keep the listed devices; ``miners`` is a list or a DataFrame of miner_id."""
    if isinstance(miners, DataFrame):
        return df.join(miners.select("miner_id").distinct(), "miner_id", "left_semi")
    miners = list(miners)
    listed = df.sparkSession.createDataFrame([(m,) for m in miners], "miner_id string")
    return df.join(listed, "miner_id", "left_semi")


def by_time(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive, both bounds optional."""
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return df


def miner_ids(df: DataFrame) -> DataFrame:
    return df.select("miner_id").distinct().orderBy("miner_id")


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def is_alive() -> Column:
    """Producing hashes and powered; unknown readings count as not alive."""
    return F.coalesce((F.col("hashrate_th") > 1.0) & (F.col("voltage_v") > 0.05), F.lit(False))


def alive_rows(df: DataFrame) -> DataFrame:
    return df.where(is_alive())


def alive_report(df: DataFrame) -> DataFrame:
    """One row: total, dropped and dropped percentage of the alive filter."""
    dropped = F.count_if(~is_alive())
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        dropped.alias("n_dropped"),
        (100.0 * dropped / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("dropped_pct"),
    )


def alive_dead_split(df: DataFrame) -> DataFrame:
    """Failure rows flagged alive / dead."""
    return df.where(F.col("failure_type") != "none").withColumn("alive", is_alive())


def scope_failure_types(df: DataFrame, types) -> DataFrame:
    """Healthy rows plus the listed failure types."""
    return df.where(F.col("failure_type").isin("none", *types))


def subsample_miners(train: DataFrame, test: DataFrame, n: int) -> DataFrame:
    """Deterministic pick of ``n`` devices.

    First two devices that fail in the test span (of different hardware models
    if there are such), then one device of each model not yet present, then by
    id.  Works on one row per device; rankings use top-k sorts and small windows.
    """
    firsts = [c for c in ("timestamp", TIE_BREAK) if c in train.columns]
    fleet = train.groupBy("miner_id").agg(F.min_by("model", F.struct(*firsts)).alias("model"))
    failing = (
        test.where(F.col("failure_type") != "none").select("miner_id").distinct()
        .join(fleet, "miner_id")
    )
    per_model = Window.partitionBy("model").orderBy("miner_id")
    diverse = (
        failing.withColumn("r", F.row_number().over(per_model)).where("r = 1").drop("r")
        .orderBy("miner_id").limit(2).withColumn("tier", F.lit(0))
    )
    others = (
        failing.join(diverse, "miner_id", "left_anti")
        .orderBy("miner_id").limit(2).withColumn("tier", F.lit(1))
    )
    leading = diverse.unionByName(others).orderBy("tier", "miner_id").limit(min(2, n))
    unseen = (
        fleet.join(leading.select("model").distinct(), "model", "left_anti")
        .withColumn("r", F.row_number().over(per_model)).where("r = 1")
        .select("miner_id", "model", F.lit(2).alias("tier"))
    )
    picked = leading.unionByName(unseen)
    rest = fleet.join(picked, "miner_id", "left_anti").withColumn("tier", F.lit(3))
    # Unseen models go in model order, the rest in id order.
    rank_in_tier = F.when(F.col("tier") == 2, F.col("model")).otherwise(F.col("miner_id"))
    return (
        picked.unionByName(rest)
        .orderBy("tier", rank_in_tier, "miner_id").limit(n)
        .select("miner_id", "model", F.when(F.col("tier") <= 1, "failing")
                .when(F.col("tier") == 2, "model").otherwise("fill").alias("picked_as"))
    )


def sample_rows(df: DataFrame, fraction: float, keys: tuple, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, picked by a seeded hash of their key: the same on every run, without a shuffle."""
    h = F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(seed), *keys).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(h < int(fraction * 2**32))


def every_nth(df: DataFrame, n: int = 60, series: Series | None = None) -> DataFrame:
    """Rows 0, n, 2n, ... of each device."""
    return with_row_index(df, series).where(F.col(INDEX) % n == 0).drop(INDEX)


def last_n_per_miner(df: DataFrame, n: int = 120, series: Series | None = None) -> DataFrame:
    """Newest ``n`` rows of each device.

    Spark keeps at most ``n`` rows per device and map task before the shuffle
    (window group limit), so long histories are not moved.
    """
    series = series or Series.of(df)
    w = Window.partitionBy(*series.keys).orderBy(*[F.desc(c) for c in series.order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def latest(df: DataFrame, miner_id: str | None = None, series: Series | None = None) -> DataFrame:
    """Newest row of one device, or of every device."""
    series = series or Series.of(df)
    if miner_id is not None:
        return df.where(F.col("miner_id") == miner_id).orderBy(*[F.desc(c) for c in series.order]).limit(1)
    newest = F.max_by(F.struct(*df.columns), F.struct(*series.order)).alias("r")
    return df.groupBy(*series.keys).agg(newest).select("r.*")


def longest_failure_miner(df: DataFrame) -> DataFrame:
    return (
        df.where("is_pre_failure").groupBy("miner_id")
        .agg(F.count(F.lit(1)).alias("n_pre_failure_rows"))
        .orderBy(F.desc("n_pre_failure_rows"), "miner_id").limit(1)
    )


def top_features_per_miner(
    df: DataFrame, features: list[str], n: int = 5, series: Series | None = None
) -> DataFrame:
    """The ``n`` largest features by absolute value of each device's newest row."""
    newest = latest(df, series=series)
    long = newest.unpivot(["miner_id"], features, "feature", "value")
    w = Window.partitionBy("miner_id").orderBy(F.desc(F.abs("value")), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sorted_rows(df: DataFrame, *order, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)

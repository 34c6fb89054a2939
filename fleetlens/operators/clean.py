"""Cleaning of raw telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.kpi import clamp
from fleetlens.functions.ratios import per
from fleetlens.operators.halo import own_rows, with_halo
from fleetlens.operators.ordering import Chunks, Series
from fleetlens.schema import BOUNDS, SENSORS

ZSCORE_COLUMNS = ("temperature_c", "hashrate_th", "power_w", "efficiency_jth")


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN readings become null: Spark's aggregates skip null but not NaN."""
    real = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name)
        for f in df.schema.fields
    ])


def forward_fill(
    df: DataFrame,
    limit: int = 5,
    columns: list | None = None,
    required: tuple = ("hashrate_th", "temperature_c", "power_w"),
    series: Series | None = None,
) -> DataFrame:
    """Fill each sensor from at most ``limit`` rows back, then drop rows still incomplete.

    Slots bring the last ``limit`` rows of their predecessors, so nothing is numbered.
    """
    columns = [c for c in (columns or SENSORS) if c in df.columns]
    rows, slot = with_halo(df, limit, columns, series or Series.of(df))
    frame = slot.rowsBetween(-limit, Window.currentRow)
    filled = {c: F.last(c, ignorenulls=True).over(frame) for c in columns}
    out = rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in rows.columns])
    return own_rows(out).dropna(subset=list(required))


def clamp_bounds(df: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """Clip sensors to what is physically possible."""
    return df.withColumns({
        c: clamp(F.col(c), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns
    })


def count_violations(df: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """One row: how many readings of each sensor lie outside their bounds."""
    return df.agg(*[
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}_out_of_bounds")
        for c, (lo, hi) in bounds.items() if c in df.columns
    ])


def derived_columns(df: DataFrame) -> DataFrame:
    made = {"efficiency_jth": per(F.col("power_w"), F.col("hashrate_th"))}
    if "ambient_temperature_c" in df.columns:
        made["temp_delta_c"] = F.col("temperature_c") - F.col("ambient_temperature_c")
    made["hashrate_realization"] = F.lit(None).cast("double")
    return df.withColumns(made)


def zscore_per_miner(df: DataFrame, columns: tuple = ZSCORE_COLUMNS) -> DataFrame:
    """(x - mean) / std of the device's whole history; a zero std counts as 1.

    The statistics are aggregated first (map-side combined) and joined back, so
    a very long device never becomes one task; the join is left to AQE, which
    broadcasts the statistics only when their measured size allows it and
    splits skewed partitions otherwise.
    """
    columns = [c for c in columns if c in df.columns]
    stats = df.groupBy(F.col("miner_id").alias("__miner")).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns],
    )
    joined = df.join(stats, df["miner_id"] == stats["__miner"], "left")
    return joined.select(*df.columns, *[
        standardized(c, F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns
    ])


def zscore_causal(
    df: DataFrame, window: int, columns: tuple = ZSCORE_COLUMNS, series: Series | None = None
) -> DataFrame:
    """The same score against the trailing ``window`` rows only (no look-ahead)."""
    columns = [c for c in columns if c in df.columns]
    chunks = Chunks(df, before=window - 1, series=series)
    frame = chunks.rows(window)
    chunks.add(**{f"__m_{c}": F.avg(c).over(frame) for c in columns})
    chunks.add(**{f"__s_{c}": F.stddev_samp(c).over(frame) for c in columns})
    return chunks.finish().select(*df.columns, *[
        standardized(c, F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns
    ])


def standardized(c, mean, std):
    return ((F.col(c) - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)).alias(f"{c}_zscore")


def preprocess(df: DataFrame, max_gap_rows: int = 5, series: Series | None = None) -> DataFrame:
    """Fill, clamp, derive, normalize."""
    return (
        forward_fill(df, max_gap_rows, series=series)
        .transform(clamp_bounds)
        .transform(derived_columns)
        .transform(zscore_per_miner)
    )


def final_fill(df: DataFrame) -> DataFrame:
    """Numeric nulls, NaN and infinities become 0."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(bad, F.lit(0.0)).otherwise(c)
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)

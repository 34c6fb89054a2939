"""Telemetry clustered by device and time slot, with halos: windows of a few rows read it without an exchange."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from fleetlens.operators import halo
from fleetlens.operators.ordering import SLOT, Series
from fleetlens.session import scratch_path, stored
from fleetlens.sources.tables import table_path

#: A bucket is written and read by one task.
ROWS_A_BUCKET = 250_000

#: Whether a row stands for itself or was copied from the slot before.
OWN = "own_row"


def write_clustered(df: DataFrame, table: str, rows: int, columns: list[str], buckets: int = 64, path: str | None = None) -> None:
    """Writes ``df`` (with its time slot) bucketed by device and slot, sorted by time.

    Each slot also holds the last ``rows`` rows before it (``columns`` only), so that
    windows of up to ``rows + 1`` rows over (device, slot) are whole. Slots are
    bounded, so a device with most of the rows lies in many buckets. ``buckets`` is the
    least number of them; a longer table has one for each ``ROWS_A_BUCKET`` rows.
    """
    spark = df.sparkSession
    df = stored(df, scratch_path(spark, "to_cluster"))  # counted here, and read twice below
    buckets = max(buckets, math.ceil(df.count() / ROWS_A_BUCKET))
    series = Series.of(df)
    both, _ = halo.with_halo(df, rows, columns, series)
    # A copied row carries the struct of its new slot only.
    flat = both.withColumn(SLOT, F.col(f"{halo.SLOT}.s0")).withColumnRenamed(halo.OWN, OWN).drop(halo.SLOT)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    writer = flat.repartition(buckets, "miner_id", SLOT).write.mode("overwrite").format("parquet").option("path", path or table_path(spark, table))
    writer.bucketBy(buckets, "miner_id", SLOT).sortBy("miner_id", SLOT, *series.order).saveAsTable(table)


def read_clustered(spark: SparkSession, table: str) -> tuple[DataFrame, WindowSpec]:
    """The rows, copies included, and the window over a device's slot; keep rows with ``own_row`` at the end."""
    df = spark.table(table)
    order = [c for c in ("timestamp", "event_id") if c in df.columns]
    return df, Window.partitionBy("miner_id", SLOT).orderBy(*order)


def clustered_rates(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """Change of each column since the row before (0 where there is none), read without an exchange."""
    df, slot = read_clustered(spark, table)
    rates = df.withColumns({f"{c}_rate": F.coalesce(F.col(c) - F.lag(c).over(slot), F.lit(0.0)) for c in columns})
    return rates.where(OWN).drop(OWN, SLOT)

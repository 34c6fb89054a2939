"""Telemetry streams: reading, de-duplication, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.summary import fleet_kpis
from fleetlens.schema import TELEMETRY_SCHEMA
from fleetlens.session import scratch_path

FLUSH_EVERY = "50 minutes"


def read_stream(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA,
                files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream.

    ``files_per_batch`` bounds a micro-batch, and with it what one device can
    bring into one stateful task.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Drop repeated readings that arrive within the delay."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(keys)


def append_sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = FLUSH_EVERY):
    """Buffered append: one flush per trigger; ``every=None`` drains what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def flush_batches(stream: DataFrame, path: str, every: str | None = None) -> None:
    """Buffered append by batch id: a flush writes its own folder, so a retried batch replaces what it wrote before."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", f"{path}/checkpoint")
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()


def flushed(spark: SparkSession, path: str) -> DataFrame:
    """All flushed rows with the batch that brought them."""
    return spark.read.parquet(f"{path}/rows")


def drain(stream: DataFrame, name: str) -> str:
    """Run a stream over everything available into a fresh folder; returns its path."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    append_sink(stream, f"{path}/rows", f"{path}/checkpoint", every=None).awaitTermination()
    return f"{path}/rows"


def live_fleet_kpis(stream: DataFrame, every: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Fleet totals per tick with late rows accepted within the delay."""
    return fleet_kpis(stream.withWatermark("timestamp", delay), every)


def drain_updates(aggregated: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregation over everything available in update mode; the newest version of each group.

    A batch writes the groups it changed to its own folder, so a retried batch
    replaces what it wrote, and the watermark removes finished groups from the state.
    """
    spark = aggregated.sparkSession
    path = scratch_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    (aggregated.writeStream.outputMode("update").foreachBatch(keep)
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(f"{path}/rows")
    values = [c for c in aggregated.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")

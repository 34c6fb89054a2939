"""Sessions of device activity on a stream, with late rows set aside and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.session import scratch_path, stored
from fleetlens.sources.tables import path_exists, remove_path

MICROS = 1_000_000


def sessions(rows: DataFrame, gap_s: int, key: str = "miner_id", time: str = "timestamp", value: str = "power_w") -> DataFrame:
    """(key, start_ts, end_ts, n_rows, total) of runs of readings that lie at most ``gap_s`` apart.

    Readings of one second and device are summed first; a session is then a run of
    these sums. Rows without a time belong to no session.
    """
    at = F.col(time).cast("timestamp")
    seconds = rows.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("key"), F.date_trunc("second", at).alias("second")).agg(
        F.min(at).alias("start_ts"), F.max(at).alias("end_ts"), F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total"))
    return joined_sessions(seconds.drop("second"), gap_s).withColumnRenamed("key", key)


def joined_sessions(parts: DataFrame, gap_s: int) -> DataFrame:
    """Parts of sessions (key, start_ts, end_ts, n_rows, total) put together where they lie at most ``gap_s`` apart."""
    along = Window.partitionBy("key").orderBy("start_ts", "end_ts")
    reach = F.max("end_ts").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.unix_micros("start_ts") - F.unix_micros(reach) > gap_s * MICROS, F.lit(True)).cast("int")
    numbered = parts.withColumn("__o", opens).withColumn("__no", F.sum("__o").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("key", "__no").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total")).drop("__no")


def live_sessions(stream: DataFrame, root: str | None = None, gap_s: int = 21_600, delay_s: int = 86_400, key: str = "miner_id",
                  time: str = "timestamp", value: str = "power_w") -> str:
    """Sessions of everything available, in micro-batches; returns the folder of the results.

    The watermark is the newest time of all batches before, less ``delay_s``. A row
    older than it is late: it is written to ``late`` with its batch and changes
    nothing. A session whose gap ends before the watermark is closed: it is appended
    to ``closed`` and leaves the state, which holds open sessions only, however long
    the stream runs. A retried batch starts from the state of the one before and
    overwrites what it wrote.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, "sessions")
    at = lambda kind, batch_id: f"{root}/{kind}/batch={batch_id}"
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def take(batch: DataFrame, batch_id: int) -> None:
        before = at("open", batch_id - 1) if path_exists(spark, at("open", batch_id - 1)) else None
        mark = spark.read.parquet(at("mark", batch_id - 1)).first()["newest"] if before else None
        limit = None if mark is None else mark - delay_s * MICROS
        late = F.lit(False) if limit is None else F.coalesce(micros(time) < F.lit(limit), F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(at("late", batch_id))
        fresh = batch.where(~late)
        new = sessions(fresh, gap_s, key, time, value).withColumnRenamed(key, "key")
        parts = new if before is None else new.unionByName(spark.read.parquet(before))
        now = stored(joined_sessions(parts, gap_s), at("joined", batch_id))
        newest = fresh.agg(F.max(micros(time))).first()[0]
        newest = max((m for m in (mark, newest) if m is not None), default=None)
        spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(at("mark", batch_id))
        ended = F.lit(False) if newest is None else micros("end_ts") + F.lit(gap_s * MICROS) < F.lit(newest - delay_s * MICROS)
        now.where(ended).write.mode("overwrite").parquet(at("closed", batch_id))
        now.where(~ended).write.mode("overwrite").parquet(at("open", batch_id))
        for kind in ("joined", "open", "mark"):
            remove_path(spark, at(kind, batch_id - (0 if kind == "joined" else 2)))

    (stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return root


def known_sessions(spark: SparkSession, root: str, key: str = "miner_id") -> DataFrame:
    """All sessions so far: closed ones, and those of the newest state, which may still grow (``is_open``)."""
    closed = spark.read.parquet(f"{root}/closed").drop("batch").withColumn("is_open", F.lit(False))
    state = spark.read.parquet(f"{root}/open")
    last = state.agg(F.max("batch")).first()[0]
    still = state.where(_is(F.col("batch"), last)).drop("batch").withColumn("is_open", F.lit(True))
    return closed.unionByName(still).withColumnRenamed("key", key)


def _is(column: Column, value) -> Column:
    return F.lit(False) if value is None else column == value

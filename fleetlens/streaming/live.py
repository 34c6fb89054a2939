"""Live features: each micro-batch updates a bounded state and featurizes the newest rows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.clean import ZSCORE_COLUMNS, clamp_bounds, derived_columns, forward_fill, standardized
from fleetlens.operators.kpi import with_true_efficiency
from fleetlens.operators.live import MIN_HISTORY, newest_features, reach_of
from fleetlens.operators.ordering import Series, with_time_slot
from fleetlens.schema import FeatureConfig
from fleetlens.session import scratch_path
from fleetlens.sources.tables import path_exists, remove_path

#: Raw rows back from which a missing reading may be filled.
FILL_ROWS = 5
OLD = "__old"


@dataclass(frozen=True)
class LiveState:
    """What is kept of each device, whatever the age of its table.

    ``tail``: its newest ``FILL_ROWS`` raw readings, from which a gap may be filled;
    ``recent``: its newest cleaned rows, as many as the longest window has;
    ``totals``: count, mean and second moment of each standardized column over all
    its cleaned rows, mergeable. A state is a set of tables of one micro-batch.
    """

    tail: DataFrame | None
    recent: DataFrame | None
    totals: DataFrame | None

    @classmethod
    def read(cls, spark: SparkSession, path: str | None) -> "LiveState":
        if path is None:
            return cls(None, None, None)
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("tail", "recent", "totals")))


def _order(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in Series.of(df).order])


def _newest(df: DataFrame, rows: int) -> DataFrame:
    """The newest rows of each device. State and batch are bounded, so a device's share of them is too."""
    order = Window.partitionBy("miner_id").orderBy(_order(df).desc())
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= rows).drop("__r")


def _with(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new)


def split_late(batch: DataFrame, tail: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(in order, late): a reading that is not newer than its device's newest one of an earlier batch is late."""
    if tail is None:
        return batch, batch.where(F.lit(False))
    last = tail.groupBy(F.col("miner_id").alias("__m")).agg(F.max(_order(tail)).alias("__last"))
    joined = batch.join(last, F.col("miner_id").eqNullSafe(F.col("__m")), "left").withColumn("__late", F.coalesce(_order(batch) <= F.col("__last"), F.lit(False)))
    keep = joined.drop("__m", "__last")
    return keep.where("not __late").drop("__late"), keep.where("__late").drop("__late")


def clean_batch(batch: DataFrame, tail: DataFrame | None) -> DataFrame:
    """Cleaned rows of a micro-batch with the KPI, gaps filled from the rows before it; without standard scores."""
    rows = _with(tail and tail.withColumn(OLD, F.lit(True)), batch.withColumn(OLD, F.lit(False)))
    filled = forward_fill(with_time_slot(rows), FILL_ROWS).where(~F.col(OLD)).drop(OLD, "time_slot")
    return with_true_efficiency(filled.transform(clamp_bounds).transform(derived_columns))


def totals_of(rows: DataFrame) -> DataFrame:
    columns = [c for c in ZSCORE_COLUMNS if c in rows.columns]
    return rows.groupBy("miner_id").agg(*[
        F.struct(F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("s")).alias(c)
        for c in columns])


def merged_totals(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Totals of disjoint row sets together (pairwise update of mean and second moment)."""
    if old is None:
        return new
    a, b = old.alias("a"), new.alias("b")
    columns = [c for c in new.columns if c != "miner_id"]

    def both(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        n = x["n"] + y["n"]
        gap = y["m"] - x["m"]
        sum_ = F.struct(n.alias("n"), (x["m"] + gap * y["n"] / F.greatest(n, F.lit(1))).alias("m"),
                        (x["s"] + y["s"] + gap * gap * x["n"] * y["n"] / F.greatest(n, F.lit(1))).alias("s"))
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(sum_).alias(c)

    joined = a.join(b, F.col("a.miner_id").eqNullSafe(F.col("b.miner_id")), "full")
    return joined.select(F.coalesce("a.miner_id", "b.miner_id").alias("miner_id"), *[both(c) for c in columns])


def with_scores(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Standard scores against all rows a device ever had."""
    columns = [c for c in totals.columns if c != "miner_id"]
    t = totals.select(F.col("miner_id").alias("__m"), *[F.col(c).alias(f"__t_{c}") for c in columns])
    joined = rows.join(t, F.col("miner_id").eqNullSafe(F.col("__m")), "left")

    def spread(c: str) -> Column:
        n, s = F.col(f"__t_{c}.n"), F.col(f"__t_{c}.s")
        return F.when(n > 1, F.sqrt(s / F.greatest(n - 1, F.lit(1))))

    return joined.select(*rows.columns, *[standardized(c, F.col(f"__t_{c}.m"), spread(c)) for c in columns])


def live_features(
    stream: DataFrame, name: str, cfg: FeatureConfig = FeatureConfig(), min_history: int = MIN_HISTORY,
    peer_group: tuple = ("container_id", "timestamp"), prepare=lambda df: df, root: str | None = None,
) -> str:
    """Run over everything available; returns the folder with one feature row per device and batch.

    A micro-batch is cleaned on from the state of the batch before, which it
    replaces: so much work as there are devices and rows of the longest window, and
    none that grows with the table. A retried batch starts from the same state and
    overwrites what it wrote. Rows that come after a newer one of their device was
    taken in are written to ``late`` and change nothing. With ``root`` a later run
    goes on where the one before stopped.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    at = lambda kind, batch_id: f"{root}/{kind}/batch={batch_id}"

    def featurize(batch: DataFrame, batch_id: int) -> None:
        before = at("state", batch_id - 1)
        state = LiveState.read(spark, before if path_exists(spark, before) else None)
        # Read by several branches below.
        batch.write.mode("overwrite").parquet(at("input", batch_id))
        fresh, late = split_late(spark.read.schema(batch.schema).parquet(at("input", batch_id)), state.tail)
        late.write.mode("overwrite").parquet(at("late", batch_id))
        _newest(_with(state.tail, fresh), FILL_ROWS).write.mode("overwrite").parquet(f"{at('state', batch_id)}/tail")
        clean_batch(fresh, state.tail).transform(prepare).write.mode("overwrite").parquet(at("cleaned", batch_id))
        cleaned = spark.read.parquet(at("cleaned", batch_id))
        _newest(_with(state.recent, cleaned), reach_of(cfg)).write.mode("overwrite").parquet(f"{at('state', batch_id)}/recent")
        merged_totals(state.totals, totals_of(cleaned)).write.mode("overwrite").parquet(f"{at('state', batch_id)}/totals")

        now = LiveState.read(spark, at("state", batch_id))
        devices = cleaned.select(F.col("miner_id").alias("__m")).distinct()
        mine = F.col("miner_id").eqNullSafe(F.col("__m"))
        history = now.recent if cfg.peers else now.recent.join(devices, mine, "left_semi")
        rows = newest_features(with_scores(history, now.totals), cfg, min_history, peer_group)
        rows.join(devices, mine, "left_semi").write.mode("overwrite").parquet(at("features", batch_id))
        for kind in ("input", "cleaned"):
            remove_path(spark, at(kind, batch_id))
        remove_path(spark, at("state", batch_id - 2))  # the one before stays for a retry

    (stream.writeStream.foreachBatch(featurize).option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return f"{root}/features"


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that came too late, with the batch that brought them."""
    return spark.read.parquet(f"{root}/late")

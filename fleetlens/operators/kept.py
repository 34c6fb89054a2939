"""Summaries that are kept and only brought up to date: mergeable states per device and day.

Each day of a table has a stamp of its content. A refresh compares stamps, makes
the states of the changed days again and leaves the others as they are; a summary
is the merge of all states, so it equals a full recomputation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.clean import clamp_bounds, derived_columns
from fleetlens.operators.halo import OWN, SLOT, with_halo
from fleetlens.operators.kpi import with_true_efficiency
from fleetlens.operators.ordering import Series
from fleetlens.schema import SENSORS
from fleetlens.session import stored
from fleetlens.sources.tables import path_exists, remove_path

DAY = "day"


@dataclass(frozen=True)
class Kept:
    """Where states and stamps lie, and how many days the last refresh made again."""

    states: DataFrame
    changed: int


def day_stamps(df: DataFrame) -> DataFrame:
    """(day, n, h): the rows of each day by number and sum of hashes, whatever their order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != DAY]).cast("decimal(38,0)")
    return df.groupBy(DAY).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("h"))


def refresh(df: DataFrame, root: str, states_of: Callable[[DataFrame], DataFrame]) -> Kept:
    """Brings the states under ``root`` up to date with ``df``, which has a ``day`` column.

    ``states_of`` makes the states of whole days (with their ``day``). Days that came,
    went or changed in any row are made again; where a day's result depends on rows
    of other days, they must be among its rows (``with_halo``), so that its stamp
    covers them. A refresh writes a new version and then names it as current, so one
    that fails leaves the old one in place.
    """
    spark = df.sparkSession
    version = _current(spark, root)
    new = stored(day_stamps(df), f"{root}/stamps/v={version + 1}")
    old = spark.read.parquet(f"{root}/stamps/v={version}") if version else new.limit(0)
    n = new.alias("n").join(old.alias("o"), F.col(f"n.{DAY}").eqNullSafe(F.col(f"o.{DAY}")), "left")
    changed = n.where(F.col("o.n").isNull() | (F.col("n.n") != F.col("o.n")) | ~F.col("n.h").eqNullSafe(F.col("o.h"))).select(F.col(f"n.{DAY}").alias("__day"))
    changed = stored(changed, f"{root}/changed/v={version + 1}")
    same_day = F.col(DAY).eqNullSafe(F.col("__day"))
    made = states_of(df.join(changed, same_day, "left_semi"))
    if version:
        here = new.select(F.col(DAY).alias("__here"))
        left = spark.read.parquet(f"{root}/states/v={version}").join(changed, same_day, "left_anti").join(here, F.col(DAY).eqNullSafe(F.col("__here")), "left_semi")
        made = left.unionByName(made)
    states = stored(made, f"{root}/states/v={version + 1}")
    spark.range(1).select(F.lit(version + 1).alias("v")).coalesce(1).write.mode("overwrite").parquet(f"{root}/current/v={version + 1}")
    for kind in ("stamps", "changed", "states", "current"):
        if version > 1:
            remove_path(spark, f"{root}/{kind}/v={version - 1}")
    return Kept(states, changed.count())


def _current(spark: SparkSession, root: str) -> int:
    """The newest version whose refresh ended; 0 where there is none."""
    if not path_exists(spark, f"{root}/current"):
        return 0
    return spark.read.parquet(f"{root}/current").agg(F.max("v")).first()[0] or 0


# -- states of the device summary ---------------------------------------------------

FILL_ROWS = 5
MEANS = ("te_base", "te_adjusted", "te_health", "efficiency_jth", "temperature_c", "hashrate_realization")


def summary_states(df: DataFrame) -> DataFrame:
    """Per device and day: what ``te_summary`` needs, in a form that can be merged."""
    order = F.struct(*[c for c in ("timestamp", "event_id") if c in df.columns])
    named = F.col("failure_type") != "none"
    moments = [F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), (F.var_pop(c) * F.count(c)).alias("s")).alias(f"s_{c}") for c in MEANS]
    return df.groupBy("miner_id", DAY).agg(
        *moments, F.min("te_health").alias("te_health_min"), F.max("temperature_c").alias("max_temp"),
        F.min(F.struct(order.alias("at"), "model")).alias("first_model"),
        F.max(F.when(named, F.struct(order.alias("at"), "failure_type"))).alias("last_failure"))


def daily_rows(raw: DataFrame) -> DataFrame:
    """Raw telemetry by day, each device's day with the last readings before it, from which its gaps may be filled."""
    order = tuple(c for c in ("timestamp", "event_id") if c in raw.columns)
    both, _ = with_halo(raw, FILL_ROWS, [c for c in SENSORS if c in raw.columns], Series(order=order, slots=("cast(timestamp as date)",)))
    return both.withColumn(DAY, F.col(f"{SLOT}.s0")).drop(SLOT)


def kpi_states(rows: DataFrame) -> DataFrame:
    """States of days of ``daily_rows``: filled, cleaned, with the KPI."""
    order = [c for c in ("timestamp", "event_id") if c in rows.columns]
    back = Window.partitionBy("miner_id", DAY).orderBy(*order).rowsBetween(-FILL_ROWS, Window.currentRow)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in SENSORS if c in rows.columns}).where(OWN).drop(OWN)
    clean = filled.dropna(subset=["hashrate_th", "temperature_c", "power_w"]).transform(clamp_bounds).transform(derived_columns)
    return summary_states(with_true_efficiency(clean))


def refresh_summary(raw: DataFrame, root: str) -> tuple[DataFrame, int]:
    """(the device summary of ``raw``, days made again); equal to ``te_summary`` of the cleaned table with the KPI."""
    kept = refresh(daily_rows(raw), root, kpi_states)
    return merged_summary(kept.states), kept.changed


def _merged(states: Column) -> Column:
    """Count, mean and second moment of disjoint row sets together."""
    def step(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["m"] - a["m"]
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(F.struct(
            n.alias("n"), (a["m"] + gap * b["n"] / n).alias("m"), (a["s"] + b["s"] + gap * gap * a["n"] * b["n"] / n).alias("s")))

    return F.aggregate(states, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), step)


def merged_summary(states: DataFrame) -> DataFrame:
    """``te_summary`` from the states of any days; a device has one short row a day."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(DAY, c))), lambda x: x[c])
    one = states.groupBy("miner_id").agg(
        *[_merged(ordered(f"s_{c}")).alias(f"s_{c}") for c in MEANS], F.min("te_health_min").alias("te_health_min"), F.max("max_temp").alias("max_temp"),
        F.min("first_model").alias("first_model"), F.max("last_failure").alias("last_failure"))
    mean = lambda c: F.when(F.col(f"s_{c}.n") > 0, F.col(f"s_{c}.m"))
    te = F.col("s_te_health")
    return one.select(
        "miner_id", F.col("first_model.model").alias("model"), mean("te_base").alias("te_base_mean"), mean("te_adjusted").alias("te_adjusted_mean"),
        mean("te_health").alias("te_health_mean"), F.when(te["n"] > 1, F.sqrt(te["s"] / F.greatest(te["n"] - 1, F.lit(1)))).alias("te_health_std"),
        "te_health_min", mean("efficiency_jth").alias("jth_mean"), mean("temperature_c").alias("avg_temp"), "max_temp",
        mean("hashrate_realization").alias("hashrate_realization_mean"),
        F.coalesce("last_failure.failure_type", F.lit("none")).alias("failure_type"), te["n"].alias("n_readings"))

"""Sustained risk levels per device.

A score at or above the floor adds one to the device's sustained count; the
count survives dips and is cleared by ``clear_rows`` consecutive rows below the
floor.  So the count is the number of above-rows since the last clearing row,
and a row clears exactly when it ends ``clear_rows`` rows that are all below.
That turns the state machine into a short window (the clearing rows) and two
prefix aggregates, which are carried across chunks through chunk summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.ordering import INDEX, Chunks, Series
from fleetlens.schema import RiskConfig

LEVELS = ("LOW", "ELEVATED", "HIGH", "CRITICAL")


def level_name(rank):
    return F.element_at(F.array(*[F.lit(n) for n in LEVELS]), (rank + 1).cast("int"))


def ml_rank(sustained, cfg: RiskConfig):
    return (
        F.when(sustained >= cfg.critical_rows, 3).when(sustained >= cfg.high_rows, 2)
        .when(sustained >= cfg.elevated_rows, 1).otherwise(0)
    )


def health_rank(health, cfg: RiskConfig):
    return (
        F.when(health < cfg.health_critical, 3).when(health < cfg.health_high, 2)
        .when(health < cfg.health_elevated, 1).otherwise(0)
    )


def with_levels(df: DataFrame, sustained: str, health: str | None, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Levels, prediction and source from the sustained count and the health score."""
    ml = ml_rank(F.col(sustained), cfg)
    direct = health_rank(F.col(health), cfg) if health else F.lit(0)
    return (
        df.withColumn("__ml", ml).withColumn("__direct", direct)
        .withColumn("ml_risk", level_name(F.col("__ml")))
        .withColumn("health_risk", level_name(F.col("__direct")))
        .withColumn("risk_level", level_name(F.greatest("__ml", "__direct")))
        .withColumn("predicted_failure", F.greatest("__ml", "__direct") >= 2)
        .withColumn(
            "risk_source",
            F.when(F.col("__direct") > F.col("__ml"), "health")
            .when(F.col("__ml") > F.col("__direct"), "ai_model").otherwise("both"),
        )
        .drop("__ml", "__direct")
    )


def sustained_rows(
    df: DataFrame, score: str, cfg: RiskConfig = RiskConfig(), series: Series | None = None,
    chunk_rows: int | None = None, keep_index: bool = False,
) -> DataFrame:
    chunks = Chunks(df, before=cfg.clear_rows - 1, series=series, chunk_rows=chunk_rows)
    recent = chunks.rows(cfg.clear_rows)
    chunks.add(__above=F.coalesce(F.col(score) >= cfg.score_floor, F.lit(False)).cast("long"))
    chunks.add(
        __clears=(F.sum("__above").over(recent) == 0) & (F.count(F.lit(1)).over(recent) == cfg.clear_rows)
    )
    keys, parts = list(chunks.series.keys), chunks.parts
    run = Window.partitionBy(*parts).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chunks.owned().withColumn("__upto", F.sum("__above").over(run))
    cleared_at = F.when(F.col("__clears"), F.col("__upto"))
    per_chunk = rows.groupBy(*parts).agg(
        F.max("__upto").alias("__total"), F.max(cleared_at).alias("__last_clear")
    )
    before = Window.partitionBy(*keys).orderBy(Chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_chunk
        .withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0)))
        .withColumn("__carried", F.max(F.col("__offset") + F.col("__last_clear")).over(before))
        .select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(parts)], "__offset", "__carried")
    )
    on = None
    for i, c in enumerate(parts):
        same = rows[c] == carry[f"__k{i}"]
        on = same if on is None else on & same
    level = F.greatest(
        F.coalesce(F.col("__carried"), F.lit(0)),
        F.coalesce(F.col("__offset") + F.col("__cleared"), F.lit(0)),
    )
    out = (
        rows.withColumn("__cleared", F.max(cleared_at).over(run))
        .join(carry, on, "left")
        .withColumn("sustained", F.coalesce(F.col("__offset"), F.lit(0)) + F.col("__upto") - level)
    )
    helpers = [c for c in out.columns if c.startswith("__")]
    out = out.drop(*helpers)
    return out if keep_index or chunks.kept_index else out.drop(INDEX)


def risk_levels(
    df: DataFrame, score: str = "ai_score", health: str | None = "health_score",
    cfg: RiskConfig = RiskConfig(), series: Series | None = None,
    chunk_rows: int | None = None, keep_index: bool = False,
) -> DataFrame:
    out = sustained_rows(df, score, cfg, series, chunk_rows, keep_index)
    return with_levels(out, "sustained", health, cfg)

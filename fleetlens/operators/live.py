"""Features of each device's newest reading, from its recent history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.ratios import signal_ratios
from fleetlens.operators import features as Ft
from fleetlens.operators.clean import final_fill
from fleetlens.operators.ordering import SLOT, Series
from fleetlens.operators.peers import peer_features
from fleetlens.operators.rolling import Roll, newest_rolls
from fleetlens.schema import FeatureConfig

MIN_HISTORY = 360


def reach_of(cfg: FeatureConfig) -> int:
    """Rows of a device that its newest features depend on."""
    return max(cfg.longest, cfg.acf_window + 1, 2 * cfg.peak_window)


def newest_slots(df: DataFrame, rows: int, series: Series) -> DataFrame:
    """Without the slots that have ``rows`` newer rows of their device behind them; only slots are ordered, so a long history never is one task."""
    if SLOT not in df.columns:
        return df  # bounded already, as live state is
    keys = list(series.keys)
    newer = Window.partitionBy(*keys).orderBy(F.desc(SLOT)).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("__c")).withColumn("__newer", F.coalesce(F.sum("__c").over(newer), F.lit(0)))
    wanted = counts.where(F.col("__newer") < rows).select(*[F.col(c).alias(f"__w_{c}") for c in (*keys, SLOT)])
    return df.join(wanted, [F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in (*keys, SLOT)], "left_semi")


def newest_features(
    history: DataFrame, cfg: FeatureConfig = FeatureConfig(), min_history: int = MIN_HISTORY,
    peer_group: tuple = ("container_id", "timestamp"), series: Series | None = None,
) -> DataFrame:
    """The feature matrix row of every device's newest reading.

    ``history`` is cleaned and carries the KPI columns.  Devices with fewer than
    ``min_history`` rows are still warming up and are left out.  The history need
    not hold more than ``reach_of(cfg)`` rows of a device (live state holds so
    many); of a whole table, slots that are too old go first, by their row counts.
    Every window then is a conditional aggregate over recency ranks.
    """
    series = series or Series.of(history)
    df = signal_ratios(history)
    newest_first = Window.partitionBy(*series.keys).orderBy(*[F.desc(c) for c in series.order])
    reach = reach_of(cfg)
    recent = newest_slots(df, reach, series).withColumn("__r", F.row_number().over(newest_first)).where(F.col("__r") <= reach)
    oldest_first = Window.partitionBy(*series.keys).orderBy(F.desc("__r"))

    acf = [c for c in Ft.ACF_COLUMNS if c in df.columns]
    rates = [c for c in cfg.rate_columns if c in df.columns]
    peaks = [c for c in Ft.PEAK_COLUMNS if c in df.columns]
    roll_cols = [c for c in Ft.ROLL_COLUMNS if c in df.columns]
    trend_cols = [c for c in Ft.TREND_COLUMNS if c in df.columns]
    var_cols = [c for c in Ft.VARIANCE_COLUMNS if c in df.columns]
    amp_cols = [c for c in Ft.AMPLITUDE_COLUMNS if c in df.columns]
    pairs = [(a, b) for a, b in Ft.CORR_PAIRS if a in df.columns and b in df.columns]
    recent = recent.select(
        "*", *[F.lag(c).over(oldest_first).alias(f"__prev_{c}") for c in dict.fromkeys([*acf, *rates])]
    )
    rolls = [
        *Ft.rolling_stat_rolls(roll_cols, cfg.windows, cfg.minmax_below),
        Ft.slope_roll(cfg.slope_window, cfg.slope_min_obs),
        *Ft.trend_rolls(trend_cols, cfg.trend_window, cfg.trend_min_obs),
        *Ft.variance_rolls(var_cols, cfg.variance_windows, cfg.variance_min_obs),
        *Ft.corr_rolls(pairs, cfg.corr_window, cfg.corr_min_obs),
        *Ft.acf_rolls(acf, cfg.acf_window, cfg.acf_min_obs),
        *Ft.amplitude_rolls(amp_cols, cfg.amplitude_window, cfg.amplitude_min_obs),
        Roll("count", "__one", reach, "__n"),
    ]
    keys = list(series.keys)
    windows = newest_rolls(recent.withColumn("__one", F.lit(1)), rolls, "__r", series.keys)
    # A peak compares each of the last rows with its own trailing window.
    tail = recent.where(F.col("__r") < 2 * cfg.peak_window).select(*keys, *series.order, "__r", *peaks)
    peak_series = Series(series.keys, series.order, ("0",))
    counted = Ft.peak_count(tail, peaks, cfg.peak_window, cfg.peak_sigma, cfg.peak_min_obs, peak_series)
    counted = counted.where("__r = 1").select(*keys, *[f"{c}_peaks_per_hour" for c in peaks])
    last = recent.where("__r = 1")
    if cfg.peers:
        # Only the groups that hold a newest reading are compared.
        groups = last.select(*peer_group).distinct()
        compared = peer_features(df.join(groups, list(peer_group), "left_semi"), peer_group)
        made = [c for c in compared.columns if c not in df.columns]
        last = last.join(compared.select(*keys, *series.order, *made), [*keys, *series.order])
    out = last.join(windows, keys).join(counted, keys)
    out = out.withColumns({
        **{f"{c}_rate": F.coalesce(F.col(c) - F.col(f"__prev_{c}"), F.lit(0.0)) for c in rates},
        **{
            f"{c}_std_trend": F.when(
                F.col(f"__std1_{c}") > 1e-6, F.col(f"__std0_{c}") / F.col(f"__std1_{c}")).otherwise(F.lit(1.0))
            for c in var_cols
        },
    }).where(F.col("__n") >= min_history)
    return final_fill(out.drop(*[c for c in out.columns if c.startswith("__")]))


def parity(batch: DataFrame, live: DataFrame, features: list[str], tolerance: float = 1e-3,
           key: str = "miner_id") -> DataFrame:
    """Per feature: devices on either side and devices whose values agree (absolutely or relatively); one that a side lacks does not."""
    a = batch.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "a")
    b = live.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "b")
    gap = F.abs(F.col("a") - F.col("b"))
    close = (gap <= tolerance) | (gap <= tolerance * F.abs(F.col("a")))
    return a.join(b, [key, "feature"], "full").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(close).alias("n_match"))

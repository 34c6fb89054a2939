"""Per-device window features and the feature matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ratios import signal_ratios
from fleetlens.operators.clean import final_fill
from fleetlens.operators.ordering import INDEX, Chunks, Series, with_row_index
from fleetlens.operators.peers import peer_features
from fleetlens.operators.rolling import Roll, add_rolls
from fleetlens.schema import NON_FEATURES, FeatureConfig

ROLL_COLUMNS = ("temperature_c", "hashrate_th", "power_w", "voltage_v", "jth", "te_health")
TREND_COLUMNS = ("temperature_c", "hashrate_th", "power_w", "jth", "voltage_v", "te_health")
VARIANCE_COLUMNS = ("hashrate_th", "voltage_v", "power_w")
CORR_PAIRS = (
    ("temperature_c", "power_w"),
    ("hashrate_th", "voltage_v"),
    ("jth", "temperature_c"),
    ("power_w", "clock_frequency_mhz"),
    ("te_health", "temperature_c"),
)
ACF_COLUMNS = ("hashrate_th", "temperature_c", "power_w")
PEAK_COLUMNS = ("power_w", "voltage_v")
AMPLITUDE_COLUMNS = ("jth", "temperature_c", "te_health")


def _present(df: DataFrame, columns) -> list:
    return [c for c in columns if c in df.columns]


# -- roll specifications -----------------------------------------------------

def rolling_stat_rolls(columns, windows, minmax_below: int = 1440) -> list[Roll]:
    rolls = []
    for c in columns:
        for w in windows:
            name, need = f"{c}_roll_{w}m", max(1, w // 4)
            rolls.append(Roll("mean", c, w, f"{name}_mean", need))
            rolls.append(Roll("std", c, w, f"{name}_std", need, fill=0.0))
            if w < minmax_below:
                rolls.append(Roll("min", c, w, f"{name}_min", need))
                rolls.append(Roll("max", c, w, f"{name}_max", need))
    return rolls


def slope_roll(window: int, min_obs: int) -> Roll:
    return Roll("slope", "jth", window, "jth_degradation_slope", max(11, min_obs), fill=0.0)


def trend_rolls(columns, window: int, min_obs: int) -> list[Roll]:
    return [Roll("slope", c, window, f"{c}_trend_7d", max(11, min_obs), fill=0.0) for c in columns]


def variance_rolls(columns, windows, min_obs) -> list[Roll]:
    return [
        Roll("std", c, w, f"__std{i}_{c}", need)
        for c in columns for i, (w, need) in enumerate(zip(windows, min_obs))
    ]


def corr_rolls(pairs, window: int, min_obs: int) -> list[Roll]:
    return [Roll("corr", a, window, f"corr_{a}_{b}_6h", min_obs, other=b, fill=0.0) for a, b in pairs]


def acf_rolls(columns, window: int, min_obs: int) -> list[Roll]:
    return [Roll("corr", c, window, f"{c}_acf1", min_obs, other=f"__prev_{c}", fill=0.0) for c in columns]


def peak_rolls(columns, window: int, min_obs: int) -> list[Roll]:
    return [
        Roll(kind, c, window, f"__{kind}_{c}", min_obs) for c in columns for kind in ("mean", "std")
    ]


def amplitude_rolls(columns, window: int, min_obs: int) -> list[Roll]:
    return [Roll("range", c, window, f"{c}_diurnal_amp", min_obs, fill=0.0) for c in columns]


# -- steps that follow the rolls --------------------------------------------

def _add_previous(chunks: Chunks, columns) -> None:
    chunks.add(**{f"__prev_{c}": F.lag(c).over(chunks.window) for c in columns})


def _add_rates(chunks: Chunks, columns) -> None:
    chunks.add(**{
        f"{c}_rate": F.coalesce(F.col(c) - F.lag(c).over(chunks.window), F.lit(0.0)) for c in columns
    })


def _add_variance_ratio(chunks: Chunks, columns) -> None:
    # An undefined long-term spread counts as "not growing"; an undefined
    # recent spread stays null.
    chunks.add(**{
        f"{c}_std_trend": F.when(F.col(f"__std1_{c}") > 1e-6, F.col(f"__std0_{c}") / F.col(f"__std1_{c}"))
        .otherwise(F.lit(1.0))
        for c in columns
    })


def _add_peaks(chunks: Chunks, columns, window: int, sigma: float) -> None:
    chunks.add(**{
        f"__peak_{c}": F.when(F.col(c) > F.col(f"__mean_{c}") + sigma * F.col(f"__std_{c}"), 1).otherwise(0)
        for c in columns
    })
    # Integer running sums are exact, so their difference is the windowed count.
    chunks.add(**{f"__upto_{c}": F.sum(f"__peak_{c}").over(chunks.running()) for c in columns})
    chunks.add(**{
        f"{c}_peaks_per_hour": (
            F.col(f"__upto_{c}") - F.coalesce(F.lag(f"__upto_{c}", window).over(chunks.window), F.lit(0))
        ).cast("double")
        for c in columns
    })


def _drop_helpers(chunks: Chunks) -> None:
    keep = (Chunks.CHUNK, Chunks.OWN)
    chunks.df = chunks.df.drop(*[c for c in chunks.df.columns if c.startswith("__") and c not in keep])


# -- single-feature operators ------------------------------------------------

def rolling_stats(df, columns, windows, minmax_below=1440, series=None, chunk_rows=None) -> DataFrame:
    columns = _present(df, columns)
    chunks = Chunks(df, before=max(windows) - 1, series=series, chunk_rows=chunk_rows)
    return add_rolls(chunks, rolling_stat_rolls(columns, windows, minmax_below)).finish()


def rate_of_change(df, columns, series=None, chunk_rows=None) -> DataFrame:
    chunks = Chunks(df, before=1, series=series, chunk_rows=chunk_rows)
    _add_rates(chunks, _present(df, columns))
    return chunks.finish()


def degradation_slope(df, window=360, min_obs=90, series=None, chunk_rows=None) -> DataFrame:
    chunks = Chunks(df, before=window - 1, series=series, chunk_rows=chunk_rows)
    return add_rolls(chunks, [slope_roll(window, min_obs)]).finish()


def trend_features(df, columns=TREND_COLUMNS, window=10080, min_obs=2520, series=None, chunk_rows=None):
    chunks = Chunks(df, before=window - 1, series=series, chunk_rows=chunk_rows)
    return add_rolls(chunks, trend_rolls(_present(df, columns), window, min_obs)).finish()


def variance_trend(df, columns=VARIANCE_COLUMNS, windows=(1440, 10080), min_obs=(60, 1440),
                   series=None, chunk_rows=None) -> DataFrame:
    columns = _present(df, columns)
    chunks = Chunks(df, before=max(windows) - 1, series=series, chunk_rows=chunk_rows)
    add_rolls(chunks, variance_rolls(columns, windows, min_obs))
    _add_variance_ratio(chunks, columns)
    _drop_helpers(chunks)
    return chunks.finish()


def rolling_correlation(df, pairs=CORR_PAIRS, window=360, min_obs=60, series=None, chunk_rows=None):
    pairs = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    chunks = Chunks(df, before=window - 1, series=series, chunk_rows=chunk_rows)
    return add_rolls(chunks, corr_rolls(pairs, window, min_obs)).finish()


def autocorrelation(df, columns=ACF_COLUMNS, window=60, min_obs=20, series=None, chunk_rows=None):
    """Lag-1 autocorrelation over the last ``window`` readings that are present.

    Missing readings are skipped before the window is counted, so each column
    is computed on its own non-null rows; rows without a reading get 0.
    """
    def one(data, c):
        present = data.where(F.col(c).isNotNull())
        chunks = Chunks(present, before=window, series=series, chunk_rows=chunk_rows)
        _add_previous(chunks, [c])
        add_rolls(chunks, acf_rolls([c], window, min_obs))
        _drop_helpers(chunks)
        missing = data.where(F.col(c).isNull()).withColumn(f"{c}_acf1", F.lit(0.0))
        return chunks.finish().unionByName(missing)

    return reduce(one, _present(df, columns), df)


def peak_count(df, columns=PEAK_COLUMNS, window=60, sigma=3.0, min_obs=30, series=None, chunk_rows=None):
    columns = _present(df, columns)
    chunks = Chunks(df, before=2 * window, series=series, chunk_rows=chunk_rows)
    add_rolls(chunks, peak_rolls(columns, window, min_obs))
    _add_peaks(chunks, columns, window, sigma)
    _drop_helpers(chunks)
    return chunks.finish()


def diurnal_amplitude(df, columns=AMPLITUDE_COLUMNS, window=2880, min_obs=720, series=None, chunk_rows=None):
    chunks = Chunks(df, before=window - 1, series=series, chunk_rows=chunk_rows)
    return add_rolls(chunks, amplitude_rolls(_present(df, columns), window, min_obs)).finish()


def drop_warmup(df: DataFrame, rows: int, series: Series | None = None) -> DataFrame:
    """Drop the first ``rows`` rows of each device."""
    if INDEX in df.columns:
        return df.where(F.col(INDEX) >= rows)
    return with_row_index(df, series).where(F.col(INDEX) >= rows).drop(INDEX)


# -- the matrix ----------------------------------------------------------------

def feature_matrix(
    df: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    include_labels: bool = True,
    warmup: bool = True,
    series: Series | None = None,
    peer_group: tuple = ("container_id", "timestamp"),
    chunk_rows: int | None = None,
) -> DataFrame:
    """All features of a cleaned telemetry table that carries the KPI columns.

    Needs non-null hashrate, temperature and power, which cleaning guarantees.
    Every window feature shares one row numbering and one chunking; the peer
    features add one exchange by (container, timestamp).
    """
    df = signal_ratios(df)
    made_by_peers = []
    if cfg.peers:
        # While the rows are narrow: afterwards their sorts would hold every feature of a partition's rows.
        # And before the warm-up rows go: peers compare against everyone present.
        plain, df = df.columns, peer_features(df, peer_group)
        made_by_peers = [c for c in df.columns if c not in plain]
    roll_cols, trend_cols = _present(df, ROLL_COLUMNS), _present(df, TREND_COLUMNS)
    var_cols, acf_cols = _present(df, VARIANCE_COLUMNS), _present(df, ACF_COLUMNS)
    peak_cols, amp_cols = _present(df, PEAK_COLUMNS), _present(df, AMPLITUDE_COLUMNS)
    pairs = [(a, b) for a, b in CORR_PAIRS if a in df.columns and b in df.columns]

    before = max(cfg.longest - 1, cfg.acf_window, 2 * cfg.peak_window)
    chunks = Chunks(df, before=before, series=series, chunk_rows=chunk_rows)
    rates = _present(df, cfg.rate_columns)
    _add_previous(chunks, acf_cols)
    _add_rates(chunks, rates)
    # What needs its own rows in order again goes first, while the rows are narrow.
    add_rolls(chunks, peak_rolls(peak_cols, cfg.peak_window, cfg.peak_min_obs))
    _add_peaks(chunks, peak_cols, cfg.peak_window, cfg.peak_sigma)
    add_rolls(chunks, [
        *rolling_stat_rolls(roll_cols, cfg.windows, cfg.minmax_below),
        slope_roll(cfg.slope_window, cfg.slope_min_obs),
        *trend_rolls(trend_cols, cfg.trend_window, cfg.trend_min_obs),
        *variance_rolls(var_cols, cfg.variance_windows, cfg.variance_min_obs),
        *corr_rolls(pairs, cfg.corr_window, cfg.corr_min_obs),
        *acf_rolls(acf_cols, cfg.acf_window, cfg.acf_min_obs),
        *amplitude_rolls(amp_cols, cfg.amplitude_window, cfg.amplitude_min_obs),
    ])
    _add_variance_ratio(chunks, var_cols)
    early = [*[f"{c}_rate" for c in rates], *[f"{c}_peaks_per_hour" for c in peak_cols]]
    late = [f"{c}_std_trend" for c in var_cols]
    rest = [c for c in chunks.df.columns if c not in (*early, *late)]
    chunks.df = chunks.df.select(*rest, *early[:len(rates)], *late, *early[len(rates):])
    _drop_helpers(chunks)
    out = chunks.finish(keep_index=True)
    out = out.select(*[c for c in out.columns if c not in made_by_peers], *made_by_peers)
    if warmup:
        out = out.where(F.col(INDEX) >= cfg.warmup)
    out = final_fill(out.drop(INDEX))
    if not include_labels:
        out = out.drop("is_pre_failure")
    return out


def feature_columns(df: DataFrame, also_exclude: tuple = ()) -> list[str]:
    """Model inputs: everything that is not metadata, label or physics trace."""
    skip = NON_FEATURES | set(also_exclude)
    return [c for c in df.columns if c not in skip]


def align_columns(df: DataFrame, names: list[str], keep: tuple = ()) -> DataFrame:
    """Model columns in model order; columns the table lacks become 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) if n in have else F.lit(0.0).alias(n) for n in names],
    )

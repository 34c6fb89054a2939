"""Runs of equal degradation phase per device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.joins import MINUTES_PER_DAY
from fleetlens.operators.ordering import INDEX, Chunks, Series
from fleetlens.operators.timelines import seconds_between


def phase_runs(df: DataFrame, column: str = "degradation_phase", series: Series | None = None,
               chunk_rows: int | None = None) -> DataFrame:
    """(device, run number, phase, start, end, days, rows).

    Only the first row of each run survives the first pass; it also knows the
    last timestamp of the run before it.  The second pass pairs each start with
    the next one.
    """
    series = series or Series.of(df)
    keep = list(dict.fromkeys([*series.keys, *series.order, *[c for c in ("time_slot",) if c in df.columns], column]))
    chunks = Chunks(df.select(*keep), before=1, series=series, chunk_rows=chunk_rows, total="__n")
    w = chunks.window
    chunks.add(__prev=F.lag(column).over(w), __prev_ts=F.lag("timestamp").over(w), __at=F.col(INDEX))
    rows = chunks.owned().drop(Chunks.CHUNK, INDEX)
    ends = rows.groupBy(*series.keys).agg(F.max("timestamp").alias("__end"))
    starts = rows.where((F.col("__at") == 0) | ~F.col(column).eqNullSafe(F.col("__prev")))
    pairs = Chunks(starts, after=1, series=series, chunk_rows=chunk_rows)
    w = pairs.window
    pairs.add(__next_at=F.lead("__at").over(w), __before_next=F.lead("__prev_ts").over(w), run_no=F.col(INDEX) + 1)
    runs = pairs.finish().join(ends, list(series.keys))
    end = F.coalesce("__before_next", "__end")
    return runs.select(
        *series.keys, "run_no", F.col(column).alias("phase"),
        F.col("timestamp").alias("start_ts"), end.alias("end_ts"),
        (seconds_between(F.col("timestamp"), end) / 60 / MINUTES_PER_DAY).alias("days"),
        (F.coalesce("__next_at", "__n") - F.col("__at")).alias("n_rows"),
    )

"""Rolling statistics over spans of time instead of rows.

A sliding range frame costs rows x window. Time is cut into blocks of the
window's length instead: the window of a row is the head of its own block up to
the row plus the tail of the block before it. Heads and tails are running frames
with mergeable states. Where the tail begins depends on the gaps, so every tail
is moved on by one window length: the one a row needs is the nearest moved tail
at or after its time, found by one more running frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.rolling import Roll, _merge, _need, _state, _value

MICROS = 1_000_000
HOUR, DAY, WEEK = 3_600, 86_400, 604_800


@dataclass(frozen=True)
class TimeRoll:
    """One rolling output column: ``kind`` (mean, std, min, max, range, count) of ``col`` over the last ``seconds``, both ends included."""

    kind: str
    col: str
    seconds: int
    out: str
    min_obs: int = 1
    fill: float | None = None

    def as_rows(self) -> Roll:
        return Roll(self.kind, self.col, 0, self.out, self.min_obs, fill=self.fill)


def time_rolling(df: DataFrame, rolls: list[TimeRoll], keys: tuple = ("miner_id",), time: str = "timestamp") -> DataFrame:
    """Adds the rolling columns: of all rows of the device with a time in [t - seconds, t].

    Rows of one time see each other. A task holds one block of one device. Rows
    without a time get nulls (or ``fill``); rows without a device are one device.
    """
    for seconds in sorted({r.seconds for r in rolls}):
        df = _one_length(df, seconds, [r for r in rolls if r.seconds == seconds], list(keys), time)
    return df


def _one_length(df: DataFrame, seconds: int, rolls: list[TimeRoll], keys: list[str], time: str) -> DataFrame:
    width = seconds * MICROS
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ks = [f"__k{i}" for i in range(len(keys))]
    needs = list(dict.fromkeys(_need(r.as_rows()) for r in rolls))
    names = {need: f"s{i}" for i, need in enumerate(needs)}
    parts = Window.partitionBy(*ks, "__b")
    up = parts.orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = parts.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def states(over) -> list:
        return [_state(n, lambda agg: agg.over(over)).alias(names[n]) for n in needs]

    rows = df.select("*", *[F.col(k).alias(x) for k, x in zip(keys, ks)], at.alias("__t"), F.floor(at / width).alias("__b"))
    rows = rows.select("*", F.struct(*states(up)).alias("__head"), F.struct(*states(down)).alias("__tail"))
    # rows of one time have one tail
    moved = rows.where("__t is not null").groupBy(*ks, (F.col("__b") + 1).alias("__b"), (F.col("__t") + width).alias("__t")).agg(F.first("__tail").alias("__moved"))
    both = rows.drop("__tail").withColumn("__own", F.lit(1)).unionByName(moved.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    later = parts.orderBy(F.desc("__t"), "__own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__moved", F.last("__moved", ignorenulls=True).over(later)).where("__own = 1")

    def value(r: TimeRoll):
        roll = r.as_rows()
        need = _need(roll)
        n = names[need]
        merged = _merge(need, F.col(f"__head.{n}"), F.col(f"__moved.{n}"))
        return F.when(F.col("__t").isNotNull(), _value(roll, merged)).otherwise(F.lit(r.fill)).alias(r.out)

    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[value(r) for r in rolls])

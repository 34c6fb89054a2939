"""Ordered work on long series without putting one series into one task.

A device's history can hold a large share of all rows, so nothing here opens
a window over a whole device.  Three building blocks cover every ordered
operator of the package:

* ``running_totals`` - prefix sums in two levels: totals per time slot first
  (map-side combined), a prefix over the slot totals, then a running sum
  inside each slot.
* ``with_row_index`` - the row number of each row in its series, as a prefix
  sum of ones.
* ``Chunks`` - fixed-size runs of rows, each with the neighbouring rows a
  window needs, so that any row-count window is computed inside one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE_BREAK = "event_id"
SLOT = "time_slot"
INDEX = "row_idx"
DEFAULT_CHUNK_ROWS = 4096


@dataclass(frozen=True)
class Series:
    """Which columns identify and order a series.

    ``slots`` are SQL expressions that never decrease along ``order``; a slot
    is the unit of work of the first pass, so it should hold a bounded number
    of rows of one series.
    """

    keys: tuple = ("miner_id",)
    order: tuple = ("timestamp",)
    slots: tuple = ("unix_seconds(cast(timestamp as timestamp)) div 3600",)

    @classmethod
    def of(cls, df: DataFrame) -> "Series":
        order = ("timestamp", TIE_BREAK) if TIE_BREAK in df.columns else ("timestamp",)
        if SLOT in df.columns:
            return cls(order=order, slots=(SLOT,))
        return cls(order=order)


def with_time_slot(df: DataFrame, rows_per_slot: int = 16384, key: str = "miner_id") -> DataFrame:
    """Cut each device's time span so that a slot holds about ``rows_per_slot`` rows.

    The slot width depends on the device's own row rate, which keeps the slots
    of a very dense device as small as those of the others.  Count, minimum and
    maximum are exact, so the slot of a row never depends on the execution.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    spans = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(micros).alias("__from"),
        F.max(micros).alias("__to"),
    ).select(
        F.col(key).alias("__key"), "__from",
        F.greatest(
            F.lit(1),
            ((F.col("__to") - F.col("__from")) / F.ceil(F.col("__n") / rows_per_slot)).cast("long") + 1,
        ).alias("__width"),
    )
    return (
        df.join(spans, df[key] == spans["__key"], "left")
        .withColumn(SLOT, F.coalesce(F.expr("0L + (unix_micros(cast(timestamp as timestamp)) - __from) div __width"), F.lit(0)))
        .drop("__key", "__from", "__width")
    )


def running_totals(
    df: DataFrame,
    series: Series,
    sums: dict[str, Column],
    grand: tuple = (),
    descending: bool = False,
) -> DataFrame:
    """Add inclusive prefix sums along the series.

    For every name in ``grand`` the series total is added as ``<name>_all``.
    """
    keys = list(series.keys)
    slots = [f"__slot{i}" for i in range(len(series.slots))]
    by = keys + slots
    tagged = df.select(
        "*",
        *[F.expr(e).alias(c) for e, c in zip(series.slots, slots)],
        *[expr.alias(f"__v_{name}") for name, expr in sums.items()],
    )
    per_slot = tagged.groupBy(*by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])

    def ordered(cols):
        return [F.desc(c) if descending else F.asc(c) for c in cols]

    before = Window.partitionBy(*keys).orderBy(*ordered(slots)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_slot.select(
        *[F.col(c).alias(f"__o_{c}") for c in by],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(whole).alias(f"{n}_all") for n in grand],
    )
    condition = None
    for c in by:
        same = tagged[c] == offsets[f"__o_{c}"]
        condition = same if condition is None else condition & same
    inside = Window.partitionBy(*by).orderBy(*ordered(series.order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return tagged.join(offsets, condition, "left").select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"__b_{n}"), F.lit(0)) + F.sum(f"__v_{n}").over(inside)).alias(n)
            for n in sums
        ],
        *[f"{n}_all" for n in grand],
    )


def with_row_index(
    df: DataFrame, series: Series | None = None, name: str = INDEX, total: str | None = None
) -> DataFrame:
    """0-based position of each row in its series, and optionally the series length."""
    series = series or Series.of(df)
    out = running_totals(df, series, {"__one": F.lit(1)}, grand=("__one",) if total else ())
    out = out.withColumn(name, (F.col("__one") - 1).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__one_all").cast("long"))
    return out.drop("__one", "__one_all")


class Chunks:
    """Rows of each series cut into chunks with the neighbours a window needs.

    ``before`` / ``after`` are the numbers of neighbouring rows copied into a
    chunk.  A task therefore sorts at most ``rows + before + after`` rows of one
    series, whatever the series length.  Operators add columns to ``df`` with
    windows built by ``rows()`` or ``window``; ``finish`` drops the copies.
    """

    CHUNK = "__chunk"
    OWN = "__own"

    def __init__(
        self,
        df: DataFrame,
        before: int = 0,
        after: int = 0,
        series: Series | None = None,
        chunk_rows: int | None = None,
        total: str | None = None,
    ):
        self.series = series or Series.of(df)
        self.size = chunk_rows or max(DEFAULT_CHUNK_ROWS, 4 * (before + after))
        self.before, self.after = before, after
        indexed = df if INDEX in df.columns else with_row_index(df, self.series, total=total)
        self.kept_index = INDEX in df.columns
        own = F.floor(F.col(INDEX) / self.size)
        first = F.greatest(F.floor((F.col(INDEX) - after) / self.size), F.lit(0))
        last = F.floor((F.col(INDEX) + before) / self.size)
        copies = F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))
        self.df = indexed.withColumn(self.CHUNK, F.explode(copies)).withColumn(
            self.OWN, F.col(self.CHUNK) == own
        )
        self.parts = [*self.series.keys, self.CHUNK]
        self.window = Window.partitionBy(*self.parts).orderBy(INDEX)

    def rows(self, n: int):
        """The current row and the ``n - 1`` rows before it."""
        return self.window.rowsBetween(-(n - 1), Window.currentRow)

    def running(self):
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def add(self, **columns: Column) -> "Chunks":
        self.df = self.df.select("*", *[c.alias(n) for n, c in columns.items()])
        return self

    def owned(self) -> DataFrame:
        """Rows without the copies, chunk number kept."""
        return self.df.where(self.OWN).drop(self.OWN)

    def finish(self, keep_index: bool = False) -> DataFrame:
        out = self.owned().drop(self.CHUNK)
        return out if keep_index or self.kept_index else out.drop(INDEX)

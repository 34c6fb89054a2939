"""Halo exchange: the last rows of a time slot are copied to the next one.

A window of a few rows then needs no row numbers and no window over a whole
device: only the newest rows of each slot travel besides the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.ordering import Series

SLOT = "__halo_slot"
OWN = "__halo_own"


def with_halo(df: DataFrame, rows: int, columns: list[str], series: Series) -> tuple[DataFrame, Window]:
    """The rows plus, in each slot, the last ``rows`` rows before it (``OWN`` false, ``columns`` only), and the window over a slot.

    Slots never overlap in time, so the halo of a slot is the end of what its
    predecessors' ends hold: ``rows`` slots back are enough, as each holds a row
    at least. Rows without a device are one device.
    """
    keys, order = list(series.keys), list(series.order)
    tagged = df.withColumn(SLOT, F.struct(*[F.expr(e).alias(f"s{i}") for i, e in enumerate(series.slots)]))
    newest = Window.partitionBy(*keys, SLOT).orderBy(*[F.desc(c) for c in order])
    # A limit by row number is applied before the exchange already, so few rows are sent.
    ends = tagged.select(*dict.fromkeys([*keys, SLOT, *order, *columns])).withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= rows)
    row = F.struct((-F.col("__r")).alias("r"), *[F.col(c) for c in dict.fromkeys([*order, *columns]) if c not in keys])
    ends = ends.groupBy(*keys, SLOT).agg(F.array_sort(F.collect_list(row)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(-rows, -1)
    halo = ends.withColumn("__halo", F.flatten(F.collect_list("__end").over(before))).where(F.size("__halo") > 0)
    copies = halo.select(*keys, SLOT, F.explode(F.slice("__halo", -F.least(F.size("__halo"), F.lit(rows)), rows)).alias("__c"))
    copies = copies.select(*keys, SLOT, "__c.*").drop("r").withColumn(OWN, F.lit(False))
    both = tagged.withColumn(OWN, F.lit(True)).unionByName(copies, allowMissingColumns=True)
    return both, Window.partitionBy(*keys, SLOT).orderBy(*order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(OWN, SLOT)

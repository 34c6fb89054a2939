"""Mergeable sketches per device and day: quantiles and distinct counts of any range of days without its rows.

A sketch is a few kilobytes whatever it stands for, so a table of them answers for
years of readings. ``refined_percentile`` makes the answer exact: the sketch names
two values that surely enclose it, one pass counts what lies below and gathers
the distinct values between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordered_scan import prefix_sums

#: Size of a quantile sketch; its rank error is then under ``RANK_ERROR`` (with 99 % confidence about 1.33 % for 200).
SIZE = 200
RANK_ERROR = 0.02
#: log2 of the registers of a distinct count; its standard error is about 1.04 / sqrt(2**LG).
LG = 12


def day_sketches(df: DataFrame, value: str, counted: str, keys: tuple = ("miner_id",), day: str = "day") -> DataFrame:
    """(keys, day, n, lo, hi, quantiles, distinct); a null value counts nowhere."""
    return df.groupBy(*keys, day).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), SIZE).alias("quantiles"), F.hll_sketch_agg(F.col(counted).cast("string"), LG).alias("distinct"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of all rows of each group together; no keys: of everything."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double(F.col("quantiles"), SIZE).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def quantile(column: str, rank: float, n: str = "n") -> Column:
    """The value at a rank; null from a sketch of nothing."""
    return F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(F.col(column), F.lit(float(min(max(rank, 0.0), 1.0)))))


def distinct(column: str) -> Column:
    return F.hll_sketch_estimate(F.col(column))


def refined_percentile(df: DataFrame, sketches: DataFrame, value: str, fraction: float, name: str = "percentile") -> DataFrame:
    """The exact percentile with linear interpolation, one row; null where there is no value.

    Bounds come from the sketches, checked against exact counts: should one not
    enclose the percentile it is dropped, so the result never depends on the sketch's
    luck.
    """
    one = merged(sketches)
    bounds = one.select("n", quantile("quantiles", fraction - RANK_ERROR).alias("a"), quantile("quantiles", fraction + RANK_ERROR).alias("b")).first()
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    if not bounds or not bounds["n"]:
        return x.agg(F.max("v").alias(name))
    a, b = bounds["a"], bounds["b"]
    below, n, upto = x.agg(F.count_if(F.col("v") < a), F.count(F.lit(1)), F.count_if(F.col("v") <= b)).first()
    position = fraction * (n - 1)
    if below > int(position):
        a, below = float("-inf"), 0
    if upto < min(int(position) + 2, n):
        b = float("inf")
    groups = x.where((F.col("v") >= a) & (F.col("v") <= b)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    run = prefix_sums(groups, [F.asc("v")], {"upto": F.col("c")}).withColumn("upto", F.col("upto") + below)
    lo = F.min(F.when(F.col("upto") > int(position), F.col("v")))
    hi = F.min(F.when(F.col("upto") > -int(-position // 1), F.col("v")))
    return run.agg(lo.alias("lo"), hi.alias("hi")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * (position - int(position))).alias(name))

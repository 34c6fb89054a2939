"""Prefix sums and ranks over a whole table, in parallel.

The table is dealt out by ranges of its order, so every partition is a stretch of
the result. Each stretch is summed on its own; the totals of the stretches, one
row a partition, are added up on the driver, and each row's running sum inside
its stretch plus the total of all stretches before it is exact. No window has an
empty key, no task sees more than a stretch, and nothing is estimated: the range
bounds only balance the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import scratch_path, stored

STRETCH = "__stretch"


def in_stretches(df: DataFrame, order: list[Column], path: str | None = None) -> DataFrame:
    """The rows, stored, with the number of the range partition they lie in.

    Rows equal in ``order`` share a stretch. The number of partitions is the
    session's; AQE may join small neighbours, which keeps the order. Storing fixes
    what lies where: a lost executor costs a read, and a second job sees the same
    stretches.
    """
    laid = df.repartitionByRange(*order).withColumn(STRETCH, F.spark_partition_id())
    return stored(laid, path or scratch_path(df.sparkSession, "stretches"))


def _totals(laid: DataFrame, sums: dict[str, Column]) -> list[tuple]:
    """(stretch, totals before it ...) in order, and the grand totals in the last row; one row a partition."""
    rows = laid.groupBy(STRETCH).agg(*[F.sum(v).alias(n) for n, v in sums.items()]).collect()
    run, out = [0] * len(sums), []
    for row in sorted(rows, key=lambda r: r[STRETCH]):
        out.append((row[STRETCH], *run))
        run = [a + (row[n] or 0) for a, n in zip(run, sums)]
    return [*out, (None, *run)]


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], grand: tuple = (), cast: str = "bigint") -> DataFrame:
    """Adds inclusive prefix sums along ``order``, and for each name in ``grand`` the total of all as ``<name>_all``.

    Rows equal in ``order`` come in any order, so add what breaks ties where that
    matters. A null value adds nothing; an empty table stays empty.
    """
    spark = df.sparkSession
    tagged = df.select("*", *[v.cast(cast).alias(f"__v_{n}") for n, v in sums.items()])
    laid = in_stretches(tagged, order)
    *before, last = _totals(laid, {n: F.col(f"__v_{n}") for n in sums})
    schema = ", ".join([f"{STRETCH} int", *[f"__b_{n} {cast}" for n in sums]])
    offsets = spark.createDataFrame(before, schema)  # one row a partition
    inside = Window.partitionBy(STRETCH).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = dict(zip(sums, last[1:]))
    return laid.join(F.broadcast(offsets), STRETCH).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n) for n in sums],
        *[F.lit(totals[n]).cast(cast).alias(f"{n}_all") for n in grand])


def positions(df: DataFrame, order: list[Column], name: str = "pos", total: str | None = None) -> DataFrame:
    """Adds the 0-based position of each row along ``order``, and the number of rows as ``total``."""
    out = prefix_sums(df, order, {"__p": F.lit(1)}, grand=("__p",) if total else ())
    out = out.withColumn(name, F.col("__p") - 1).drop("__p")
    return out.withColumnRenamed("__p_all", total) if total else out


def ranks(df: DataFrame, column: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """Adds ``rank()`` along a column: equal values share the first one's position, from 1.

    Only the distinct values are ordered, with their counts, so a value that most
    rows have is one row of the scan.
    """
    counts = df.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    order = F.desc("__value") if descending else F.asc("__value")
    run = prefix_sums(counts, [order], {"__upto": F.col("__n")})
    run = run.select("__value", (F.col("__upto") - F.col("__n") + 1).alias(name))
    return df.join(run, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")

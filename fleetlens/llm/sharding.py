"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Write the rows with their partition and place; count the rows of each partition.
2. Draw how many rows each partition sends to each shard: row after row of the
   matrix is multivariate hypergeometric given the places still free, so all
   arrangements of the rows over the shards are equally likely and every shard
   gets exactly its size. The matrix has partitions x shards numbers.
3. Each partition permutes its rows: the labels of its matrix row are dealt to
   its rows in random order, and each row gets a random key.
4. Exchange; within a shard the order of the random keys is a second uniform
   permutation. A shard may be far too large for one task, so its key range is
   cut into buckets; rows before a bucket come from counts of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.frames import with_columns, without
from fleetlens.session import scratch_path, stored

#: Rows of a shard that one task orders, on average.
BUCKET_ROWS = 1 << 14
KEY_BITS = 62


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent by each partition to each shard; sums are ``counts`` and ``sizes``."""
    rng, free = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        left, total = n, int(free.sum())
        for s in range(len(sizes)):  # one marginal after the other
            total -= int(free[s])
            take = left if total == 0 else int(_hypergeometric(rng, int(free[s]), total, left))
            out[i, s] = take
            left -= take
        free -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from an urn; numpy's sampler ends at 10^9, larger urns are inverted around the mode.

    The weights there follow from ratios of neighbouring probabilities; what lies
    over 12 standard deviations away weighs less than rounding.
    """
    if draws == 0 or good == 0:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    reach = 12 * (math.isqrt(draws) + 1)
    k = np.arange(max(0, draws - bad, mode - reach), min(good, draws, mode + reach) + 1, dtype=np.float64)
    log = np.cumsum(np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1)))
    log = np.concatenate([[0.0], log])
    cum = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(cum, rng.random() * cum[-1], side="right")])


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Adds ``shard`` (0 to shards-1, sizes at most one apart) and ``slot`` (gapless from 0 in each shard) to every row.

    The rows are first written with their partition and their place in it. Labels
    and keys are functions of these two and the seed, so a task that runs again,
    or a reader that cuts the table in another way, deals the same ones. Rows
    that are equal in all columns are interchangeable, so ties need no rule;
    nulls are values like others; an empty table gives an empty result. Columns
    named shard or slot are replaced, others kept.
    """
    df = without(df, "shard", "slot")
    spark = df.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield with_columns(batch, {"__part": pa.array(np.full(n, me, np.int32)), "__at": pa.array(np.arange(at, at + n))})
            at += n

    placed = [*df.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())]
    table = stored(df.mapInArrow(place, T.StructType(placed)), scratch_path(spark, "placed"))
    counted = {r[0]: r[1] for r in table.groupBy("__part").count().collect()}  # one row a partition
    rows = sum(counted.values())
    parts = max(counted, default=-1) + 1
    matrix = spark.sparkContext.broadcast(communication_matrix([counted.get(i, 0) for i in range(parts)], shard_sizes(rows, shards), seed))
    buckets = max(1, math.ceil(rows / shards / BUCKET_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, labels, keys = -1, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            of, at = (batch.column(c).to_numpy() for c in ("__part", "__at"))
            shard, key = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(of):
                if p != part:
                    part, rng, own = p, np.random.default_rng([seed, int(p)]), matrix.value[p]
                    labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), own))
                    keys = rng.integers(0, 1 << KEY_BITS, len(labels), dtype=np.int64)
                here = of == p
                shard[here], key[here] = labels[at[here]], keys[at[here]]
            yield with_columns(batch.drop_columns(["__part", "__at"]), {"shard": pa.array(shard), "__key": pa.array(key)})

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__key", T.LongType())])
    dealt = table.mapInArrow(deal, schema)
    dealt = dealt.withColumn("__bucket", F.shiftright(F.shiftright("__key", KEY_BITS - 31) * buckets, 31).cast("int"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__bucket").count().select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__key", *[F.col(f"`{c}`") for c in df.columns])))
    joined = ranked.join(starts, ["shard", "__bucket"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "shard", (F.col("__start") + F.col("__rank") - 1).alias("slot"))

"""Connected components as DataFrame rounds (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import scratch_path, stored


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round links every node to the smallest of its neighbours: first larger
    neighbours (large star), then smaller ones (small star); it ends when all
    components are stars. Edges never grow in number, the diameter shrinks by
    powers, and the rounds are written to the shared folder, so a lost executor
    costs one round at most. A hot node is a sum with partial results and the
    large side of a join that is split where it is skewed. Loops, repeated edges
    and edges with a null end are allowed (a null end names no node).
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = now.where("a = b").select(F.col("a").alias("node")).distinct()
    now = now.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, scratch_path(spark, "edges"))
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = stored(now, scratch_path(spark, "edges"))
        last, stamp = stamp, _stamp(now)
        if stamp == last:
            break
    stars = now.select(u.alias("node"), v.alias("component"))
    roots = now.select(v.alias("node")).union(loops).distinct().join(stars, "node", "left_anti")
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))

"""Windows by doubled states, tasks and buckets that do not follow the table."""

from pyspark.sql import functions as F

from fleetlens.operators import rolling as Ro
from fleetlens.operators.ordering import Chunks, Series
from fleetlens.operators.rolling import Roll
from fleetlens.session import ADVISORY_KEY, TASK_BYTES, scratch_path, small_tasks
from fleetlens.sources.clustered import write_clustered

ROLLS = [
    Roll("mean", "a", 3, "mean3", 1), Roll("std", "a", 40, "std40", 3, fill=0.0), Roll("min", "b", 7, "min7", 2),
    Roll("range", "a", 15, "range15", 1), Roll("count", "a", 9, "count9", 1), Roll("slope", "a", 33, "slope33", 11, fill=0.0),
    Roll("corr", "a", 20, "corr20", 5, other="b", fill=0.0), Roll("max", "b", 2, "max2", 1),
]


def rows(spark, n=600):
    """Three series with gaps, a constant stretch and null readings."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("d"), (i % 3).cast("string")).alias("miner_id"), i.alias("event_id"),
        F.timestamp_seconds(i * 60).alias("timestamp"),
        F.when(i % 11 == 0, None).when(i.between(200, 400), F.lit(0.1)).otherwise(F.sin(i * 0.7) * 100 + 1e4).alias("a"),
        F.when(i % 13 != 0, (i * 37 % 101).cast("int")).alias("b"))


def rolled(df, dense_rows):
    chunks = Chunks(df, before=39, series=Series.of(df), chunk_rows=64)
    return Ro.add_rolls(chunks, ROLLS, native_rows=24, dense_rows=dense_rows).finish()


def test_dense_windows_equal_sliding_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # windows reach over batches
    try:
        a, b = rolled(rows(spark), 512), rolled(rows(spark), 0)
        assert a.dtypes == b.dtypes
        for x, y in zip(a.orderBy("event_id").collect(), b.orderBy("event_id").collect()):
            for r in ROLLS:
                p, q = x[r.out], y[r.out]
                assert (p is None) == (q is None) and (p is None or abs(p - q) <= 1e-7 * max(1, abs(q))), (r, x, y)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tasks_stay_small(spark):
    before = spark.conf.get(ADVISORY_KEY)
    try:
        spark.conf.set(ADVISORY_KEY, "64MB")
        small_tasks(spark)
        assert int(spark.conf.get(ADVISORY_KEY)) == TASK_BYTES
        spark.conf.set(ADVISORY_KEY, "1MB")
        small_tasks(spark)
        assert spark.conf.get(ADVISORY_KEY) == "1MB"
    finally:
        spark.conf.set(ADVISORY_KEY, before)


def test_buckets_follow_the_rows(spark, monkeypatch):
    from fleetlens.sources import clustered

    monkeypatch.setattr(clustered, "ROWS_A_BUCKET", 50)
    df = rows(spark).withColumn("time_slot", F.floor(F.col("event_id") / 30))
    write_clustered(df, "many_buckets", 1, ["a"], buckets=2, path=scratch_path(spark, "many_buckets"))
    described = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED many_buckets").collect()}
    assert int(described["Num Buckets"]) == 12
    spark.sql("DROP TABLE many_buckets")

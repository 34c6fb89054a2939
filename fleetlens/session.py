"""Session settings and the shared folder used for checkpoints and tables."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Shuffled bytes of one task. Cleaning, numbering and peers sort the same rows several
#: times in a stage, and sorted rows take a multiple of their shuffled bytes.
TASK_BYTES = 12 << 20
#: Rows of one task: about ``TASK_BYTES`` of cleaned telemetry with its peers.
TASK_ROWS = 50_000
ADVISORY_KEY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PARTITIONS_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def small_tasks(spark: SparkSession, rows: int = 0) -> None:
    """AQE joins partitions up to ``TASK_BYTES`` at most, and a table of so many rows is shuffled to one for each ``TASK_ROWS`` at least, so that a task's memory does not follow the table."""
    conf = spark._jsparkSession.sessionState().conf()
    size = conf.getConfString(ADVISORY_KEY, "64MB")
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size) > TASK_BYTES:
        spark.conf.set(ADVISORY_KEY, str(TASK_BYTES))
    # AQE joins small partitions but leaves a sort's large ones as they are.
    if (least := math.ceil(rows / TASK_ROWS)) > conf.numShufflePartitions():
        spark.conf.set(PARTITIONS_KEY, str(least))


_local_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a fresh temporary folder.
    """
    global _local_root
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="fleetlens-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_often(spark: SparkSession) -> None:
    """Lets iterative fits write checkpoints, in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def cut_lineage(spark: SparkSession, df):
    """Reliable checkpoint in the shared folder."""
    cut_often(spark)
    return df.checkpoint(eager=True)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the driver's JVM has seen that nothing refers to them; with a large heap that may be long after their stage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df, path: str):
    """Write a stage to a table file and read it back, so that later stages start from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

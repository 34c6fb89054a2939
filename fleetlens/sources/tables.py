"""Telemetry readers, table sinks, the feature cache and the run manifest."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.clean import missing_as_null
from fleetlens.operators.filters import latest as latest_rows
from fleetlens.operators.filters import validate_schema
from fleetlens.schema import LIVE_TELEMETRY_SCHEMA, TELEMETRY_SCHEMA
from fleetlens.session import release_shuffles, shared_dir

FEATURES_VERSION = 1


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of tables that this library wrote and no longer reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# -- readers -------------------------------------------------------------------

def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = TELEMETRY_SCHEMA) -> DataFrame:
    """Telemetry from Parquet or CSV.

    No global sort: every ordered operator orders what it needs.  Missing
    readings are null in everything that follows.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}; use parquet or csv")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)
    return missing_as_null(validate_schema(df))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns; the scan reads nothing else."""
    return spark.read.parquet(path).select(*columns)


# -- sinks ---------------------------------------------------------------------

def table_path(spark: SparkSession, table: str) -> str:
    return f"{shared_dir(spark)}/tables/{table}"


def ingest(df: DataFrame, table: str = "telemetry", mode: str = "replace", path: str | None = None) -> int:
    """Write to a catalog table; returns the number of rows written.

    ``replace`` recreates the table, ``append`` adds to it and creates it when
    it is missing.  Rows are counted while they are written.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"mode must be 'replace' or 'append', got {mode!r}")
    spark = df.sparkSession
    path = path or table_path(spark, table)
    if mode == "replace":
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    exists = spark.catalog.tableExists(table)
    counted, rows = _counting(df)
    if mode == "append" and exists:
        counted.select(*spark.table(table).columns).write.insertInto(table)
    else:
        counted.write.mode("overwrite").option("path", path).format("parquet").saveAsTable(table)
    return rows()


def _counting(df: DataFrame):
    from pyspark.sql import Observation

    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
    return observed, lambda: int(seen.get["n"])


def ingest_parquet(spark: SparkSession, source: str, table: str = "telemetry") -> int:
    return ingest(spark.read.parquet(source), table, "replace")


def clear_table(spark: SparkSession, table: str = "telemetry") -> None:
    """Remove all rows, keep the schema; nothing happens when the table is missing.

    The path may be an external table's, so the empty table is written over it.
    """
    if spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], spark.table(table).schema)
        empty.write.mode("overwrite").insertInto(table, overwrite=True)


def ensure_live_table(spark: SparkSession, table: str = "live_telemetry") -> None:
    if not spark.catalog.tableExists(table):
        ingest(spark.createDataFrame([], LIVE_TELEMETRY_SCHEMA), table)


def write_parquet(df: DataFrame, path: str, by_day: bool = True) -> str:
    """Raw telemetry or features, one folder per day so that time filters prune."""
    if by_day:
        day = df.withColumn("day", F.to_date("timestamp"))
        # Gathers days in few files, but splits a day by measured size: no day or device is one task.
        day.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def content_stamp(df: DataFrame, *also) -> str:
    """Names the rows of a table, in any order, and whatever else decides a result (a configuration, say).

    Their number and the sum of their hashes: a changed, added or missing row gives
    another name, also where the newest timestamp stays.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(repr((df.columns, row["n"], row["h"], *also)).encode()).hexdigest()[:16]


def built_once(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, built when it is not there yet; _SUCCESS appears when a write has committed, so a broken one is redone."""
    missing = not path_exists(spark, f"{path}/_SUCCESS")
    if missing:
        write_parquet(build(), path, by_day=False)
    table = spark.read.parquet(path)
    if missing:  # after the read: listeners hold a query for a moment after its end
        release_shuffles(spark)
    return table


def features_path(root: str, source_stamp: str, version: int = FEATURES_VERSION) -> str:
    return f"{root}/features/v={version}/source={source_stamp}"


def cached_features(spark: SparkSession, root: str, source_stamp: str, build, version: int = FEATURES_VERSION) -> DataFrame:
    """Features of this code version and source, built only when they are not there yet.

    ``source_stamp`` is the ``content_stamp`` of the raw data and the feature
    configuration, so changed data or settings get a new folder.
    """
    return built_once(spark, features_path(root, source_stamp, version), build)


# -- queries ---------------------------------------------------------------------

def sql_query(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Any SQL over the catalog; keyword frames become temporary views first."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def query_where(df: DataFrame, condition: str = "1=1") -> DataFrame:
    return df.where(condition)


def latest(df: DataFrame, miner_id: str) -> dict:
    """Newest row of a device as a dict, {} when it has none."""
    row = latest_rows(df, miner_id).first()
    return row.asDict() if row else {}


def count_rows(spark: SparkSession, table: str = "telemetry") -> int:
    return spark.table(table).count()


# -- run manifest ------------------------------------------------------------------

MANIFEST_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("training_date_utc", T.StringType()),
    T.StructField("n_train_rows", T.LongType()),
    T.StructField("n_val_rows", T.LongType()),
    T.StructField("n_test_rows", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("feature_count", T.IntegerType()),
    T.StructField("feature_names_hash", T.StringType()),
    T.StructField("training_config", T.StringType()),
    T.StructField("extra", T.StringType()),
])


def feature_names_hash(names: list[str]) -> str | None:
    """First 16 hex digits of sha256 over the comma-joined names."""
    return hashlib.sha256(",".join(names).encode()).hexdigest()[:16] if names else None


def append_manifest(
    spark: SparkSession, path: str, *, model_path: str, model_type: str, n_train_rows: int,
    metrics: dict, feature_names: list[str] | None = None, training_config: dict | None = None,
    n_val_rows: int | None = None, n_test_rows: int | None = None, extra: dict | None = None,
) -> None:
    row = (
        1, model_path, model_type, datetime.now(timezone.utc).isoformat(), n_train_rows, n_val_rows, n_test_rows,
        {k: float(v) for k, v in metrics.items() if v is not None},
        len(feature_names) if feature_names else None, feature_names_hash(feature_names or []),
        json.dumps(training_config or {}, sort_keys=True), json.dumps(extra or {}, sort_keys=True),
    )
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """All recorded runs, or None when nothing was recorded."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path) if path_exists(spark, path) else None

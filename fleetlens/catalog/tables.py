"""Queries: sources, sinks, table management, filters and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import KPI, TEL, _SENSORS, g, gridded, kpi, ordered, query, sql, telemetry
from fleetlens.catalog.cleaning import TELEMETRY_COLUMNS, TELEMETRY_SQL
from fleetlens.operators import filters as Fi
from fleetlens.operators.features import align_columns, feature_columns
from fleetlens.schema import TELEMETRY_SCHEMA
from fleetlens.session import scratch_path
from fleetlens.sources import tables as Tb

ALL_TEL = sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel")


def _stored(spark, sf, name):
    """The telemetry view written to the shared folder by day."""
    return Tb.write_parquet(telemetry(spark, sf).select(*TELEMETRY_COLUMNS), scratch_path(spark, name))


def _schema(columns):
    extra = {"event_id": "bigint"}
    known = {f.name: f.dataType.simpleString() for f in TELEMETRY_SCHEMA.fields} | extra
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string(", ".join(f"{c} {known[c]}" for c in columns))


@query("src1_scan_parquet", ALL_TEL)
def scan_parquet(spark, sf):
    path = _stored(spark, sf, "src1")
    return Tb.read_telemetry(spark, path, schema=_schema(TELEMETRY_COLUMNS)).select(*TELEMETRY_COLUMNS)


@query("src2_scan_csv", ALL_TEL)
def scan_csv(spark, sf):
    path = scratch_path(spark, "src2")
    telemetry(spark, sf).select(*TELEMETRY_COLUMNS).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return Tb.read_telemetry(spark, path, "csv", _schema(TELEMETRY_COLUMNS))


@query("src3_scan_columns", "SELECT event_id, ts, value FROM events")
def scan_columns(spark, sf):
    return Tb.read_columns(spark, f"{sf}/events.parquet", ["event_id", "ts", "value"])


@query("src4_validate_schema", sql(TEL, 'SELECT event_id, "timestamp", miner_id, 5 AS n_refused FROM tel'))
def validate_schema(spark, sf):
    """Passes the whole table on; a table that lacks any one of the required columns is refused."""
    tel = telemetry(spark, sf)
    refused = 0
    for c in ("timestamp", "miner_id", "temperature_c", "hashrate_th", "power_w"):
        try:
            Fi.validate_schema(tel.drop(c))
        except ValueError:
            refused += 1
    return Fi.validate_schema(tel).select("event_id", "timestamp", "miner_id", F.lit(refused).alias("n_refused"))


@query("snk1_ingest_replace", sql(TEL, f"SELECT count(*) AS written, count(*) AS stored FROM tel"))
def ingest_replace(spark, sf):
    df = telemetry(spark, sf).select(*TELEMETRY_COLUMNS)
    path = scratch_path(spark, "snk1")
    Tb.ingest(df, "fleet_replace", "replace", path)
    n = Tb.ingest(df, "fleet_replace", "replace", path)
    return spark.table("fleet_replace").agg(F.lit(n).cast("long").alias("written"), F.count(F.lit(1)).alias("stored"))


@query("snk2_ingest_append", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel UNION ALL SELECT {TELEMETRY_SQL} FROM tel"))
def ingest_append(spark, sf):
    df = telemetry(spark, sf).select(*TELEMETRY_COLUMNS)
    spark.sql("DROP TABLE IF EXISTS fleet_append")
    path = scratch_path(spark, "snk2")
    Tb.ingest(df, "fleet_append", "append", path)
    Tb.ingest(df, "fleet_append", "append", path)
    return spark.table("fleet_append")


@query("snk3_ingest_parquet", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def ingest_parquet(spark, sf):
    spark.sql("DROP TABLE IF EXISTS fleet_events")
    Tb.ingest(spark.read.parquet(f"{sf}/events.parquet"), "fleet_events", "replace", scratch_path(spark, "snk3"))
    return spark.table("fleet_events")


@query("snk4_clear_table", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel WHERE false"))
def clear_table(spark, sf):
    Tb.ingest(telemetry(spark, sf).select(*TELEMETRY_COLUMNS), "fleet_clear", "replace", scratch_path(spark, "snk4"))
    Tb.clear_table(spark, "fleet_clear")
    Tb.clear_table(spark, "fleet_never_made")
    return spark.table("fleet_clear")


@query("snk5_write_parquet", sql(TEL, 'SELECT CAST("timestamp" AS DATE) AS day, count(*) AS n_rows FROM tel GROUP BY 1'))
def write_parquet(spark, sf):
    return spark.read.parquet(_stored(spark, sf, "snk5")).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"))


@query("snk6_feature_cache", sql(KPI, f"SELECT event_id, miner_id, {g('te_health', 9)} AS te_health FROM kpi"))
def feature_cache(spark, sf):
    """Features of an older table are not taken for those of this one; those of this one are made once."""
    root, tel = scratch_path(spark, "snk6"), telemetry(spark, sf)
    features = lambda: kpi(spark, sf).select("event_id", "miner_id", "te_health")
    older = tel.withColumn("power_w", F.when(F.col("event_id") != 5, F.col("power_w")))
    Tb.cached_features(spark, root, Tb.content_stamp(older), lambda: features().limit(0))
    Tb.cached_features(spark, root, Tb.content_stamp(tel), features)
    again = Tb.cached_features(spark, root, Tb.content_stamp(tel), lambda: (_ for _ in ()).throw(AssertionError("cache was not used")))
    return gridded(again, ["te_health"], 9)


@query("qry1_sql_query", sql(TEL, "SELECT model, count(*) AS n, max(temperature_c) AS max_temp FROM tel GROUP BY model"))
def sql_query(spark, sf):
    return Tb.sql_query(spark, "SELECT model, count(*) AS n, max(temperature_c) AS max_temp FROM telemetry GROUP BY model",
                        telemetry=telemetry(spark, sf))


@query("qry2_query_where", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel WHERE temperature_c > 90 AND model IN ('Pro', 'XP')"))
def query_where(spark, sf):
    return Tb.query_where(telemetry(spark, sf), "temperature_c > 90 AND model IN ('Pro', 'XP')").select(*TELEMETRY_COLUMNS)


@query("qry3_latest", sql(TEL, f"""SELECT {TELEMETRY_SQL} FROM tel
QUALIFY row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, event_id DESC) = 1"""))
def latest(spark, sf):
    return Fi.latest(telemetry(spark, sf).select(*TELEMETRY_COLUMNS))


@query("qry3_latest_one", sql(TEL, f"""SELECT {TELEMETRY_SQL} FROM tel WHERE miner_id = 'MNR-00008'
ORDER BY "timestamp" DESC, event_id DESC LIMIT 1"""))
def latest_one(spark, sf):
    return Fi.latest(telemetry(spark, sf).select(*TELEMETRY_COLUMNS), "MNR-00008")


@query("qry4_count", "SELECT count(*) AS n FROM events")
def count(spark, sf):
    return telemetry(spark, sf).agg(F.count(F.lit(1)).alias("n"))


@query("man1_run_manifest", sql(TEL, """
SELECT 'threshold_rule' AS model_type, count(*) AS n_train_rows, CAST(count(*) FILTER (WHERE is_pre_failure) AS DOUBLE) AS positives,
  CAST(6 AS INTEGER) AS feature_count,
  substr(sha256('clock_frequency_mhz,voltage_v,hashrate_th,temperature_c,power_w,ambient_temperature_c'), 1, 16) AS feature_names_hash
FROM tel"""))
def run_manifest(spark, sf):
    path = scratch_path(spark, "man1")
    n, pos = telemetry(spark, sf).agg(F.count(F.lit(1)), F.count_if("is_pre_failure")).first()
    Tb.append_manifest(spark, path, model_path="models/rule", model_type="threshold_rule", n_train_rows=n,
                       metrics={"positives": pos}, feature_names=_SENSORS)
    return Tb.read_manifest(spark, path).select(
        "model_type", "n_train_rows", F.col("metrics")["positives"].alias("positives"), "feature_count", "feature_names_hash")


# -- filters and projections ---------------------------------------------------------

@query("fil1_filter_by_miners", sql(TEL, f"""SELECT {TELEMETRY_SQL} FROM tel WHERE miner_id IN
(SELECT 'MNR-' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') FROM customer WHERE c_acctbal > 0)"""))
def filter_by_miners(spark, sf):
    wanted = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(
        F.concat(F.lit("MNR-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("miner_id"))
    return Fi.by_miners(telemetry(spark, sf), wanted).select(*TELEMETRY_COLUMNS)


@query("fil1_filter_by_miner_list", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel WHERE miner_id IN ('MNR-00003', 'MNR-00010')"))
def filter_by_miner_list(spark, sf):
    return Fi.by_miners(telemetry(spark, sf), ["MNR-00003", "MNR-00010"]).select(*TELEMETRY_COLUMNS)


@query("fil2_filter_by_time", sql(TEL, f"""SELECT {TELEMETRY_SQL} FROM tel
WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-12 12:00:00'"""))
def filter_by_time(spark, sf):
    return Fi.by_time(telemetry(spark, sf), "2024-01-05", "2024-01-12 12:00:00").select(*TELEMETRY_COLUMNS)


@query("fil3_miner_ids", sql(TEL, "SELECT DISTINCT miner_id FROM tel ORDER BY 1"))
def miner_ids(spark, sf):
    return Fi.miner_ids(telemetry(spark, sf))


@query("fil4_time_range", "SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def time_range(spark, sf):
    return Fi.time_range(telemetry(spark, sf))


@query("fil5_alive_rows", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel WHERE hashrate_th > 1 AND voltage_v > 0.05e0"))
def alive_rows(spark, sf):
    return Fi.alive_rows(telemetry(spark, sf)).select(*TELEMETRY_COLUMNS)


@query("fil5_alive_report", sql(TEL, f"""
SELECT n_rows, n_dropped, {g('100e0 * n_dropped / n_rows')} AS dropped_pct FROM (SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE NOT coalesce(hashrate_th > 1 AND voltage_v > 0.05e0, false)) AS n_dropped FROM tel) t"""))
def alive_report(spark, sf):
    return gridded(Fi.alive_report(telemetry(spark, sf)), ["dropped_pct"])


@query("fil6_alive_dead_split", sql(TEL, """
SELECT event_id, miner_id, failure_type, coalesce(hashrate_th > 1 AND voltage_v > 0.05e0, false) AS alive
FROM tel WHERE failure_type <> 'none'"""))
def alive_dead_split(spark, sf):
    return Fi.alive_dead_split(telemetry(spark, sf)).select("event_id", "miner_id", "failure_type", "alive")


@query("fil7_scope_by_failure_type", sql(TEL, f"""SELECT {TELEMETRY_SQL} FROM tel
WHERE failure_type IN ('none', 'fan_stall', 'thermal_runaway')"""))
def scope_by_failure_type(spark, sf):
    return Fi.scope_failure_types(telemetry(spark, sf), ["fan_stall", "thermal_runaway"]).select(*TELEMETRY_COLUMNS)


@query("fil8_subsample_miners", sql(TEL, """
, tr AS (SELECT * FROM tel WHERE "timestamp" < TIMESTAMP '2024-01-15'), te AS (SELECT * FROM tel WHERE "timestamp" >= TIMESTAMP '2024-01-15'),
fleet AS (SELECT miner_id, arg_min(model, ("timestamp", event_id)) AS model FROM tr GROUP BY miner_id),
failing AS (SELECT DISTINCT f.* FROM fleet f JOIN te ON f.miner_id = te.miner_id WHERE te.failure_type <> 'none'),
firsts AS (SELECT model, min(miner_id) AS miner_id FROM failing GROUP BY model ORDER BY miner_id LIMIT 2),
others AS (SELECT model, miner_id FROM failing WHERE miner_id NOT IN (SELECT miner_id FROM firsts) ORDER BY miner_id LIMIT 2),
lead AS (SELECT * FROM (SELECT *, 0 AS tier FROM firsts UNION ALL SELECT *, 1 FROM others) x ORDER BY tier, miner_id LIMIT 2),
unseen AS (SELECT model, min(miner_id) AS miner_id, 2 AS tier FROM fleet WHERE model NOT IN (SELECT model FROM lead) GROUP BY model),
pick AS (SELECT model, miner_id, tier FROM lead UNION ALL SELECT model, miner_id, tier FROM unseen),
al AS (SELECT *, CASE WHEN tier = 2 THEN model ELSE miner_id END AS o FROM pick UNION ALL
  SELECT model, miner_id, 3, miner_id FROM fleet WHERE miner_id NOT IN (SELECT miner_id FROM pick))
SELECT miner_id, model, CASE WHEN tier <= 1 THEN 'failing' WHEN tier = 2 THEN 'model' ELSE 'fill' END AS picked_as
FROM al ORDER BY tier, o, miner_id LIMIT 9"""))
def subsample_miners(spark, sf):
    tel = telemetry(spark, sf)
    cut = F.lit("2024-01-15").cast("timestamp")
    return Fi.subsample_miners(tel.where(F.col("timestamp") < cut), tel.where(F.col("timestamp") >= cut), 9)


@query("fil9_sample_rows", sql(TEL, f"SELECT {TELEMETRY_SQL} FROM tel WHERE substr(md5('42 ' || event_id), 1, 8) < '19999999'"))
def sample_rows(spark, sf):
    return Fi.sample_rows(telemetry(spark, sf), 0.1, ("event_id",)).select(*TELEMETRY_COLUMNS)


@query("fil10_downsample_every_n", sql(TEL, f"""SELECT {TELEMETRY_SQL} FROM tel
QUALIFY (row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp", event_id) - 1) % 7 = 0"""))
def downsample_every_n(spark, sf):
    return Fi.every_nth(ordered(spark, sf), 7).select(*TELEMETRY_COLUMNS)


@query("prj1_feature_columns")
def prj1(spark, sf):
    df = kpi(spark, sf)
    return df.select(*feature_columns(df, ("event_id", "time_slot", "energy_price", "ai_score", "recon_error")))


@query("prj2_align_columns", sql(TEL, """
SELECT event_id, coalesce(power_w, 0e0) AS power_w, 0e0 AS fan_rpm, coalesce(hashrate_th, 0e0) AS hashrate_th FROM tel"""))
def prj2(spark, sf):
    return align_columns(telemetry(spark, sf), ["power_w", "fan_rpm", "hashrate_th"], keep=("event_id",))


# -- order and top-k ---------------------------------------------------------------------

@query("win11_last_n_per_miner", sql(TEL, """
SELECT event_id, miner_id, temperature_c, recency FROM (SELECT *,
  row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, event_id DESC) AS recency FROM tel) t WHERE recency <= 12"""))
def last_n(spark, sf):
    return Fi.last_n_per_miner(telemetry(spark, sf), 12).select("event_id", "miner_id", "temperature_c", "recency")


@query("top2_top_features_per_miner", sql(TEL, f"""
, l AS (SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY miner_id ORDER BY "timestamp" DESC, event_id DESC) = 1),
u AS (UNPIVOT (SELECT miner_id, {", ".join(f'CAST({c} AS DOUBLE) AS {c}' for c in _SENSORS)} FROM l) ON {", ".join(_SENSORS)} INTO NAME feature VALUE "value")
SELECT miner_id, feature, "value", rank FROM (SELECT *, row_number() OVER (PARTITION BY miner_id ORDER BY abs("value") DESC, feature) AS rank FROM u) t
WHERE rank <= 3"""))
def top_features(spark, sf):
    return Fi.top_features_per_miner(telemetry(spark, sf), _SENSORS, 3)


@query("top3_longest_failure_miner", sql(TEL, """
SELECT miner_id, count(*) AS n_pre_failure_rows FROM tel WHERE is_pre_failure GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""))
def longest_failure(spark, sf):
    return Fi.longest_failure_miner(telemetry(spark, sf))


@query("top4_sort", sql(TEL, f'SELECT {TELEMETRY_SQL} FROM tel ORDER BY temperature_c DESC NULLS LAST, event_id LIMIT 100'))
def top4(spark, sf):
    return Fi.sorted_rows(telemetry(spark, sf), F.desc_nulls_last("temperature_c"), "event_id", limit=100).select(*TELEMETRY_COLUMNS)

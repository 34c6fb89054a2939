"""Queries: as-of joins, windows over time, kept summaries, sketches, sessions, clustered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import FEATURES, RATIOS, TEL, g, gridded, kpi, query, sql, telemetry
from fleetlens.catalog.cleaning import TELEMETRY_COLUMNS, TELEMETRY_SQL
from fleetlens.catalog.streams import arrivals
from fleetlens.catalog.summaries import TE_SUM, TE_SUMMARY
from fleetlens.catalog.windows import RATES, rolled, show
from fleetlens.operators import sketches as Sk
from fleetlens.operators.joins import as_of
from fleetlens.operators.kept import refresh_summary
from fleetlens.operators.ordered_scan import positions
from fleetlens.operators.ordering import SLOT, with_time_slot
from fleetlens.operators.time_windows import DAY, WEEK, TimeRoll, time_rolling
from fleetlens.session import scratch_path, stored
from fleetlens.sources.clustered import clustered_rates, write_clustered
from fleetlens.streaming.sessions import known_sessions, live_sessions

# Quotes by the hour, so several share a time; one in ten stands three hours after its reading; some devices have none.
QUOTES_SQL = """
, q0 AS (SELECT miner_id, date_trunc('hour', "timestamp") + CASE WHEN event_id % 10 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS qts,
    energy_price + 0.001e0 * (event_id % 7) AS price, event_id FROM tel WHERE event_id % 5 = 0 AND "position" <> 4),
q AS (SELECT miner_id, qts, arg_max(price, event_id) AS price FROM q0 GROUP BY 1, 2)"""


@query("jon8_as_of_join", sql(TEL, QUOTES_SQL + f"""
SELECT event_id, tel.miner_id, CASE WHEN "timestamp" - qts <= INTERVAL 4 DAY THEN {g('price')} END AS price
FROM tel ASOF LEFT JOIN q ON tel.miner_id = q.miner_id AND tel."timestamp" >= q.qts"""))
def jon8(spark, sf):
    tel = telemetry(spark, sf)
    late = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL '3' HOUR")).otherwise(F.expr("INTERVAL '0' HOUR"))
    quotes = tel.where("event_id % 5 = 0 AND position <> 4").select(
        "miner_id", (F.date_trunc("hour", "timestamp") + late).alias("timestamp"),
        (F.col("energy_price") + 0.001 * (F.col("event_id") % 7)).alias("price"), F.col("event_id").alias("tie"))
    out = as_of(tel, quotes, ["price"], tolerance_s=4 * DAY, tie_break="tie")
    return gridded(out.select("event_id", "miner_id", "price"), ["price"])


# -- windows over time ---------------------------------------------------------------

SPANS = {"1d": (DAY, "INTERVAL 1 DAY"), "7d": (WEEK, "INTERVAL 7 DAY")}
_TIMED = {f"{c}_{k}_{n}": (c, k, s, i) for n, (s, i) in SPANS.items() for c in ("power_w", "temperature_c") for k in ("mean", "std", "min", "max", "count")}
_AGGS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "count": "count"}


def timed_sql(column: str, kind: str, interval: str) -> str:
    over = f'OVER (PARTITION BY miner_id ORDER BY "timestamp" RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW)'
    value = f"CASE WHEN count({column}) {over} >= 2 THEN {_AGGS[kind]}({column}) {over} END"
    return value if kind == "count" else g(value, 4)


@query("win15_time_windows", sql(TEL, "SELECT event_id, miner_id, " + ", ".join(
    f"{timed_sql(c, k, i)} AS {n}" for n, (c, k, _, i) in _TIMED.items()) + " FROM tel"))
def win15(spark, sf):
    rolls = [TimeRoll(k, c, s, n, min_obs=2) for n, (c, k, s, _) in _TIMED.items()]
    out = time_rolling(telemetry(spark, sf), rolls)
    return gridded(out.select("event_id", "miner_id", *_TIMED), {n: 4 for n, (_, k, _, _) in _TIMED.items() if k != "count"})


# -- kept summaries and sketches ---------------------------------------------------------

@query("agg12_kept_summary", sql(TE_SUMMARY, f"""
SELECT miner_id, model, {", ".join(f"{g(c, d)} AS {c}" for c, d in TE_SUM.items())}, max_temp, failure_type, n_readings FROM tes"""))
def agg12(spark, sf):
    """A summary of a table that lacks a day and has a wrong one, brought up to date with the table as it is."""
    tel, root = telemetry(spark, sf), scratch_path(spark, "kept")
    day = F.to_date("timestamp")
    wrong = tel.where(day != "2024-01-20").withColumn("power_w", F.when(day == "2024-01-10", F.col("power_w") * 2).otherwise(F.col("power_w")))
    refresh_summary(wrong, root)
    return gridded(refresh_summary(tel, root)[0], TE_SUM)


def sketched(spark, sf):
    healthy = telemetry(spark, sf).where("failure_type = 'none'").withColumn("day", F.to_date("timestamp"))
    return healthy, stored(Sk.day_sketches(healthy, "power_w", "event_id"), scratch_path(spark, "sketches"))


@query("agg13_sketch_percentile", sql(TEL, f"""
SELECT {g('quantile_cont(power_w, 0.95e0)', 4)} AS p95 FROM tel WHERE failure_type = 'none'"""))
def agg13(spark, sf):
    healthy, sketches = sketched(spark, sf)
    return gridded(Sk.refined_percentile(healthy, sketches, "power_w", 0.95, "p95"), ["p95"], 4)


@query("agg13_sketch_bounds", "WITH m AS (SELECT DISTINCT user_id % 4 AS k FROM events), r(what) AS (VALUES ('rank 0.5'), ('rank 0.9'), ('rank 0.99'), ('distinct')) "
       "SELECT ['Pro', 'M56S', 'M63', 'XP'][CAST(k + 1 AS INTEGER)] AS model, what, true AS within FROM m, r")
def agg13_bounds(spark, sf):
    """Are the merged sketches of each hardware model as near to the exact answers as they promise?"""
    healthy, sketches = sketched(spark, sf)
    models = healthy.select("miner_id", "model").distinct()
    by_model = stored(Sk.merged(sketches.join(models, "miner_id"), "model"), scratch_path(spark, "merged"))
    ranks = (0.5, 0.9, 0.99)
    known = by_model.select("model", Sk.distinct("distinct").alias("d"), *[Sk.quantile("quantiles", r).alias(f"q{i}") for i, r in enumerate(ranks)])
    seen = healthy.join(known, "model").groupBy("model").agg(
        F.count("power_w").alias("n"), F.count_distinct("event_id").alias("exact"), F.first("d").alias("d"),
        *[F.count_if(F.col("power_w") < F.col(f"q{i}")).alias(f"lo{i}") for i in range(3)], *[F.count_if(F.col("power_w") <= F.col(f"q{i}")).alias(f"hi{i}") for i in range(3)])
    near = [F.struct(F.lit(f"rank {r}").alias("what"), (
        (F.col(f"lo{i}") <= (r + Sk.RANK_ERROR) * F.col("n") + 1) & (F.col(f"hi{i}") >= (r - Sk.RANK_ERROR) * F.col("n") - 1)).alias("within")) for i, r in enumerate(ranks)]
    near.append(F.struct(F.lit("distinct").alias("what"), (F.abs(F.col("d") - F.col("exact")) <= 0.08 * F.col("exact")).alias("within")))
    return seen.select("model", F.inline(F.array(*near)))


# -- sessions on a stream ------------------------------------------------------------------

# Some readings come one arrival late, which is in time; some come long after.
BATCHES = ("CASE WHEN event_id % 31 = 0 AND ts < TIMESTAMP '2024-01-15 00:00:00' THEN 3 "
           "WHEN event_id % 37 = 0 AND ts >= TIMESTAMP '2024-01-19 12:00:00' THEN 2 "
           "WHEN ts < TIMESTAMP '2024-01-10 12:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-20 12:00:00' THEN 1 ELSE 2 END")
GAP_S, DELAY_S = 43_200, 2 * DAY
SESSIONS_SQL = TEL + f""",
b AS (SELECT event_id, {BATCHES} AS batch FROM events),
x AS (SELECT tel.*, batch FROM tel JOIN b USING (event_id)),
m AS (SELECT max("timestamp") FILTER (WHERE batch = 0) AS m0, max("timestamp") FILTER (WHERE batch <= 1) AS m1, max("timestamp") FILTER (WHERE batch <= 2) AS m2 FROM x),
y AS (SELECT x.*, coalesce("timestamp" < CASE batch WHEN 1 THEN m0 WHEN 2 THEN m1 WHEN 3 THEN m2 END - INTERVAL 2 DAY, false) AS late, m2 FROM x, m),
o AS (SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM y WHERE NOT late
      WINDOW w AS (PARTITION BY miner_id ORDER BY "timestamp", event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY miner_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) AS no FROM o)"""


def session_stream(spark, sf):
    root = scratch_path(spark, "str9")
    for stream in arrivals(spark, sf, f"{root}/arrivals", [f"{BATCHES} = {k}" for k in range(4)]):
        live_sessions(stream, root, GAP_S, DELAY_S)
    return root


@query("str9_live_sessions", sql(SESSIONS_SQL, f"""
SELECT miner_id, min("timestamp") AS start_ts, max("timestamp") AS end_ts, count(*) AS n_rows, {g('sum(power_w)', 2)} AS total,
  max("timestamp") + INTERVAL 12 HOUR >= max(m2) - INTERVAL 2 DAY AS is_open FROM n GROUP BY miner_id, no"""))
def str9(spark, sf):
    return gridded(known_sessions(spark, session_stream(spark, sf)), ["total"], 2)


@query("str9_late_rows", sql(SESSIONS_SQL, "SELECT event_id, miner_id, batch FROM y WHERE late"))
def str9_late(spark, sf):
    return spark.read.parquet(f"{session_stream(spark, sf)}/late").select("event_id", "miner_id", "batch")


# -- clustered table, order --------------------------------------------------------------------

@query("snk7_clustered_rates", sql(RATIOS, rolled(RATES)))
def snk7(spark, sf):
    rows = with_time_slot(kpi(spark, sf).drop(SLOT), rows_per_slot=16)
    write_clustered(rows, "telemetry_clustered", 1, list(FEATURES.rate_columns), buckets=8, path=scratch_path(spark, "snk7"))
    return show(clustered_rates(spark, "telemetry_clustered", list(FEATURES.rate_columns)), list(RATES))


@query("top4_sort_whole", sql(TEL, f"""
SELECT {TELEMETRY_SQL}, row_number() OVER (ORDER BY miner_id, "timestamp", event_id) - 1 AS pos FROM tel"""))
def top4_whole(spark, sf):
    return positions(telemetry(spark, sf).select(*TELEMETRY_COLUMNS), [F.asc("miner_id"), F.asc("timestamp"), F.asc("event_id")])

"""A spread of catalog queries against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import TABLES, rows_of  # noqa: E402

from fleetlens.catalog import load  # noqa: E402

NAMES = [
    "cln1_ffill_limited", "cln5_preprocess", "kpi5_te_all", "jon6_phase_range_join", "jon7_maintenance_range_join",
    "win6_rolling_corr", "win7_autocorr_lag1", "win12_phase_runs", "win13_sequence_windows", "peer3_container_rank",
    "agg2_te_summary", "agg5_crosstab_margins", "spl2_split_by_positives", "eva2_auc_roc", "thr4_thr_f1_with_floor",
    "tml1_detection_timeline", "rsk1_risk_escalation", "ctl6_safety_guard", "alr1_alerts", "str4_live_risk",
    "str5_live_control", "fil8_subsample_miners", "snk2_ingest_append",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    queries, oracles = load()
    df = queries[name](spark, sf)
    cur = con.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_every_query_is_callable_and_every_sql_has_one():
    queries, oracles = load()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())

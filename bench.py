"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetlens.catalog import load  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

HEADLINE = [
    "agg2_te_summary", "cln5_preprocess", "kpi5_te_all", "win14_feature_matrix", "win1_rolling_stats",
    "win1_long_windows_by_supplier", "win1_long_windows_by_status", "win13_sequence_windows", "peer3_container_rank",
    "spl2_split_by_positives", "eva3_auc_pr", "thr4_thr_f1_with_floor", "tml1_detection_timeline",
    "rsk1_risk_escalation", "ctl6_safety_guard", "alr1_alerts", "agg9_fleet_kpis", "win12_phase_runs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    spark.read.parquet(f"{sf}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

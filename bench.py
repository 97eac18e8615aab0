"""Time the headline queries; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; median reported after one warm-up run),
BENCH_QUERIES (comma list, or "all" for every registered query).
Each query runs to completion into Spark's ``noop`` sink (no collect);
``daily_run_write`` writes all six marts for one day as Parquet below the
session's checkpoint dir (BENCH_DAILY_RUN=0 skips it).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline import registry  # noqa: E402
from ledgerline.oracle import D_EVENTS  # noqa: E402
from ledgerline.plans import daily_run  # noqa: E402
from ledgerline.session import build_session, fresh_path  # noqa: E402
from ledgerline.sources import finance  # noqa: E402
from ledgerline.sources.tables import TableSet  # noqa: E402

HEADLINE = [
    "asset_holdings_asof", "portfolio_day_stats", "user_cashflow", "budget_performance",
    "asset_price_summary", "goal_progress", "access_matrix", "snapshot_retention",
    "orphan_files", "compaction_plan", "window_first_asc", "join_left_chain",
    "compact_table", "access_matrix_from_listings",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    keys = sorted(registry.QUERIES) if wanted == "all" else [k for k in wanted.split(",") if k]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": "8g",
                                 "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024)})
    def timed(action):
        action()                                   # warm-up
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            action()
            runs.append(time.perf_counter() - t0)
        return round(statistics.median(runs), 4)

    def write_day():
        # the original's main job: all six marts written for one day
        src = finance.from_tables(TableSet(spark, sf_dir))
        daily_run.run_daily(src, fresh_path(spark, "bench-marts"), D_EVENTS, idempotent=True)

    actions = {k: (lambda q=registry.QUERIES[k]:
                   q(spark, sf_dir).write.format("noop").mode("overwrite").save()) for k in keys}
    if os.environ.get("BENCH_DAILY_RUN", "1") == "1":
        actions["daily_run_write"] = write_day
    times, errors = {}, {}
    for k, action in actions.items():
        try:
            times[k] = timed(action)
        except Exception as e:                     # keep reporting the others
            errors[k] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

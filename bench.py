"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boutwise.catalog import QUERIES
from boutwise.session import build_session

HEADLINES = [
    "j01_build_master", "e17_feature_table", "e26_elo_period", "e01_rolling_win_rate", "e06_matches_last_14d", "e09_rolling_metric20",
    "e11_h2h", "c05_join_pred_odds", "c07_h2h_asof", "c11_resolve_entities", "b16_remove_overround", "d02_market_consensus",
    "d10_conformal_radius", "e20_allocate_daily", "e21_odds_movement", "h09_ensemble_sweep", "j06_backtest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e15_matches_before"](spark, folder).write.format("noop").mode("overwrite").save()  # start workers and compile
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

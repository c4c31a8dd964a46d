"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up (class loading, generated code, file listing) and then
once timed; the result goes to a sink that reads every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from closeline import plans, session  # noqa: E402

HEADLINE = (
    "backtest_verdict",          # quotes to verdict per market and tier
    "best_price_per_wager",      # one quote per wager
    "devig_power",               # margin removal, pair by pair
    "roi_by_market_and_tier",    # clustered intervals, all groupings
    "brier_comparison",          # model against market
    "calibration_by_decile",
    "wager_census",              # distinct wagers, raw and folded
    "strict_past_cut",           # rows before a day
    "rating_input",              # rating input preparation
    "prior_expanding_mean",      # leakage-free history
    "trailing_evidence",         # player subjects of a day
    "settlement",                # grading of every quote
    "fair_board",                # consensus and best price
    "survival_counts",           # capture to capture
    "quote_json_staging",        # nested feed to rows
    "name_to_id_join",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", app="bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    registry = plans.queries()
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            began = time.perf_counter()
            registry[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()

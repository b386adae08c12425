"""Headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line.

Each report runs once to warm up and three times for the median; results go to the no-op sink, so
every row is computed and none is fetched.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from playtrail.plans.catalog import reports  # noqa: E402
from playtrail.session import local_session  # noqa: E402

HEADLINE = (
    "flat_events",
    "level_analysis_raw",
    "user_cohort",
    "rewarded_ads",
    "rewarded_ads_week",
    "rewarded_ads_totals",
    "level_analysis",
    "level_analysis_week",
    "silver_boost",
    "unit_loadout",
    "unit_upgrades",
    "churn",
    "booster_boxes",
    "base_station",
    "overall_stats",
    "available_countries",
    "available_versions",
    "overview",
    "rewarded_ads_cohort_all",
    "rewarded_ads_cohort_week",
    "ad_impressions_by_format",
    "cohort_cells",
    "user_level_progression",
    "user_level_progression_one",
    "time_to_n_levels",
    "time_to_n_levels_from_first",
    "milestone_summary",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    catalog = reports()

    def once(name: str) -> float:
        began = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median report times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()

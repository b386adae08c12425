"""Literal join forms against the rewrites at $BENCH_SF_DIR: prints one JSON line of median
seconds, after one warm-up run each."""

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.join(HERE, "tests")]

import literal  # noqa: E402

from playtrail.operators import boost, churn, journey, retention  # noqa: E402
from playtrail.session import local_session  # noqa: E402
from playtrail.sources.sample_tables import sample_events  # noqa: E402

ADS = "RV_Watched_%"
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def newest(events):
    return journey._numbered(events, 1, journey.DISTINCT_LEVELS, loadouts=True)


PAIRS = {
    "boost join": (literal.level_with_boost, boost.level_with_boost),
    "level-reach join": (literal.level_reach, churn.level_reach),
    "as-of join": (literal.completion_loadouts, newest),
    "cohort matrix": (
        lambda ev: literal.cohort_matrix(ev, ADS),
        lambda ev: retention.rewarded_ads_cohort(ev, ADS),
    ),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "4")), "rewrites")

    def once(build) -> float:
        began = time.perf_counter()
        build(sample_events(spark, sf_dir, False)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    found = {}
    for name, forms in PAIRS.items():
        for label, build in zip(("literal", "rewritten"), forms):
            once(build)
            found.setdefault(name, {})[label] = round(
                statistics.median(once(build) for _ in range(RUNS)), 3
            )
            print(name, label, found[name][label], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps(found))


if __name__ == "__main__":
    main()

"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from playtrail.operators import ads, churn, journey, levels, overview, retention
from playtrail.operators.filters import Filters
from playtrail.plans.catalog import reports
from playtrail.sources.events import read_flat_events, write_flat_events
from playtrail.sources.sample_tables import sample_events

SF = "/root/testdata/sf0.001"
WEEK = Filters("2024-01-01", "2024-01-05")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "flat")
    write_flat_events(sample_events(spark, SF), path, "whole")
    return read_flat_events(spark, path)


@pytest.mark.parametrize("name", sorted(reports()))
def test_no_pairwise_joins_no_row_copies_no_python(spark, name):
    plan = plan_of(reports()[name](spark, SF))
    for node in ("NestedLoopJoin", "CartesianProduct", "Expand", "Python", "Pandas"):
        assert node not in plan


# Windows that see every row at once are allowed on the per-level table, the cells of one matrix
# the 20 ranked loadouts, and the rows of the ad table.
SMALL_WINDOWS = {
    "churn",
    "churn_all",
    "churn_country",
    "churn_week",
    "max_churn_level",
    "level_reach",
    "level_retention",
    "cohort_cells",
    "top_loadouts_clean",
    "rewarded_ads_with_totals",
    "rewarded_ads_with_totals_week",
}


def test_only_small_tables_meet_in_one_window(spark):
    found = set()
    for name, report in reports().items():
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan_of(report(spark, SF))):
            if re.match(r"[\w#]+ (ASC|DESC)|specifiedwindowframe", spec):
                found.add(name)
    assert found == SMALL_WINDOWS


def test_no_window_per_user_on_events(spark, setting):
    """The events of one user are only ever ordered within a slice."""
    setting(autoBroadcastJoinThreshold="-1")
    for name in ("time_to_n_levels", "user_level_progression", "milestone_summary"):
        plan = plan_of(reports()[name](spark, SF))
        top = plan.split("SortMergeJoin")[0]
        assert re.search(r"hashpartitioning\(user_pseudo_id#\d+, slice#\d+L", top)
        for keys in re.findall(r"windowspecdefinition\((user_pseudo_id#\d+L?, \w+)", top):
            assert "slice" in keys


def test_completions_are_hash_aggregated(spark):
    assert "SortAggregate" not in plan_of(reports()["milestone_summary"](spark, SF))
    assert "SortAggregate" not in plan_of(reports()["level_analysis"](spark, SF))


def test_dates_prune_partitions(stored):
    plan = plan_of(ads.rewarded_ads_by_install(stored, WEEK))
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ <= 2024-01-05\)\]", plan)
    dated = plan_of(ads.rewarded_ads(stored, WEEK))
    assert re.search(r"PartitionFilters: [^\]]*>= 2024-01-01\), \(event_date#\d+ <= 2024-01-05", dated)
    matrix = plan_of(retention.rewarded_ads_cohort(stored, "RV_Watched_%", WEEK))
    assert re.search(r"event_date#\d+ >= 2024-01-01\), \(event_date#\d+ <= 2024-04-04\)", matrix)


def test_names_and_prefixes_are_pushed(spark, setting, stored):
    setting(maxMetadataStringLength="1000")
    assert "StringStartsWith(event_name,RV)" in plan_of(ads.rewarded_ads_by_install(stored))
    plan = plan_of(levels.level_analysis(stored))
    assert "In(event_name, [level_complete,level_fail])" in plan
    assert re.search(r"ReadSchema: struct<[^>]*>", plan)[0] == (
        "ReadSchema: struct<user_pseudo_id:string,event_name:string,level:bigint,"
        "duration_seconds:double>"
    )


def test_one_scan_per_report(stored):
    for report in (levels.level_analysis(stored), churn.churn(stored)):
        assert plan_of(report).count("FileScan") == 1


def test_cohort_is_broadcast_only_when_small(spark, setting, stored):
    setting(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    report = levels.level_analysis(stored, WEEK)
    before = sorted(tuple(r) for r in report.collect())
    assert "SortMergeJoin" in plan_of(report) and "BroadcastHashJoin" not in plan_of(report)
    setting(autoBroadcastJoinThreshold="10MB")
    again = levels.level_analysis(stored, WEEK)
    assert "BroadcastHashJoin" in plan_of(again)
    assert sorted(tuple(r) for r in again.collect()) == before


def test_a_hot_user_is_spread(spark, stored):
    """One user with nine tenths of the completions: no partition of the ordering step holds more
    than one slice of them."""
    hot = F.when(F.rand(1) < 0.9, F.lit("hot")).otherwise(F.col("user_pseudo_id"))
    events = stored.withColumn("user_pseudo_id", hot)
    numbered = journey.numbered_completions(events, 5, journey.DISTINCT_LEVELS)
    per_slice = numbered.groupBy("user_pseudo_id", "slice").count().agg(F.max("count")).first()[0]
    total = numbered.count()
    assert total > 100 and per_slice <= 5


def test_a_small_cohort_cuts_the_matrix_at_the_scan(spark, setting, stored):
    """No exchange by user and day holds users outside the cohort."""
    setting(autoBroadcastJoinThreshold="10MB")
    plan = plan_of(retention.rewarded_ads_cohort(stored, "RV_Watched_%", WEEK))
    assert re.search(
        r"hashpartitioning\(user_pseudo_id#\d+, event_date#\d+.*\n.*HashAggregate.*\n"
        r"(.*Project.*\n)?.*BroadcastHashJoin.*LeftSemi",
        plan,
    )


def test_overview_reads_the_log_three_times(spark, stored):
    """Two passes over the events and one over the installs, whose exchange is used again."""
    report = overview.overview(stored, WEEK)
    report.collect()
    final = plan_of(report).split("Initial Plan")[0]
    assert final.count("FileScan") <= 4 and plan_of(overview.overview(stored)).count("FileScan") == 2

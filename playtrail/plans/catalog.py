"""Every report by name, over the sample tables: name -> (spark, sf_dir) -> DataFrame."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.functions.numeric import round2
from playtrail.operators import (
    ads,
    boost,
    churn,
    cohort,
    economy,
    journey,
    levels,
    overview,
    retention,
    units,
)
from playtrail.operators.filters import ALL, Filters, last_week
from playtrail.plans.dashboard import rewarded_ad_drilldown
from playtrail.sources.events import flatten_events
from playtrail.sources.sample_tables import raw_sample_events, sample_events
from playtrail.sources.schema import OLD_BOX_KEY, REWARDED_AD_PATTERN, REWARDED_ADS

Report = Callable[[SparkSession, str], DataFrame]

# Arguments of the registered reports. Sample users complete about 13 levels each, so the journeys
# go to 10 levels instead of 1000.
WEEK = Filters(start="2024-01-01", end="2024-01-05")
WEEK_IOS = Filters(start="2024-01-01", end="2024-01-05", platform="ios")
WEEK_IOS_ANY = Filters(
    start="2024-01-01", end="2024-01-05", platform="ios", cohort_scope="global"
)
ONE_COUNTRY = Filters(country="NATION_8")
EVERY_FILTER = Filters(
    start="2024-01-01", end="2024-01-30", platform="ios", country="NATION_8", version="1.8.0"
)
ONE_VERSION = Filters(platform="android", version="1.5.0")
JOURNEY_LEVELS = 10
JOURNEY_MARKS = (1, 2, 4, 6, 8, 10)
VICTORY_AD = REWARDED_ADS[0]
SEED = "7"


def _level_stats(ev: DataFrame) -> DataFrame:
    stats = levels.level_stats(ev)
    return stats.withColumns(
        {
            name: round2(F.col(name))
            for name in ("avg_duration_complete", "avg_duration_fail")
        }
    )


def _cells(matrix: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return retention.cohort_cells(matrix, by).withColumn("avg_events", round2(F.col("avg_events")))


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    # cohorts
    "user_cohort": lambda ev: cohort.user_cohort(ev, WEEK),
    "user_cohort_filtered": lambda ev: cohort.user_cohort(ev, WEEK_IOS),
    "user_cohort_global": lambda ev: cohort.user_cohort(ev, WEEK_IOS_ANY),
    "user_cohort_all": lambda ev: cohort.user_cohort(ev),
    # rewarded ads
    "rewarded_ads": lambda ev: ads.rewarded_ads(ev),
    "rewarded_ads_week": lambda ev: ads.rewarded_ads(ev, WEEK_IOS),
    "rewarded_ads_country": lambda ev: ads.rewarded_ads(ev, ONE_COUNTRY),
    "rewarded_ads_totals": lambda ev: ads.rewarded_ads_totals(ads.rewarded_ads(ev)),
    "rewarded_ads_totals_week": lambda ev: ads.rewarded_ads_totals(ads.rewarded_ads(ev, WEEK)),
    "rewarded_ads_with_totals": lambda ev: ads.rewarded_ads_with_totals(ev),
    "rewarded_ads_with_totals_week": lambda ev: ads.rewarded_ads_with_totals(ev, WEEK),
    "rewarded_ads_by_install": lambda ev: ads.rewarded_ads_by_install(ev, WEEK_IOS_ANY),
    "rewarded_ads_labels": lambda ev: ads.ad_labels(ads.rewarded_ads(ev)),
    "total_rewarded_ads": lambda ev: ads.total_rewarded_ads(ads.rewarded_ads(ev)),
    "top_rewarded_ads": lambda ev: ads.top_ads(ads.rewarded_ads(ev), 10),
    # levels
    "level_analysis": lambda ev: levels.level_analysis(ev),
    "level_analysis_week": lambda ev: levels.level_analysis(ev, WEEK),
    "level_analysis_version": lambda ev: levels.level_analysis(ev, ONE_VERSION, level_count=10),
    "level_analysis_all": lambda ev: levels.level_analysis(ev, level_count=ALL),
    "level_analysis_last_week": lambda ev: levels.level_analysis(ev, last_week(date(2024, 1, 8))),
    "level_stats": _level_stats,
    "user_attempts": lambda ev: levels.user_attempts(ev),
    "avg_attempts": lambda ev: levels.avg_attempts(ev),
    "average_completion_rate": lambda ev: levels.average_completion_rate(
        levels.level_analysis(ev)
    ),
    "level_chart": lambda ev: levels.level_chart(levels.level_analysis(ev), 20),
    # boost
    "silver_boost": lambda ev: boost.silver_boost(ev),
    "silver_boost_week": lambda ev: boost.silver_boost(ev, WEEK_IOS),
    "level_with_boost": lambda ev: boost.level_with_boost(ev),
    "boost_impact": lambda ev: boost.boost_impact(boost.silver_boost(ev)),
    # units
    "unit_frequency": lambda ev: units.unit_frequency(ev),
    "top_loadouts": lambda ev: units.top_loadouts(ev),
    "top_loadouts_by_hash": lambda ev: units.top_loadouts_by_hash(ev),
    "unit_loadout": lambda ev: units.unit_loadout(ev),
    "unit_loadout_week": lambda ev: units.unit_loadout(ev, WEEK),
    "unit_loadout_level": lambda ev: units.unit_loadout(ev, level="10"),
    "unit_frequency_clean": lambda ev: units.top_units(units.unit_frequency(ev), 15),
    "top_loadouts_clean": lambda ev: units.ranked_loadouts(units.top_loadouts(ev), 20),
    "unit_loadout_units": lambda ev: units.split_unit_loadout(units.unit_loadout(ev))[0],
    "unit_loadout_tops": lambda ev: units.split_unit_loadout(units.unit_loadout(ev))[1],
    "unit_upgrades": lambda ev: units.unit_upgrades(ev),
    "unit_upgrades_week": lambda ev: units.unit_upgrades(ev, WEEK),
    # churn
    "churn": lambda ev: churn.churn(ev),
    "churn_country": lambda ev: churn.churn(ev, ONE_COUNTRY),
    "churn_week": lambda ev: churn.churn(ev, WEEK, level_count=10),
    "churn_all": lambda ev: churn.churn(ev, level_count=ALL),
    "user_max_level": lambda ev: churn.user_max_level(ev),
    "level_reach": lambda ev: churn.level_reach(ev),
    "level_difficulty": lambda ev: churn.level_difficulty(ev),
    "level_retention": lambda ev: churn.level_retention(ev, WEEK),
    "hardest_level": lambda ev: churn.hardest_level(churn.churn(ev)),
    "max_churn_level": lambda ev: churn.max_churn_level(churn.churn(ev)),
    # economy
    "booster_boxes": lambda ev: economy.booster_boxes(ev),
    "booster_boxes_week": lambda ev: economy.booster_boxes(ev, WEEK),
    "base_station": lambda ev: economy.base_station(ev),
    "base_station_week": lambda ev: economy.base_station(ev, WEEK),
    "base_station_skills": lambda ev: economy.base_station_skills(economy.base_station(ev)),
    "base_station_pivot": lambda ev: economy.base_station_pivot(economy.base_station(ev)),
    # overview and filter options
    "overall_stats": lambda ev: overview.overall_stats(ev),
    "overall_stats_week": lambda ev: overview.overall_stats(ev, WEEK_IOS),
    "overall_stats_every_filter": lambda ev: overview.overall_stats(ev, EVERY_FILTER),
    "available_countries": lambda ev: overview.available_countries(ev),
    "available_countries_week": lambda ev: overview.available_countries(ev, WEEK_IOS),
    "available_countries_by_event_date": lambda ev: overview.available_countries(
        ev, WEEK, mode="event_date"
    ),
    "available_versions": lambda ev: overview.available_versions(ev),
    "available_versions_week": lambda ev: overview.available_versions(ev, WEEK_IOS),
    "available_versions_by_event_date": lambda ev: overview.available_versions(
        ev, WEEK, mode="event_date"
    ),
    "overview": lambda ev: overview.overview(ev, WEEK),
    # cohort matrices
    "rewarded_ads_cohort": lambda ev: retention.rewarded_ads_cohort(ev, VICTORY_AD),
    "rewarded_ads_cohort_all": lambda ev: retention.rewarded_ads_cohort(ev, REWARDED_AD_PATTERN),
    "rewarded_ads_cohort_week": lambda ev: retention.rewarded_ads_cohort(
        ev, REWARDED_AD_PATTERN, WEEK_IOS
    ),
    "rewarded_ads_cohort_every_filter": lambda ev: retention.rewarded_ads_cohort(
        ev, REWARDED_AD_PATTERN, EVERY_FILTER
    ),
    "rewarded_ads_cohort_all_days": lambda ev: retention.rewarded_ads_cohort(
        ev, REWARDED_AD_PATTERN, limit=ALL
    ),
    "rewarded_ad_drilldown": lambda ev: rewarded_ad_drilldown(ev, VICTORY_AD, WEEK),
    "ad_impressions_inter": lambda ev: retention.ad_impressions_cohort(ev, "INTER"),
    "ad_impressions_rewarded": lambda ev: retention.ad_impressions_cohort(ev, "REWARDED", WEEK),
    "ad_impressions_by_format": lambda ev: retention.ad_impressions_by_format(ev),
    "cohort_cells": lambda ev: _cells(retention.rewarded_ads_cohort(ev, REWARDED_AD_PATTERN)),
    "ad_impression_cells": lambda ev: _cells(
        retention.ad_impressions_by_format(ev), ("ad_format",)
    ),
    # journeys
    "qualified_distinct_levels": lambda ev: journey.qualified_users(
        ev, JOURNEY_LEVELS, journey.DISTINCT_LEVELS
    ),
    "qualified_completions": lambda ev: journey.qualified_users(
        ev, JOURNEY_LEVELS, journey.COMPLETIONS
    ),
    "qualified_from_first": lambda ev: journey.qualified_users(
        ev, JOURNEY_LEVELS, journey.FROM_FIRST
    ),
    "picked_user": lambda ev: journey.pick_users(
        journey.qualified_users(ev, JOURNEY_LEVELS, journey.DISTINCT_LEVELS), 1, SEED
    ),
    "user_level_progression": lambda ev: journey.user_level_progression(ev, JOURNEY_LEVELS),
    "user_level_progression_one": lambda ev: journey.user_level_progression(
        ev, JOURNEY_LEVELS, sample=1, seed=SEED
    ),
    "time_to_n_levels": lambda ev: journey.time_to_n_levels(ev, JOURNEY_LEVELS),
    "time_to_n_levels_from_first": lambda ev: journey.time_to_n_levels_from_first(
        ev, JOURNEY_LEVELS
    ),
    "milestone_summary": lambda ev: journey.milestone_summary(
        ev, JOURNEY_LEVELS, JOURNEY_MARKS
    ),
}


# Reports from the nested form: parameters are taken out of the bag of every event first.
RAW_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "flat_events": lambda ev: ev,
    "level_analysis_raw": REPORTS["level_analysis"],
    "time_to_n_levels_raw": REPORTS["time_to_n_levels"],
}


def _flat(report: Callable[[DataFrame], DataFrame]) -> Report:
    return lambda spark, sf_dir: report(sample_events(spark, sf_dir))


def _nested(report: Callable[[DataFrame], DataFrame]) -> Report:
    return lambda spark, sf_dir: report(flatten_events(raw_sample_events(spark, sf_dir)))


def _old_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = raw_sample_events(spark, sf_dir, OLD_BOX_KEY)
    return economy.booster_boxes(flatten_events(nested, OLD_BOX_KEY))


def reports() -> dict[str, Report]:
    return (
        {name: _nested(report) for name, report in RAW_REPORTS.items()}
        | {"booster_boxes_old_key": _old_boxes}
        | {name: _flat(report) for name, report in REPORTS.items()}
    )

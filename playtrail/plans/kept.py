"""Registered queries over tables that the library keeps beside the log. Each fills its tables from
the whole sample log, in several loads, and reads the result back from them."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.operators import cohort, overview, retention
from playtrail.plans import oracle as sql
from playtrail.plans.catalog import (
    JOURNEY_LEVELS,
    WEEK,
    WEEK_IOS,
)
from playtrail.plans.shared import shared_dashboard
from playtrail.session import scratch
from playtrail.sources import activity, events, installs, journeys, loads, shards, sketches
from playtrail.sources.sample_tables import raw_sample_events, sample_events
from playtrail.sources.schema import REWARDED_AD_PATTERN, USER

Query = Callable[[SparkSession, str], DataFrame]
LOADS = 4


def _filled(spark: SparkSession, sf_dir: str, name: str, update) -> str:
    """A table that `update` has filled in four loads."""
    path, log = scratch(spark, name), sample_events(spark, sf_dir)
    for k in range(LOADS):
        update(log.filter(F.col("event_id") % LOADS == k), path, f"load-{k}")
    return path


def _corrected_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged loads, one of which then comes again with the first half of each month only."""
    path = _filled(spark, sf_dir, "flat", events.write_flat_events)
    loads.merge_loads(spark, path)
    again = sample_events(spark, sf_dir).filter(F.col("event_id") % LOADS == 2)
    events.write_flat_events(again.filter(F.day("event_date") <= 15), path, "load-2")
    return events.read_flat_events(spark, path)


def _loads_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _filled(spark, sf_dir, "flat", events.write_flat_events)
    loads.merge_loads(spark, path)
    return loads.loads(spark, path)


def _by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of a log whose events lie up to nine days off their day."""
    root = scratch(spark, "raw")
    log = raw_sample_events(spark, sf_dir)
    late = F.date_add("event_date", (F.col("event_id") % 10).cast("int"))
    log.withColumn("event_date", late).repartition("event_date").write.partitionBy(
        "event_date"
    ).parquet(f"{root}/log")
    shards.update_bounds(spark, f"{root}/log", f"{root}/bounds")
    found = events.read_events(
        spark, f"{root}/log", date(2024, 1, 3), date(2024, 1, 4), bounds=f"{root}/bounds"
    )
    return events.flatten_events(found)


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _filled(spark, sf_dir, "installs", installs.update_installs)
    return cohort.user_cohort(installs.read_installs(spark, path), WEEK_IOS)


def _approx_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact users of each country, and whether the estimate is within three standard errors."""
    path = _filled(spark, sf_dir, "sketches", sketches.update_sketches)
    estimated = sketches.approx_users(sketches.read_sketches(spark, path), by="country")
    exact = overview.available_countries(sample_events(spark, sf_dir), limit="all")
    error = F.abs(F.col("approx_users") - F.col("user_count"))
    bound = F.greatest(F.lit(1.0), F.col("user_count") * (3 * 0.83 / 2 ** (sketches.LOG_SIZE / 2)))
    return exact.join(estimated, "country").select(
        "country", "user_count", (error <= bound).alias("within_bound")
    )


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "activity")
    name = "activity_" + path.rsplit("-", 1)[1]
    return activity.write_activity(sample_events(spark, sf_dir), name, path, 16)


def _page(name: str, **arguments) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shared_dashboard(sample_events(spark, sf_dir), **arguments)[name]

    return query


def _kept_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in loads of days, and a last one with the events that came late."""
    path, log = scratch(spark, "journeys"), sample_events(spark, sf_dir)
    is_late, day = F.col("event_id") % 20 == 0, F.day("event_date")
    parts = [~is_late & (day <= 10), ~is_late & (day > 10), is_late]
    seen = F.lit(False)
    for k, part in enumerate(parts):
        seen = seen | part
        load = log.filter(part)
        journeys.update_journeys(load, log.filter(seen), path, f"load-{k}", JOURNEY_LEVELS)
    return journeys.read_journeys(spark, path)


KEPT: dict[str, Query] = {
    "corrected_loads": _corrected_loads,
    "loads_list": _loads_list,
    "events_by_bounds": _by_bounds,
    "cohort_from_installs": _cohort,
    "approx_users_by_country": _approx_countries,
    "rewarded_ads_cohort_activity": lambda spark, sf_dir: retention.rewarded_ads_cohort(
        _activity(spark, sf_dir), REWARDED_AD_PATTERN
    ),
    "ad_impressions_activity": lambda spark, sf_dir: retention.ad_impressions_by_format(
        _activity(spark, sf_dir)
    ),
    "page_rewarded_ads": _page("rewarded_ads", filters=WEEK_IOS),
    "page_level_analysis": _page("level_analysis", filters=WEEK),
    "page_silver_boost": _page("silver_boost", filters=WEEK_IOS),
    "page_unit_loadout": _page("unit_loadout", filters=WEEK),
    "page_unit_upgrades": _page("unit_upgrades", filters=WEEK),
    "page_churn": _page("churn", filters=WEEK, level_count=10),
    "page_base_station": _page("base_station", filters=WEEK),
    "page_overall_stats": _page("overall_stats", filters=WEEK_IOS),
    "page_available_countries": _page("available_countries", filters=WEEK_IOS),
    "kept_time_to_n_levels": _kept_journeys,
}

# Kept tables give what the log gives: the SQL is that of the report over the log.
SAME = {
    "cohort_from_installs": "user_cohort_filtered",
    "rewarded_ads_cohort_activity": "rewarded_ads_cohort_all",
    "ad_impressions_activity": "ad_impressions_by_format",
    "page_rewarded_ads": "rewarded_ads_week",
    "page_level_analysis": "level_analysis_week",
    "page_silver_boost": "silver_boost_week",
    "page_unit_loadout": "unit_loadout_week",
    "page_unit_upgrades": "unit_upgrades_week",
    "page_churn": "churn_week",
    "page_base_station": "base_station_week",
    "page_overall_stats": "overall_stats_week",
    "page_available_countries": "available_countries_week",
    "kept_time_to_n_levels": "time_to_n_levels",
}


def kept_oracle() -> dict[str, str]:
    of_log = sql.oracle()
    return {name: of_log[report] for name, report in SAME.items()} | {
        "corrected_loads": sql.sql(
            f"SELECT * FROM ev WHERE event_id % {LOADS} <> 2 OR day(event_date) <= 15"
        ),
        "loads_list": sql.sql(
            f"""SELECT event_date, 'load-' || (event_id % {LOADS}) AS load_id, TRUE AS merged,
                count(*) AS rows FROM ev GROUP BY ALL"""
        ),
        "events_by_bounds": sql.sql(
            "SELECT * FROM ev WHERE event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-04'"
        ),
        "approx_users_by_country": sql.sql(
            f"""SELECT country, count(DISTINCT {USER}) AS user_count, TRUE AS within_bound
                FROM ev WHERE country IS NOT NULL GROUP BY country"""
        ),
    }

"""Totals, filter options and the overview row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators.cohort import keep_cohort
from playtrail.operators.filters import Filters, first_rows, name_matches
from playtrail.operators.levels import average_completion_rate, level_analysis
from playtrail.operators.weights import number
from playtrail.sources.schema import (
    BOX_OPENED,
    LEVEL_COMPLETE,
    LEVEL_FAIL,
    LEVEL_START,
    REWARDED_AD_PATTERN,
    UNIT_UPGRADE,
    USER,
)

OPTION_MODES = ("cohort", "event_date")


def overall_stats(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row of totals; zeros when there is no event."""
    name = F.col("event_name")
    wanted = {
        "users_who_played": name == LEVEL_START,
        "total_rewarded_ads": name_matches(REWARDED_AD_PATTERN),
        "total_level_completions": name == LEVEL_COMPLETE,
        "total_level_failures": name == LEVEL_FAIL,
        "total_unit_upgrades": name == UNIT_UPGRADE,
        "total_booster_boxes_opened": name == BOX_OPENED,
    }
    # A row per user makes both distinct counts plain counts; several distincts in one aggregate
    # would copy every event once per distinct.
    per_user = (
        filters.on_attributes(events)
        .groupBy(USER)
        .agg(*[number(events, test).alias(label) for label, test in wanted.items()])
    )
    kept = keep_cohort(per_user, events, filters)
    sums = [
        F.coalesce(F.sum(label), F.lit(0)).alias(label)
        for label in wanted
        if label != "users_who_played"
    ]
    return kept.agg(
        F.count(USER).alias("total_users"),
        F.count(F.when(F.col("users_who_played") > 0, F.col(USER))).alias("users_who_played"),
        *sums,
    )


def _options(events: DataFrame, filters: Filters, column: str, mode: str) -> DataFrame:
    if mode not in OPTION_MODES:
        raise ValueError(f"mode must be one of {OPTION_MODES}")
    others = filters.without(column)
    seen = others.on_attributes(events.filter(F.col(column).isNotNull()))
    if mode == "event_date":
        pairs = others.on_event_date(seen).select(USER, column).distinct()
    else:
        pairs = keep_cohort(seen.select(USER, column).distinct(), events, others)
    return pairs.groupBy(column).agg(F.count(USER).alias("user_count"))


def available_countries(
    events: DataFrame, filters: Filters = Filters(), mode: str = "cohort", limit: int | str = 100
) -> DataFrame:
    """Countries by number of users. The dates select installs, or events in the older mode
    'event_date'."""
    options = _options(events, filters, "country", mode)
    return first_rows(options.orderBy(F.desc("user_count"), "country"), limit, 100)


def available_versions(
    events: DataFrame, filters: Filters = Filters(), mode: str = "cohort", limit: int | str = 50
) -> DataFrame:
    """Versions with their users, in falling text order ('1.9' above '1.10')."""
    options = _options(events, filters, "version", mode)
    return first_rows(options.orderBy(F.desc("version")), limit, 50)


def overview(
    events: DataFrame, filters: Filters = Filters(), level_count: int | str | None = 50
) -> DataFrame:
    """The four headline numbers in one row. One pass per user counts the users, their completions
    and, on the days in range, their rewarded ads; the completion rate per level takes another."""
    name, on_day = F.col("event_name"), F.lit(True)
    if filters.has_cohort:
        on_day = F.col("event_date").between(F.lit(filters.start), F.lit(filters.end))
    per_user = (
        filters.on_attributes(events)
        .groupBy(USER)
        .agg(
            number(events, name_matches(REWARDED_AD_PATTERN) & on_day).alias("ads"),
            number(events, name == LEVEL_COMPLETE).alias("completions"),
        )
    )
    totals = keep_cohort(per_user, events, filters).agg(
        F.count(USER).alias("total_users"),
        F.coalesce(F.sum("ads"), F.lit(0)).alias("total_rewarded_ads"),
        F.coalesce(F.sum("completions"), F.lit(0)).alias("total_level_completions"),
    )
    rate = average_completion_rate(level_analysis(events, filters, level_count))
    return totals.select(
        "total_users",
        "total_rewarded_ads",
        rate.scalar().alias("avg_completion_rate"),
        "total_level_completions",
    )

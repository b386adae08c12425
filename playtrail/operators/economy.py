"""Booster boxes and base-station upgrades."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.numeric import ratio2
from playtrail.operators.cohort import keep_cohort
from playtrail.operators.filters import Filters
from playtrail.operators.weights import number
from playtrail.sources.schema import BASE_UPGRADE, BOX_OPENED, USER


def booster_boxes(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Openings and openers per box."""
    opened = filters.on_attributes(events.filter(F.col("event_name") == BOX_OPENED)).filter(
        F.col("box_id").isNotNull()
    )
    per_user = opened.groupBy(USER, "box_id").agg(number(events).alias("opened"))
    return (
        keep_cohort(per_user, events, filters)
        .groupBy("box_id")
        .agg(
            F.sum("opened").alias("times_opened"),
            F.count(USER).alias("unique_users"),
        )
        .withColumn("avg_per_user", ratio2(F.col("times_opened"), F.col("unique_users")))
        .orderBy(F.desc("times_opened"), "box_id")
    )


def base_station(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Upgrades and upgraders per skill and level; upgrades without a level form their own group."""
    upgrades = filters.on_attributes(events.filter(F.col("event_name") == BASE_UPGRADE)).filter(
        F.col("skill").isNotNull()
    )
    per_user = upgrades.groupBy(USER, "skill", "level").agg(number(events).alias("upgrades"))
    return (
        keep_cohort(per_user, events, filters)
        .groupBy("skill", F.col("level").alias("upgrade_level"))
        .agg(
            F.sum("upgrades").alias("upgrade_count"),
            F.count(USER).alias("unique_users"),
        )
        .orderBy("skill", "upgrade_level")
    )


def base_station_skills(stations: DataFrame) -> DataFrame:
    return stations.select("skill").distinct()


def base_station_pivot(stations: DataFrame, skills: Sequence[str] | None = None) -> DataFrame:
    """One row per upgrade level, one column per skill. Without `skills` the columns are the skills
    found, which takes one more pass to find them."""
    by_level = stations.groupBy("upgrade_level").pivot(
        "skill", None if skills is None else list(skills)
    )
    return by_level.agg(F.first("upgrade_count")).orderBy("upgrade_level")

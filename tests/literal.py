"""Four reports in their literal join forms, to check and time the rewrites against."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.operators.cohort import user_cohort
from playtrail.operators.filters import name_matches
from playtrail.operators.retention import DAY_OFFSETS
from playtrail.sources.schema import LOADOUT, SILVER_COIN_ADS, USER


def _outcomes(events: DataFrame) -> DataFrame:
    return events.filter(
        F.col("event_name").isin("level_complete", "level_fail") & F.col("level").isNotNull()
    )


def level_with_boost(events: DataFrame) -> DataFrame:
    """Range join of outcomes with the ads before them."""
    o = _outcomes(events).alias("o")
    a = events.filter(F.col("event_name").isin(*SILVER_COIN_ADS)).alias("a")
    earlier = (
        (F.col("o.user_pseudo_id") == F.col("a.user_pseudo_id"))
        & (F.col("o.level") == F.col("a.level"))
        & (F.col("a.event_timestamp") <= F.col("o.event_timestamp"))
    )
    boosted = F.when(F.col("a.event_name").isNotNull(), 1).otherwise(0)
    return (
        o.join(a, earlier, "left")
        .select("o.user_pseudo_id", "o.level", "o.event_name", boosted.alias("had_silver_boost"))
        .distinct()
    )


def level_reach(events: DataFrame) -> DataFrame:
    """Join of levels and users on inequality."""
    played = _outcomes(events)
    highest = played.groupBy(USER).agg(F.max("level").alias("highest"))
    levels = played.select("level").distinct()
    return (
        levels.join(highest, F.col("highest") >= F.col("level"), "left")
        .groupBy("level")
        .agg(F.countDistinct(USER).alias("users_reached_level"))
    )


def completion_loadouts(events: DataFrame) -> DataFrame:
    """All earlier loadouts of each completion, ranked, newest kept."""
    order = Window.partitionBy(USER).orderBy("event_timestamp", "event_id")
    done = events.filter(F.col("event_name") == "level_complete").select(
        USER, "level", "event_timestamp", F.row_number().over(order).alias("n")
    )
    loadouts = events.filter(F.col("event_name") == LOADOUT).select(
        F.col(USER).alias("l_user"),
        F.col("level").alias("l_level"),
        F.col("event_timestamp").alias("l_at"),
        F.col("event_id").alias("l_id"),
        "unit_names",
    )
    earlier = (
        (F.col(USER) == F.col("l_user"))
        & (F.col("level") == F.col("l_level"))
        & (F.col("l_at") <= F.col("event_timestamp"))
    )
    newest = Window.partitionBy(USER, "n").orderBy(F.desc("l_at"), F.desc("l_id"))
    return (
        done.join(loadouts, earlier, "left")
        .withColumn("rank", F.row_number().over(newest))
        .filter("rank = 1")
        .select(USER, "n", "level", "unit_names", "l_at")
    )


def cohort_matrix(events: DataFrame, pattern: str) -> DataFrame:
    """Outer join of the cohort with every event, 15 distinct counts."""
    joined = user_cohort(events).join(
        events.select(USER, "event_date", "event_name"), USER, "left"
    )
    days = F.datediff("event_date", "cohort_date")
    hit = name_matches(pattern)
    columns = [F.countDistinct(USER).alias("cohort_size")]
    for k in DAY_OFFSETS:
        columns.append(F.count_if(hit & (days == k)).alias(f"day_{k}_events"))
        columns.append(F.countDistinct(F.when(days == k, F.col(USER))).alias(f"day_{k}_users"))
    return joined.groupBy(F.col("cohort_date").alias("install_date")).agg(*columns)

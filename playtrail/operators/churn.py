"""Churn by level: how many users got there, how many stopped there, how hard it is."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions.numeric import percent2, ratio2, round2
from playtrail.operators.cohort import keep_cohort
from playtrail.operators.filters import Filters, first_rows
from playtrail.operators.levels import completed, failed, level_events
from playtrail.operators.weights import number
from playtrail.sources.schema import USER


def _per_user_level(events: DataFrame, filters: Filters) -> DataFrame:
    per_user = (
        level_events(events, filters)
        .groupBy(USER, "level")
        .agg(
            number(events, failed()).alias("failures"),
            number(events, completed()).alias("completions"),
        )
    )
    return keep_cohort(per_user, events, filters)


def user_max_level(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Highest level each user played."""
    highest = (
        level_events(events, filters).groupBy(USER).agg(F.max("level").alias("max_level_reached"))
    )
    return keep_cohort(highest, events, filters)


def level_difficulty(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Outcomes per level."""
    return (
        _per_user_level(events, filters)
        .groupBy("level")
        .agg(
            F.sum("failures").alias("failures"),
            F.sum("completions").alias("completions"),
            F.sum(F.col("failures") + F.col("completions")).alias("total_attempts"),
        )
    )


def level_retention(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Outcomes per level, users whose highest level is at or above it, and the same number for the
    next level anyone played.

    "At or above" is a running sum from the top over the number of users who stopped at each level,
    instead of a join of users with levels. The windows without a partition run over one row per
    level; the window per user runs over one row per level the user played.
    """
    per_user = _per_user_level(events, filters)
    ends_here = F.col("level") == F.max("level").over(Window.partitionBy(USER))
    per_level = (
        per_user.withColumn("ends_here", ends_here)
        .groupBy("level")
        .agg(
            F.sum("failures").alias("failures"),
            F.sum("completions").alias("completions"),
            F.sum(F.col("failures") + F.col("completions")).alias("total_attempts"),
            F.count_if(F.col("ends_here") & F.col(USER).isNotNull()).alias("last_here"),
        )
    )
    from_top = Window.orderBy(F.desc("level")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        per_level.withColumn("users_reached_level", F.sum("last_here").over(from_top))
        .withColumn(
            "users_reached_next_level",
            F.lag("users_reached_level").over(Window.orderBy(F.desc("level"))),
        )
        .select(
            "level",
            "users_reached_level",
            "users_reached_next_level",
            "failures",
            "completions",
            "total_attempts",
        )
    )


def level_reach(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return level_retention(events, filters).select("level", "users_reached_level")


def churn(
    events: DataFrame, filters: Filters = Filters(), level_count: int | str | None = 50
) -> DataFrame:
    """Churn of the first `level_count` levels. The last level of all has no next one and no churn;
    the last one shown does, as the limit comes after."""
    reached = F.col("users_reached_level")
    left = reached - F.col("users_reached_next_level")
    rate = left.cast("double") * F.lit(100.0) / F.nullif(reached, F.lit(0))
    report = (
        level_retention(events, filters)
        .select(
            "level",
            "users_reached_level",
            F.coalesce(left, F.lit(0)).alias("users_churned_at_level"),
            round2(F.coalesce(rate, F.lit(0.0))).alias("churn_rate"),
            percent2(F.col("failures"), F.col("total_attempts")).alias("failure_rate"),
            ratio2(F.col("total_attempts"), F.col("completions")).alias("difficulty_score"),
        )
        .orderBy("level")
    )
    return first_rows(report, level_count, 50)


def _peak(report: DataFrame, score: str) -> DataFrame:
    # The lowest level wins among equals; without any positive score the level is NULL, the score 0.
    best = F.max(F.when(F.col(score) > 0, F.struct(F.col(score), (-F.col("level")).alias("down"))))
    return report.agg(best.alias("best")).select(
        (-F.col("best.down")).alias("level"),
        F.coalesce(F.col(f"best.{score}"), F.lit(0.0)).alias(score),
    )


def hardest_level(report: DataFrame) -> DataFrame:
    """Level of a `churn` report with the highest difficulty."""
    return _peak(report, "difficulty_score")


def max_churn_level(report: DataFrame) -> DataFrame:
    """Level of a `churn` report that loses the largest share of its users."""
    return _peak(report, "churn_rate")

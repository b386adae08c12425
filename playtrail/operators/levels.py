"""Level results: completion, duration and attempts per level."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.functions.numeric import percent2, round2
from playtrail.operators.cohort import keep_cohort
from playtrail.operators.filters import Filters, first_rows
from playtrail.operators.weights import number, timed
from playtrail.sources.schema import LEVEL_COMPLETE, LEVEL_FAIL, USER


def completed() -> Column:
    return F.col("event_name") == LEVEL_COMPLETE


def failed() -> Column:
    return F.col("event_name") == LEVEL_FAIL


def level_events(events: DataFrame, filters: Filters) -> DataFrame:
    """Completions and failures that carry a level."""
    outcomes = events.filter(F.col("event_name").isin(LEVEL_COMPLETE, LEVEL_FAIL))
    return filters.on_attributes(outcomes).filter(F.col("level").isNotNull())


def _per_user_level(events: DataFrame, filters: Filters) -> DataFrame:
    """One row per user and level with everything the level reports add up: the log is read and
    shuffled once, and the rows of a hot level or a hot user are summed before the shuffle."""
    seconds, with_time = F.col("duration_seconds"), timed(events)
    per_user = (
        level_events(events, filters)
        .groupBy(USER, "level")
        .agg(
            number(events).alias("attempts"),
            number(events, completed()).alias("done"),
            F.sum(F.when(completed(), seconds)).alias("done_seconds"),
            F.sum(F.when(completed(), with_time).otherwise(0)).alias("done_timed"),
            F.sum(F.when(failed(), seconds)).alias("fail_seconds"),
            F.sum(F.when(failed(), with_time).otherwise(0)).alias("fail_timed"),
        )
    )
    return keep_cohort(per_user, events, filters)


def _per_level(per_user: DataFrame) -> DataFrame:
    attempts, done = F.col("attempts"), F.col("done")
    return per_user.groupBy("level").agg(
        F.sum(done).alias("completions"),
        F.sum(attempts - done).alias("failures"),
        F.sum(attempts).alias("total_attempts"),
        F.count(USER).alias("unique_users"),
        (F.sum("done_seconds") / F.nullif(F.sum("done_timed"), F.lit(0))).alias(
            "avg_duration_complete"
        ),
        (F.sum("fail_seconds") / F.nullif(F.sum("fail_timed"), F.lit(0))).alias(
            "avg_duration_fail"
        ),
        round2(F.avg(F.when(done > 0, attempts))).alias("avg_attempts_to_complete"),
    )


def level_stats(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Counts and mean durations (not rounded) of every level."""
    return _per_level(_per_user_level(events, filters)).drop("avg_attempts_to_complete")


def user_attempts(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Attempts of each user at each level, and whether one succeeded."""
    return _per_user_level(events, filters).select(
        "level", USER, "attempts", (F.col("done") > 0).cast("int").alias("completed")
    )


def avg_attempts(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Mean attempts, replays included, of the users who completed the level at least once."""
    per_level = _per_level(_per_user_level(events, filters))
    return per_level.select("level", "avg_attempts_to_complete")


def level_analysis(
    events: DataFrame, filters: Filters = Filters(), level_count: int | str | None = 50
) -> DataFrame:
    """Completion rate, durations and attempts of the first `level_count` levels."""
    report = (
        _per_level(_per_user_level(events, filters))
        .select(
            "level",
            "completions",
            "failures",
            "total_attempts",
            "unique_users",
            percent2(F.col("completions"), F.col("total_attempts")).alias("completion_rate"),
            round2(F.col("avg_duration_complete")).alias("avg_duration_complete"),
            round2(F.col("avg_duration_fail")).alias("avg_duration_fail"),
            "avg_attempts_to_complete",
        )
        .orderBy("level")
    )
    return first_rows(report, level_count, 50)


def average_completion_rate(analysis: DataFrame) -> DataFrame:
    """Plain mean over the shown levels, not weighted by attempts; one decimal, 0 without levels."""
    mean = F.avg(F.coalesce("completion_rate", F.lit(0.0)))
    rounded = F.round(mean.cast("decimal(38,9)"), 1).cast("double")
    return analysis.agg(F.coalesce(rounded, F.lit(0.0)).alias("avg_completion_rate"))


def level_chart(analysis: DataFrame, levels: int = 20) -> DataFrame:
    """First levels of the completion curve."""
    return analysis.select("level", "completion_rate").orderBy("level").limit(levels)

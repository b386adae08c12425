"""Silver-coin boost: do users who watched the ad before playing a level complete it more often?"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.functions.numeric import percent2, round2
from playtrail.operators.cohort import keep_cohort
from playtrail.operators.filters import Filters, first_rows
from playtrail.operators.weights import last_at
from playtrail.sources.schema import LEVEL_COMPLETE, LEVEL_FAIL, SILVER_COIN_ADS, USER

# An outcome is boosted when an ad for the same user and level came at or before it. Of one user's
# outcomes of one kind at one level, some are boosted exactly when the last one is not before the
# first ad, and some are not exactly when the first one is before it. So the first ad and the first
# and last outcome of each kind decide all four cases, and the two kinds of event need no join.
CASES = (
    (LEVEL_COMPLETE, 1, "done_with"),
    (LEVEL_COMPLETE, 0, "done_without"),
    (LEVEL_FAIL, 1, "failed_with"),
    (LEVEL_FAIL, 0, "failed_without"),
)


def _cases(events: DataFrame, filters: Filters) -> DataFrame:
    name, at, last = F.col("event_name"), F.col("event_timestamp"), last_at(events)
    kinds = events.filter(name.isin(LEVEL_COMPLETE, LEVEL_FAIL, *SILVER_COIN_ADS))
    rows = filters.on_attributes(kinds).filter(F.col("level").isNotNull())

    def span(kind: str, label: str) -> list:
        return [
            F.min(F.when(name == kind, at)).alias(f"first_{label}"),
            F.max(F.when(name == kind, last)).alias(f"last_{label}"),
        ]

    per_user = rows.groupBy(USER, "level").agg(
        # Events without a user are one group here but belong to no common user: no boost.
        F.min(F.when(name.isin(*SILVER_COIN_ADS) & F.col(USER).isNotNull(), at)).alias("first_ad"),
        *span(LEVEL_COMPLETE, "done"),
        *span(LEVEL_FAIL, "failed"),
    )
    per_user = keep_cohort(per_user, events, filters)
    ad = F.col("first_ad")

    def boosted(label: str):
        return F.coalesce(F.col(f"last_{label}") >= ad, F.lit(False))

    def plain(label: str):
        first = F.col(f"first_{label}")
        return first.isNotNull() & F.coalesce(first < ad, F.lit(True))

    return per_user.select(
        USER,
        "level",
        boosted("done").alias("done_with"),
        plain("done").alias("done_without"),
        boosted("failed").alias("failed_with"),
        plain("failed").alias("failed_without"),
    )


def level_with_boost(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Distinct (user, level, outcome, boosted or not)."""
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(flag),
                    F.struct(
                        F.lit(kind).alias("event_name"), F.lit(boost).alias("had_silver_boost")
                    ),
                )
                for kind, boost, flag in CASES
            ]
        )
    )
    return (
        _cases(events, filters)
        .select(USER, "level", F.explode(found).alias("found"))
        .select(USER, "level", "found.event_name", "found.had_silver_boost")
    )


def silver_boost(
    events: DataFrame, filters: Filters = Filters(), level_count: int | str | None = 50
) -> DataFrame:
    """Boost use and completion rates with and without it. An attempt here is one distinct
    (user, level, outcome, boosted) case, not one event."""
    counts = (
        _cases(events, filters)
        .groupBy("level")
        .agg(*[F.count_if(F.col(flag)).alias(flag) for _, _, flag in CASES])
    )
    done_with, done_without = F.col("done_with"), F.col("done_without")
    with_boost = done_with + F.col("failed_with")
    without = done_without + F.col("failed_without")
    total = with_boost + without
    report = (
        counts.filter(total > 0)  # levels with ads but no outcome are no levels here
        .select(
            "level",
            total.alias("total_attempts"),
            with_boost.alias("attempts_with_boost"),
            done_with.alias("completions_with_boost"),
            done_without.alias("completions_without_boost"),
            percent2(with_boost, total).alias("boost_usage_rate"),
            percent2(done_with, with_boost).alias("completion_rate_with_boost"),
            percent2(done_without, without).alias("completion_rate_without_boost"),
        )
        .orderBy("level")
    )
    return first_rows(report, level_count, 50)


def boost_impact(boost: DataFrame) -> DataFrame:
    """Completion rate with boost minus without, per level; a missing rate counts as 0."""
    with_boost = F.coalesce("completion_rate_with_boost", F.lit(0.0))
    without = F.coalesce("completion_rate_without_boost", F.lit(0.0))
    return boost.withColumn("impact", round2(with_boost - without))

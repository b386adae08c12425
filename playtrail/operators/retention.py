"""Cohort matrices: install day by day offset, with events and active users in each cell."""

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.operators.cohort import is_install, user_cohort
from playtrail.operators.filters import Filters, first_rows, name_matches, row_limit
from playtrail.operators.weights import number
from playtrail.sources.schema import AD_FORMATS, AD_IMPRESSION, USER

# The day offsets and the number of install days that are reported, and the shares of
# the largest cell from which a heat level begins.
DAY_OFFSETS = (0, 1, 2, 3, 4, 5, 6, 7, 14, 30, 45, 60, 75, 90)
DAYS_SHOWN = 100
HEAT_LEVELS = ((5, 0.8), (4, 0.6), (3, 0.4), (2, 0.2))


def _matrix(
    events: DataFrame, filters: Filters, counted: dict[str, Column], limit: int | str | None
) -> DataFrame:
    """One row per install day, in order: cohort_size, day_k_users, and `{label}{k}` events per
    counted kind, of the first `limit` install days.

    Events are summed per user and day, which leaves at most one row per day of the log for the
    busiest user; with that grain every later count is a plain sum. The same rows say on which days
    the user installed, and the first of these is the cohort date: a minimum over the user's rows,
    so the cohort is not joined for it. Only a date range joins the cohort, once, by a semi-join,
    which Spark moves below the sum, to the scan, where the cohort is small enough to broadcast. A
    user is active on the install day by the install itself, so cohort_size is the users at offset
    0. An install day whose only installs carry no user id has no cohort and no row. Events of the
    user count whatever their platform, country or version; the filters choose the installs only.

    Over the activity table of `sources.activity`, whose rows stand for `events` events each and are
    bucketed by user, all of this happens where the rows lie; only the sums per install day move.
    """
    days = row_limit(limit, DAYS_SHOWN)
    known = events.filter(F.col("event_name").isNotNull() & F.col(USER).isNotNull())
    # Days outside every offset of every install day shown are not read.
    span = max(DAY_OFFSETS)
    if filters.has_cohort:
        last = filters.end + timedelta(days=span)
        known = known.filter(F.col("event_date").between(F.lit(filters.start), F.lit(last)))
        known = known.join(user_cohort(events, filters).select(USER), USER, "left_semi")
    elif days is not None:
        # The last install day shown is known from the installs alone.
        cohort = user_cohort(events, filters).filter(F.col(USER).isNotNull())
        shown = cohort.select("cohort_date").distinct()
        newest = shown.orderBy("cohort_date").limit(days).agg(F.max("cohort_date")).scalar()
        known = known.filter(F.col("event_date") <= F.date_add(newest, span))
    daily = known.groupBy(USER, "event_date").agg(
        F.count_if(is_install(filters)).alias("installs"),
        *[number(events, test).alias(label) for label, test in counted.items()],
    )
    installed = F.when(F.col("installs") > 0, F.col("event_date"))
    dated = daily.withColumn("install_date", F.min(installed).over(Window.partitionBy(USER)))
    cells = dated.select(
        "install_date", F.datediff("event_date", "install_date").alias("offset"), *counted
    ).filter(F.col("offset").isin(*DAY_OFFSETS))
    sums = [F.count_if(F.col("offset") == 0).alias("cohort_size")]
    for k in DAY_OFFSETS:
        here = F.col("offset") == k
        sums += [
            F.coalesce(F.sum(F.when(here, F.col(label))), F.lit(0)).alias(f"{label}{k}")
            for label in counted
        ]
        sums.append(F.count_if(here).alias(f"day_{k}_users"))
    matrix = cells.groupBy("install_date").agg(*sums)
    return first_rows(matrix.orderBy("install_date"), limit, DAYS_SHOWN)


def _day_columns(label: str) -> list[Column]:
    columns = []
    for k in DAY_OFFSETS:
        columns += [F.col(f"{label}{k}").alias(f"day_{k}_events"), F.col(f"day_{k}_users")]
    return columns


def _event_matrix(
    events: DataFrame, filters: Filters, test: Column, limit: int | str | None
) -> DataFrame:
    matrix = _matrix(events, filters, {"seen_": test}, limit)
    return matrix.select("install_date", "cohort_size", *_day_columns("seen_"))


def rewarded_ads_cohort(
    events: DataFrame,
    event_name: str,
    filters: Filters = Filters(),
    limit: int | str | None = DAYS_SHOWN,
) -> DataFrame:
    """Matrix of one event, or of every event matching a pattern with '%'."""
    if not event_name:
        raise ValueError("event_name is required")
    return _event_matrix(events, filters, name_matches(event_name), limit)


def _impression(ad_format: str) -> Column:
    return (F.col("event_name") == AD_IMPRESSION) & (F.col("ad_format") == ad_format)


def ad_impressions_cohort(
    events: DataFrame,
    ad_format: str,
    filters: Filters = Filters(),
    limit: int | str | None = DAYS_SHOWN,
) -> DataFrame:
    """Matrix of the ad impressions of one format."""
    if not ad_format:
        raise ValueError("ad_format is required")
    return _event_matrix(events, filters, _impression(ad_format), limit)


def ad_impressions_by_format(
    events: DataFrame,
    formats: Sequence[str] = AD_FORMATS,
    filters: Filters = Filters(),
    limit: int | str | None = DAYS_SHOWN,
) -> DataFrame:
    """The matrices of several formats from one pass over the log, told apart by `ad_format`."""
    labels = {fmt: f"format{i}_" for i, fmt in enumerate(formats)}
    counted = {label: _impression(fmt) for fmt, label in labels.items()}
    matrix = _matrix(events, filters, counted, limit)
    rows = F.array(
        *[
            F.struct(F.lit(fmt).alias("ad_format"), *_day_columns(label))
            for fmt, label in labels.items()
        ]
    )
    return matrix.select("install_date", "cohort_size", F.inline(rows))


def cohort_cells(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A matrix as one row per cell, with events per active user and a heat level from 0 to 5
    relative to the largest cell (of each group, when `by` names columns). The window runs over the
    report's cells, 14 per install day."""
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("day"),
                F.col(f"day_{k}_events").alias("events"),
                F.col(f"day_{k}_users").alias("users"),
            )
            for k in DAY_OFFSETS
        ]
    )
    mean = F.when(
        F.col("users") > 0, F.col("events").cast("double") / F.col("users")
    ).otherwise(F.lit(0.0))
    top = F.greatest(F.max("avg_events").over(Window.partitionBy(*by)), F.lit(1.0))
    share = F.col("avg_events") / top
    heat = F.when(F.col("avg_events") == 0, 0)
    for level, bound in HEAT_LEVELS:
        heat = heat.when(share >= bound, level)
    return (
        matrix.select(*by, "install_date", "cohort_size", F.inline(cells))
        .withColumn("avg_events", mean)
        .withColumn("heat", heat.otherwise(1))
    )

"""Install cohorts.

Every report that knows a cohort works in the same three steps: count per user first, then keep the
cohort's users, then add up. Counting first means that a user who holds a third of the log reaches
the join, and the shuffle before it, as a handful of rows.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.operators.filters import Filters
from playtrail.sources.schema import FIRST_OPEN, USER


def is_install(filters: Filters = Filters()) -> Column:
    """Whether an event counts as an install, whatever its day."""
    tests = filters.attribute_tests() if filters.cohort_scope == "filtered" else []
    return reduce(and_, tests, F.col("event_name") == FIRST_OPEN)


def user_cohort(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """(user_pseudo_id, cohort_date): day of the first install event; users installed in the date
    range, or every user with an install event when there is no range."""
    opens = events.filter(is_install(filters))
    if filters.has_cohort:
        # A first install up to `end` is decided by the days up to `end`; later days stay unread.
        opens = opens.filter(F.col("event_date") <= F.lit(filters.end))
    first = opens.groupBy(USER).agg(F.min("event_date").alias("cohort_date"))
    if filters.has_cohort:
        first = first.filter(F.col("cohort_date") >= F.lit(filters.start))
    return first


def keep_cohort(per_user: DataFrame, events: DataFrame, filters: Filters) -> DataFrame:
    """Rows of cohort users; all rows when no date range is set. `per_user` should already be
    aggregated by user. There is no broadcast hint: Spark broadcasts the cohort only where its
    estimated or measured size is under the session's threshold, and merge-joins it otherwise."""
    if not filters.has_cohort:
        return per_user
    return per_user.join(user_cohort(events, filters).select(USER), USER, "left_semi")


def narrow_to_cohort(events: DataFrame, filters: Filters) -> DataFrame:
    """Events of the cohort's users; all events when no date range is set. Any report with the same
    filters gives the same result on them. Spark broadcasts a small cohort, which then cuts the log
    as it is read; a large one is merge-joined, which only pays off where several reports share the
    narrowed events."""
    if not filters.has_cohort:
        return events
    return events.join(user_cohort(events, filters).select(USER), USER, "left_semi")

"""Rows that stand for several events.

A report reads a log of single events, or a table in which one row stands for `events` events that
agree in everything the report looks at. Such a row has the first of their times as
`event_timestamp`, the last as `last_timestamp`, and the sum of their `timed` known durations as
`duration_seconds`. These columns are the sums that a report adds up; over single events they are
ones, the event's own time and its own duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def times(events: DataFrame) -> Column:
    """Events that a row stands for."""
    return F.col("events") if "events" in events.columns else F.lit(1).cast("bigint")


def timed(events: DataFrame) -> Column:
    """Those of them with a known duration."""
    if "timed" in events.columns:
        return F.col("timed")
    return F.when(F.col("duration_seconds").isNotNull(), 1).otherwise(0).cast("bigint")


def last_at(events: DataFrame) -> Column:
    """Time of the last of them."""
    return F.col("last_timestamp" if "last_timestamp" in events.columns else "event_timestamp")


def number(events: DataFrame, test: Column | None = None) -> Column:
    """Number of events (that pass a test), as an aggregate; 0 where there is none."""
    if "events" not in events.columns:
        return F.count("*") if test is None else F.count_if(test)
    counted = F.col("events") if test is None else F.when(test, F.col("events"))
    return F.coalesce(F.sum(counted), F.lit(0))

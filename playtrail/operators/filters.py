"""Report filters as column expressions. No argument is ever spliced into SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"
COHORT_SCOPES = ("filtered", "global")


def _as_date(value: date | str | None) -> date | None:
    if isinstance(value, str):
        return date.fromisoformat(value) if value.strip() else None
    return value


def _chosen(value: str | None) -> str | None:
    return None if value is None or value == ALL or not value.strip() else value


@dataclass(frozen=True)
class Filters:
    """`start` and `end` together select the users *installed* in that range (the cohort); one
    alone selects nothing. `platform`, `country` and `version` keep matching events; 'all' or blank
    keeps every event. With `cohort_scope='filtered'` the three also decide which install events
    count; with 'global' every install event counts."""

    start: date | str | None = None
    end: date | str | None = None
    platform: str | None = None
    country: str | None = None
    version: str | None = None
    cohort_scope: str = "filtered"

    def __post_init__(self) -> None:
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        if self.cohort_scope not in COHORT_SCOPES:
            raise ValueError(f"cohort_scope must be one of {COHORT_SCOPES}")

    @property
    def has_cohort(self) -> bool:
        return self.start is not None and self.end is not None

    def without(self, *names: str) -> Filters:
        return replace(self, **dict.fromkeys(names))

    def attribute_tests(self) -> list[Column]:
        # Only the empty text and 'all' switch the platform off; a blank one matches nothing.
        tests = []
        if self.platform and self.platform != ALL:
            tests.append(F.col("platform") == self.platform.upper())
        for column, value in (("country", self.country), ("version", self.version)):
            if _chosen(value) is not None:
                tests.append(F.col(column) == value)
        return tests

    def on_attributes(self, events: DataFrame) -> DataFrame:
        for test in self.attribute_tests():
            events = events.filter(test)
        return events

    def on_event_date(self, events: DataFrame) -> DataFrame:
        """Days of the *events*, on the partition column so that whole days are skipped."""
        if not self.has_cohort:
            return events
        return events.filter(F.col("event_date").between(F.lit(self.start), F.lit(self.end)))


def last_week(today: date | None = None, **others: str) -> Filters:
    """Default window of the dashboard: seven days back up to today, both in UTC."""
    end = today or datetime.now(timezone.utc).date()
    return Filters(start=end - timedelta(days=7), end=end, **others)


def name_matches(pattern: str, column: str = "event_name") -> Column:
    """LIKE when the pattern holds '%', else equality.

    `_` matches any one character, so Spark cannot turn 'RV_Watched_%' into a prefix test by itself;
    the plain text before the first wildcard is therefore added as one, which reaches Parquet.
    """
    name = F.col(column)
    if "%" not in pattern:
        return name == pattern
    prefix = re.split(r"[%_\\]", pattern, maxsplit=1)[0]
    like = name.like(pattern)
    return name.startswith(prefix) & like if prefix else like


def row_limit(value: int | str | None, default: int) -> int | None:
    """A report's row count: blank means the default, 'all' no limit (None), anything else but a
    whole number is an error."""
    if value is None or value == "":
        return default
    if value == ALL:
        return None
    count = int(value)
    if count < 0:
        raise ValueError(f"row count must not be negative: {value}")
    return count


def first_rows(report: DataFrame, value: int | str | None, default: int) -> DataFrame:
    """The first rows of an ordered report, or all of them."""
    count = row_limit(value, default)
    return report if count is None else report.limit(count)


def level_choice(value: int | str | None) -> int | None:
    if isinstance(value, str):
        value = _chosen(value)
    return None if value is None else int(value)

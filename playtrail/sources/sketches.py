"""Sketches of the users of each day, for numbers of users that need not be exact.

One row per load, day, platform, country and version holds a HyperLogLog sketch of the users seen.
Sketches of any days and attributes merge into one of the same error, so the users of a quarter come
from a few thousand rows instead of the log. With 2^LOG_SIZE registers the relative standard error is
about 0.83 / sqrt(2^LOG_SIZE): 1.3 % for 12, the default, in at most 2 or 3 KB a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.operators.filters import Filters
from playtrail.sources.loads import Kept, merge_loads, read_loads, write_load
from playtrail.sources.schema import USER

ATTRIBUTES = ("platform", "country", "version")
LOG_SIZE = 12
SKETCHES = Kept(
    "platform string, country string, version string, users binary, event_date date", ATTRIBUTES
)


def update_sketches(flat: DataFrame, path: str, load_id: str, log_size: int = LOG_SIZE) -> None:
    """Take over the users of one load of flat events. A day's users of one kind are summed in the
    tasks that read them, so a hot day or country is shuffled as one sketch per task."""
    sketched = flat.groupBy("event_date", *ATTRIBUTES).agg(
        F.hll_sketch_agg(USER, F.lit(log_size)).alias("users")
    )
    write_load(sketched, path, load_id, SKETCHES)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return read_loads(spark, path, SKETCHES)


def merge_sketches(spark: SparkSession, path: str, days=None) -> list[str]:
    """Merge the folders of many loads of a day into one."""
    return merge_loads(spark, path, days, kept=SKETCHES)


def approx_users(sketches: DataFrame, filters: Filters = Filters(), by: str | None = None) -> DataFrame:
    """Estimated number of users of the events on the days from `start` to `end` that pass the
    attribute filters: one row, or one per value of `by`. The dates are days of events; what is
    exact, and what selects by install day, are the reports over the log."""
    seen = filters.on_event_date(filters.on_attributes(sketches))
    if by is not None:
        seen = seen.filter(F.col(by).isNotNull())
    merged = seen.groupBy(*([by] if by else [])).agg(F.hll_union_agg("users").alias("users"))
    estimate = F.coalesce(F.hll_sketch_estimate("users"), F.lit(0)).cast("bigint")
    return merged.select(*([by] if by else []), estimate.alias("approx_users"))

"""Daily activity per user, stored in buckets of users.

One row stands for the `events` events of one user, day, event name, ad format, platform, country and
version. All rows of a user lie in one bucket, so what is summed or ordered by user, as the cohort
matrices are, needs no exchange of rows however often it is asked for; and the table holds a row for
many events, so it is a small part of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.sources.schema import USER

KEYS = (USER, "event_date", "event_name", "ad_format", "platform", "country", "version")
BUCKETS = 64


def daily_activity(flat: DataFrame) -> DataFrame:
    """The rows of the table, from the flat log."""
    named = flat.filter(F.col("event_name").isNotNull())
    return named.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"))


def write_activity(
    flat: DataFrame, name: str, path: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Store the activity of a log as the table `name` and give it back. `path` keeps its files
    outside the warehouse. Choose the buckets by the size of the table, some 200 MB each; a user who
    holds a third of the log is one row per day and kind of event and spoils no bucket. The rows are
    dealt to the buckets before they are written, so every bucket is one file and already sorted."""
    spark = flat.sparkSession
    writer = (
        daily_activity(flat)
        .repartition(buckets, USER)
        .write.mode("overwrite")
        .bucketBy(buckets, USER)
        .sortBy(USER)
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return read_activity(spark, name)


def read_activity(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)

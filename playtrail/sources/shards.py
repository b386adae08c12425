"""Time bounds of the shards of a raw log, kept in a small table beside it.

A shard is one folder of the log. Its events may belong to other days than its name says: a shard may
be cut at a local midnight, and events may arrive late. The table holds the first and last
`event_timestamp` of every shard, with what its listing looked like then. A read of some days takes
the shards whose bounds meet them, and every shard that the table does not know or that has changed
since, so a table that is out of date costs time and never an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.sources.folders import exists, folder_states, matching

STATE = ("files", "bytes", "newest", "names")
BOUNDS = (
    "shard string, files bigint, bytes bigint, newest timestamp, names bigint, "
    "first bigint, last bigint"
)


def _shard(column: str):
    """Last folder of a path."""
    return F.regexp_extract(column, "([^/]+)/?$", 1)


def _listed(spark: SparkSession, root: str, folders: str) -> DataFrame | None:
    """State of every shard that holds a file; None where there is no shard."""
    found = matching(spark, f"{root.rstrip('/')}/{folders}")
    if not found:
        return None
    return folder_states(spark, *found).select(_shard("folder").alias("shard"), "folder", *STATE)


def _known(spark: SparkSession, bounds: str) -> DataFrame:
    if not exists(spark, bounds):
        return spark.createDataFrame([], BOUNDS)
    return spark.read.schema(BOUNDS).parquet(bounds)


def update_bounds(
    spark: SparkSession, root: str, bounds: str, folders: str = "event_date=*"
) -> list[str]:
    """Bring the table at `bounds` up to date with the shards `root/folders` and give the names of
    those that were read for it: new and changed ones. Only their time column is read. Run it after
    a shard was written, or now and then: one row per shard, so it stays small for any log."""
    listed = _listed(spark, root, folders)
    known = _known(spark, bounds)
    if listed is None:
        rows, fresh = [], []
    else:
        # The listing is taken once, before the files are read: what is added meanwhile shows as a
        # change the next time.
        kind = listed.schema
        listed = spark.createDataFrame(listed.collect(), kind)
        join = ["shard", *STATE]
        fresh = [r.folder for r in listed.join(known, join, "left_anti").collect()]
        rows = known.join(listed, join, "left_semi").collect()
    if fresh:
        times = spark.read.schema("event_timestamp bigint").parquet(*fresh)
        folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
        spans = times.groupBy(folder.alias("shard")).agg(
            F.min("event_timestamp").alias("first"), F.max("event_timestamp").alias("last")
        )
        added = listed.where(F.col("folder").isin(fresh)).join(spans, "shard", "left")
        rows += added.select(*known.columns).collect()
    spark.createDataFrame(rows, BOUNDS).coalesce(1).write.mode("overwrite").parquet(bounds)
    return sorted(folder.rsplit("/", 1)[1] for folder in fresh)


def shards_between(
    spark: SparkSession,
    root: str,
    bounds: str,
    low: int | None,
    high: int | None,
    folders: str = "event_date=*",
) -> list[str]:
    """Folders that may hold an event from `low` up to, not including, `high` microseconds."""
    listed = _listed(spark, root, folders)
    if listed is None:
        return []
    found = listed.join(
        _known(spark, bounds).withColumn("known", F.lit(True)), ["shard", *STATE], "left"
    )
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("last") >= low)
    if high is not None:
        inside = inside & (F.col("first") < high)
    # Bounds are missing in a shard whose events have no time; none of them is of any day.
    found = found.where(F.col("known").isNull() | F.coalesce(inside, F.lit(False)))
    return sorted(r.folder for r in found.select("folder").collect())

"""Read the event log, flatten its parameter bag once, keep the flat table by day."""

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.functions.params import double_param, int_param, number_param, string_param
from playtrail.functions.times import DAY, utc_date
from playtrail.sources import schema as S
from playtrail.sources.folders import matching
from playtrail.sources.loads import FLAT, read_loads, write_load
from playtrail.sources.shards import shards_between


# Days around a range of event days in whose shards such events are looked for, where no table of
# bounds tells it: a shard may be cut at a local midnight, and events may arrive late.
MARGIN_DAYS = 2


def _in_days(events: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Events whose UTC day is in the range; either bound may be missing."""
    low, high = _span(start, end)
    if low is not None:
        events = events.filter(F.col("event_timestamp") >= low)
    if high is not None:
        events = events.filter(F.col("event_timestamp") < high)
    return events


def _span(start: date | None, end: date | None) -> tuple[int | None, int | None]:
    """Microseconds from, and up to but not including."""
    return (
        None if start is None else _micros(start),
        None if end is None else _micros(end + timedelta(days=1)),
    )


def _micros(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY


def _shard_days(
    start: date | None, end: date | None, margin: int | None
) -> tuple[date | None, date | None]:
    if margin is None:
        return None, None
    around = timedelta(days=margin)
    return start and start - around, end and end + around


def by_shard(events: DataFrame) -> DataFrame:
    """The day of the directory under the name `shard_date`."""
    return events.withColumnRenamed("event_date", "shard_date")


def read_events(
    spark: SparkSession,
    root: str,
    start: date | None = None,
    end: date | None = None,
    margin_days: int | None = MARGIN_DAYS,
    bounds: str | None = None,
) -> DataFrame:
    """Raw log kept as `root/event_date=YYYY-MM-DD/*.parquet`, all of it or the events of the UTC
    days from `start` to `end`.

    With `bounds`, the table that `shards.update_bounds` keeps, exactly the directories that may
    hold such an event are read, however late it came. Without it only directories up to
    `margin_days` outside the range are read, so events stored further from their day are missed;
    `margin_days=None` looks into all of them.
    """
    if bounds is not None and (start is not None or end is not None):
        folders = shards_between(spark, root, bounds, *_span(start, end))
        if not folders:
            return by_shard(spark.createDataFrame([], S.READ_EVENT_BY_DAY))
        reader = spark.read.schema(S.READ_EVENT_BY_DAY).option("basePath", root)
        return _in_days(by_shard(reader.parquet(*folders)), start, end)
    events = by_shard(spark.read.schema(S.READ_EVENT_BY_DAY).parquet(root))
    low, high = _shard_days(start, end, margin_days)
    if low is not None:
        events = events.filter(F.col("shard_date") >= F.lit(low))
    if high is not None:
        events = events.filter(F.col("shard_date") <= F.lit(high))
    return _in_days(events, start, end)


def read_event_shards(
    spark: SparkSession,
    root: str,
    start: date | None = None,
    end: date | None = None,
    prefix: str = "events_",
    margin_days: int | None = MARGIN_DAYS,
    bounds: str | None = None,
) -> DataFrame:
    """Raw log kept as one directory per day, `root/events_YYYYMMDD/*.parquet`, with today's as
    `root/events_intraday_YYYYMMDD`: the union of all shards, or the events of the UTC days from
    `start` to `end`. Either bound may be missing. The shards are found by listing the folder, so
    days without one do no harm; `bounds` and `margin_days` choose among them as in `read_events`.
    """
    names = rf"{re.escape(prefix)}(?:intraday_)?(\d{{8}})"
    if bounds is not None and (start is not None or end is not None):
        found = shards_between(spark, root, bounds, *_span(start, end), folders=f"{prefix}*")
        low = high = None
    else:
        found = matching(spark, f"{root.rstrip('/')}/{prefix}*")
        low, high = _shard_days(start, end, margin_days)
    shards = []
    for path in found:
        name = re.fullmatch(names, path.rsplit("/", 1)[1])
        day = name and datetime.strptime(name[1], "%Y%m%d").date()
        if day and (low is None or day >= low) and (high is None or day <= high):
            shards.append(path)
    if not shards:
        return spark.createDataFrame([], S.READ_EVENT)
    return _in_days(spark.read.schema(S.READ_EVENT).parquet(*shards), start, end)


def flatten_events(raw: DataFrame, box_key: str = S.BOX_KEY) -> DataFrame:
    """One plain column per parameter that any report reads.

    A projection only: a report that uses two columns of it reads two leaves of the bag. `level` is
    integer-only; `duration_seconds` falls back to the integer field, `duration_seconds_dbl` does
    not. An `event_id`, where the source has one, is kept as the last tiebreak of sequences. The
    `event_date` is the UTC day of the event, whatever day its shard is of.
    """
    has_id = "event_id" in raw.columns
    return raw.select(
        S.USER,
        "event_timestamp",
        "event_name",
        "platform",
        F.col("geo.country").alias("country"),
        F.col("app_info.version").alias("version"),
        int_param("level").alias("level"),
        number_param("duration_seconds").alias("duration_seconds"),
        double_param("duration_seconds").alias("duration_seconds_dbl"),
        string_param("unit_names").alias("unit_names"),
        string_param("unit_name").alias("unit_name"),
        string_param(box_key).alias("box_id"),
        string_param("Skill").alias("skill"),
        string_param("ad_format").alias("ad_format"),
        (F.col("event_id") if has_id else F.lit(None)).cast("bigint").alias("event_id"),
        utc_date(F.col("event_timestamp")).alias("event_date"),
    )


def write_flat_events(flat: DataFrame, path: str, load_id: str) -> None:
    """Store the flat events of one load by day, as `loads.write_load` does; batch loads and the
    stream both write this way. Sorting by event name lets row-group statistics skip the names a
    report does not read."""
    write_load(flat, path, load_id, FLAT)


def read_flat_events(spark: SparkSession, path: str) -> DataFrame:
    return read_loads(spark, path, FLAT)


def write_result(result: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Export a report: `parquet`, `json` or any other format Spark writes."""
    result.write.mode(mode).format(fmt).save(path)

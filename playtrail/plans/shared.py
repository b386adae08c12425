"""One pass over the log for all reports of a page load.

The reports of `dashboard` look at twelve different sums over the same events. `page_sums` makes one
table of which each of them is a further sum: a row per user, event name, attributes and whatever
else some report distinguishes among the events of that name. Its rows stand for several events each
(`operators.weights`), so the reports read it like a log, filters included, and give what they give
over the log itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators.filters import Filters, name_matches
from playtrail.plans.dashboard import dashboard
from playtrail.session import scratch
from playtrail.sources import schema as S

ATTRIBUTES = ("platform", "country", "version")
# What is distinguished among the events of a name; nothing else of them is kept apart.
LEVELED = (
    S.LEVEL_COMPLETE, S.LEVEL_FAIL, S.LOADOUT, S.UNIT_UPGRADE, S.BASE_UPGRADE, *S.SILVER_COIN_ADS
)
TEXTS = {
    "unit_names": S.LOADOUT,
    "unit_name": S.UNIT_UPGRADE,
    "box_id": S.BOX_OPENED,
    "skill": S.BASE_UPGRADE,
}


def page_sums(events: DataFrame) -> DataFrame:
    """The sums, of any filter: attributes stay apart, days only among rewarded ads, the one report
    that dates its events. Of all other rows `event_date` is the first day, which is what decides
    about an install. A hot user is one row per task and kind of event before anything is
    exchanged."""
    name = F.col("event_name")
    texts = [F.when(name == event, F.col(text)).alias(text) for text, event in TEXTS.items()]
    day = F.when(name_matches(S.REWARDED_AD_PATTERN), F.col("event_date"))
    summed = events.groupBy(
        S.USER,
        "event_name",
        *ATTRIBUTES,
        F.when(name.isin(*LEVELED), F.col("level")).alias("level"),
        *texts,
        day.alias("day"),
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_timestamp").alias("event_timestamp"),
        F.max("event_timestamp").alias("last_timestamp"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.count("duration_seconds").alias("timed"),
        F.min("event_date").alias("event_date"),
    )
    return summed.drop("day")


def shared_dashboard(
    events: DataFrame,
    filters: Filters = Filters(),
    level_count: int | str | None = 50,
    loadout_level: int | str | None = None,
    path: str | None = None,
) -> dict[str, DataFrame]:
    """The reports of `dashboard`, with one scan of the log for all of them. The sums are written to
    `path`, or a new folder below the cluster's folder for checkpoints, and serve any further
    filters: `dashboard(spark.read.parquet(path), others)`."""
    path = path or scratch(events.sparkSession, "page")
    page_sums(events).write.mode("overwrite").parquet(path)
    sums = events.sparkSession.read.parquet(path)
    return dashboard(sums, filters, level_count, loadout_level)

"""Install events by themselves, kept load by load, for cohorts without the log.

The table holds one row per load, user, day and attributes of an install, so it is a small part of
the log and grows by the installs of a load only. A cohort over it is a cohort over the whole log:
`user_cohort(read_installs(...), filters)`. Late installs, repeated and corrected loads come out
right in any order, as every load replaces its own rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playtrail.operators.cohort import is_install
from playtrail.sources.loads import Kept, merge_loads, read_loads, write_load
from playtrail.sources.schema import USER

COLUMNS = (USER, "event_name", "platform", "country", "version", "event_date")
INSTALLS = Kept(", ".join(f"{c} {'date' if c == 'event_date' else 'string'}" for c in COLUMNS), (USER,))


def update_installs(flat: DataFrame, path: str, load_id: str) -> None:
    """Take over the installs of one load of flat events."""
    write_load(flat.filter(is_install()).select(*COLUMNS).distinct(), path, load_id, INSTALLS)


def read_installs(spark: SparkSession, path: str) -> DataFrame:
    """The install events, in the columns that cohorts read."""
    return read_loads(spark, path, INSTALLS)


def merge_installs(spark: SparkSession, path: str, days=None) -> list[str]:
    """Merge the folders of many loads of a day into one."""
    return merge_loads(spark, path, days, kept=INSTALLS)

"""Tables that are filled load by load, and the merging of their folders.

A load writes one folder per day, `event_date=D/load_id=L`, and replaces all that it wrote before. A
stream of small loads leaves hundreds of folders a day, so they are merged from time to time:
`merge_loads` writes the rows of a day's folders again, sorted and in files of the advisory size,
into `event_date=D/load_id=merged-...`. Rows keep the load they came with in the column
`origin_load`.

The merged folder is written out of sight and put in its place in one step, with a list of the
folders it stands for. From then on readers leave those folders out, and they are deleted. A merge
that is stopped before the step has changed nothing; one that is stopped after it is finished by the
next one. A load that is repeated after it was merged is first taken out of the merged folder.

One merge or load of the same day at a time: a day whose folders change while it is merged keeps them
as they are and is left for the next merge. The one step is a rename, so the table belongs on a file
system where renaming a folder is atomic.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.sources import schema as S
from playtrail.sources.folders import (
    exists,
    folder_states,
    matching,
    move,
    read_text,
    remove,
    write_text,
)

MERGED = "merged-"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder of rows without a day
WORK = "_merging"  # readers do not look into names that begin so
TAKEN = "_merged_loads"
LISTS = "_sources.json"


@dataclass(frozen=True)
class Kept:
    """What a table holds: its columns as DDL, `event_date` among them, and the order of its rows
    within a file."""

    columns: str
    order: tuple[str, ...]

    @property
    def stored(self) -> str:
        return f"{self.columns}, load_id string, origin_load string"


FLAT = Kept(
    ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FLAT_EVENT.fields),
    ("event_name", S.USER),
)


def _parts(folder: str) -> tuple[str, str]:
    """Day and load of a folder of the table."""
    day, load = (unquote(part.split("=", 1)[1]) for part in folder.rsplit("/", 2)[1:])
    return day, load


def _days(spark: SparkSession, path: str, days: Iterable[date | str] | None) -> dict[str, list[str]]:
    """Folders by day; a day is named as its folder is."""
    root = path.rstrip("/")
    every = ["*"] if days is None else [str(day) for day in days]
    found: dict[str, list[str]] = {}
    for day in every:
        for folder in matching(spark, f"{root}/event_date={day}/load_id=*"):
            found.setdefault(_parts(folder)[0], []).append(folder)
    return found


def _lists(spark: SparkSession, folder: str) -> dict:
    """`folders` that a merged folder stands for, `loads` whose rows it may hold."""
    return json.loads(read_text(spark, f"{folder}/{LISTS}"))


def _hidden(spark: SparkSession, folders: list[str]) -> set[str]:
    """Names among the folders of one day for which a merged one stands."""
    names = {_parts(f)[1] for f in folders}
    merged = [f for f in folders if _parts(f)[1].startswith(MERGED)]
    if not merged or len(folders) == 1:
        return set()
    return names & {name for f in merged for name in _lists(spark, f)["folders"]}


def _is_day(day: str) -> Column:
    """Whether a row is of the day that a folder names."""
    column = F.col("event_date")
    return column.isNull() if day == NO_DAY else column.eqNullSafe(F.lit(date.fromisoformat(day)))


def superseded(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """By day, the folders that a stopped merge has left beside the merged one."""
    found = {day: sorted(_hidden(spark, f)) for day, f in _days(spark, path, None).items()}
    return {day: names for day, names in found.items() if names}


def _clean(spark: SparkSession, folders: list[str]) -> list[str]:
    """Delete what a stopped merge has left of a day; the folders that stay."""
    hidden = _hidden(spark, folders)
    for folder in folders:
        if _parts(folder)[1] in hidden:
            remove(spark, folder)
    return [f for f in folders if _parts(f)[1] not in hidden]


def _rows(spark: SparkSession, path: str, kept: Kept, folders: list[str]) -> DataFrame:
    """Rows of some folders with the load each came with."""
    rows = spark.read.schema(kept.stored).option("basePath", path).parquet(*folders)
    return rows.withColumn("origin_load", F.coalesce("origin_load", "load_id")).drop("load_id")


def _replace(
    spark: SparkSession,
    path: str,
    kept: Kept,
    rows: DataFrame,
    sources: dict[str, list[str]],
    without: set[str],
) -> list[str]:
    """Put one merged folder per day in the place of its sources. Days whose sources have changed
    meanwhile are left alone."""
    root = path.rstrip("/")
    every = [f for folders in sources.values() for f in folders]
    loads = {
        day: {
            load
            for f in folders
            for load in (
                _lists(spark, f)["loads"] if _parts(f)[1].startswith(MERGED) else [_parts(f)[1]]
            )
        }
        - without
        for day, folders in sources.items()
    }
    before = {r[0]: tuple(r[1:]) for r in folder_states(spark, *every).collect()}
    work = f"{root}/{WORK}/{uuid.uuid4().hex}"
    (
        rows.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", *kept.order)
        .write.partitionBy("event_date")
        .parquet(work)
    )
    after = {r[0]: tuple(r[1:]) for r in folder_states(spark, *every).collect()}
    done = []
    for day, folders in sources.items():
        if any(before.get(f) != after.get(f) for f in folders):
            continue
        names = sorted(_parts(f)[1] for f in folders)
        made = f"{work}/event_date={day}"
        if exists(spark, made):
            # The marks come first: a merged load without one could not be taken out again.
            for load in loads[day]:
                write_text(spark, f"{root}/{TAKEN}/{quote(load, safe='')}/{day}", "")
            lists = {"folders": names, "loads": sorted(loads[day])}
            write_text(spark, f"{made}/{LISTS}", json.dumps(lists))
            digest = hashlib.sha256(json.dumps([names, uuid.uuid4().hex]).encode()).hexdigest()[:16]
            move(spark, made, f"{root}/event_date={day}/load_id={MERGED}{digest}")
        for folder in folders:
            remove(spark, folder)
        done.append(day)
    remove(spark, work)
    return sorted(done)


def merge_loads(
    spark: SparkSession,
    path: str,
    days: Iterable[date] | None = None,
    least: int = 2,
    kept: Kept = FLAT,
) -> list[str]:
    """Merge the folders of every day, or of `days`, that has at least `least` of them, and give the
    days that were merged. All days are written by one Spark job; their number of files follows from
    their bytes and no longer from their number of loads. Safe to repeat."""
    found = {day: _clean(spark, folders) for day, folders in _days(spark, path, days).items()}
    sources = {day: folders for day, folders in found.items() if len(folders) >= max(2, least)}
    if not sources:
        return []
    rows = _rows(spark, path, kept, [f for folders in sources.values() for f in folders])
    return _replace(spark, path, kept, rows, sources, set())


def _take_out(spark: SparkSession, path: str, load_id: str, kept: Kept) -> None:
    """Remove the rows of a load from the merged folders that hold it."""
    marks = f"{path.rstrip('/')}/{TAKEN}/{load_id}"
    if not exists(spark, marks):
        return
    for mark in matching(spark, f"{marks}/*"):
        day = mark.rsplit("/", 1)[1]
        folders = _days(spark, path, [day]).get(day, [])
        holders = [
            f
            for f in _clean(spark, folders)
            if _parts(f)[1].startswith(MERGED) and load_id in _lists(spark, f)["loads"]
        ]
        if holders:
            rows = _rows(spark, path, kept, holders).filter(F.col("origin_load") != load_id)
            if not _replace(spark, path, kept, rows, {day: holders}, {load_id}):
                raise RuntimeError(f"{day} was changed by another load or merge")
    remove(spark, marks)


def _states(spark: SparkSession, folders: str) -> dict[str, tuple]:
    """Listing of each folder of a load: at most one per day that it wrote."""
    found = matching(spark, folders)
    if not found:
        return {}
    return {r[0]: tuple(r[1:]) for r in folder_states(spark, *found).collect()}


def _write_by_day(rows: DataFrame, path: str, kept: Kept) -> None:
    (
        rows.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", *kept.order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "load_id")
        .parquet(path)
    )


def write_load(rows: DataFrame, path: str, load_id: str, kept: Kept = FLAT) -> None:
    """Store the rows of one load by day.

    A load replaces all that it has written itself: a repeated one changes nothing, a corrected one
    also takes back the days that it no longer has, and other loads of the same days stay. Each load
    needs an id of its own, of letters, digits, '.', '_' and '-'. If the write fails half way,
    repeat it. The rebalance puts a day's rows together and splits a day that outgrows the advisory
    partition size, so no task and no file takes a whole hot day.
    """
    if not re.fullmatch(r"[\w.-]+", load_id, re.ASCII) or load_id.startswith(MERGED):
        raise ValueError(f"load_id must be of letters, digits, '.', '_' and '-': {load_id!r}")
    spark = rows.sparkSession
    _take_out(spark, path, load_id, kept)
    mine = f"{path.rstrip('/')}/event_date=*/load_id={load_id}"
    before = _states(spark, mine)
    _write_by_day(rows.withColumn("load_id", F.lit(load_id)), path, kept)
    if before:
        # The write has put new files wherever it had rows; a folder with the files of before is
        # of a day that the load no longer has.
        for folder, state in _states(spark, mine).items():
            if before.get(folder) == state:
                remove(spark, folder)


def read_loads(spark: SparkSession, path: str, kept: Kept = FLAT) -> DataFrame:
    """All rows. Loads that have been merged are read from their merged folder only, also while a
    merge has not yet taken their own folders away."""
    rows = spark.read.schema(f"{kept.columns}, load_id string").parquet(path)
    for day, folders in superseded(spark, path).items():
        rows = rows.filter(~(_is_day(day) & F.col("load_id").isin(folders)))
    return rows.drop("load_id")


def loads(spark: SparkSession, path: str) -> DataFrame:
    """(event_date, load_id, merged, rows) of every load in the table. Only the column that tells
    the load is read."""
    root = path.rstrip("/")
    hidden = superseded(spark, path)
    seen = matching(spark, f"{root}/event_date=*/load_id=*")
    seen = [f for f in seen if _parts(f)[1] not in hidden.get(_parts(f)[0], ())]
    kind = "event_date date, load_id string, merged boolean, rows bigint"
    if not seen:
        return spark.createDataFrame([], kind)
    stored = "event_date date, load_id string, origin_load string"
    rows = spark.read.schema(stored).option("basePath", root).parquet(*seen)
    return rows.groupBy(
        "event_date",
        F.coalesce("origin_load", "load_id").alias("load_id"),
        F.col("origin_load").isNotNull().alias("merged"),
    ).agg(F.count(F.lit(1)).alias("rows"))

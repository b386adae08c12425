"""Journeys kept from load to load, so that a new day does not number the past again.

Beside the log stands, for every user and level, what was done so far: the number of completions, the
first and last time, the newest loadout. A load is numbered on from there, which takes the load and
this state, not the log. A user one of whose new events is not later than all the events seen before
is *late*: the journey of such users, and of no others, is made anew from the log, and the rows it had
are left out from then on. So after every load the kept journeys are those of the whole log.

A version of the table is one folder, `v=K`: the numbered rows of the load (`rows`), the users made
anew (`late`) and the state after it. It counts once its commit file is there, which is written last;
a version that was stopped before is written again. Every `fold_after` versions all rows are written
into the new one, and earlier ones are not read any more.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrail.functions.times import HOUR
from playtrail.operators.journey import (
    AT,
    journey_rows,
    numbered_completions,
    summed_cells,
    timeline,
)
from playtrail.sources.folders import matching, read_text, remove, write_text
from playtrail.sources.schema import USER

LOADOUT_TYPE = "struct<event_timestamp:bigint,event_id:bigint,unit_names:string>"
ROWS = (
    f"{USER} string, number bigint, level bigint, event_timestamp bigint, "
    f"duration_seconds_dbl double, loadout {LOADOUT_TYPE}, start_at bigint, previous_at bigint"
)
STATE = (
    f"{USER} string, level bigint, done bigint, counted bigint, first_at bigint, last_at bigint, "
    f"newest {LOADOUT_TYPE}"
)
FOLD_AFTER = 50


def _commits(spark: SparkSession, path: str) -> list[dict]:
    """Commits in order. Their names hold the version and the load, their text the rest; only the
    last text is read."""
    found = []
    for file in matching(spark, f"{path.rstrip('/')}/_commits/v=*"):
        version, load_id = file.rsplit("/", 1)[1].split("=", 1)[1].split("~", 1)
        found.append({"version": int(version), "load_id": load_id, "file": file})
    if found:
        found[-1] |= json.loads(read_text(spark, found[-1]["file"]))
    return found


def _state_of(rows: DataFrame) -> DataFrame:
    """What some events add to the state."""
    cells = summed_cells(rows.withColumn("slice", F.lit(0)), F.lit(True), loadouts=True)
    return _added(cells.drop("slice"))


def _added(cells: DataFrame) -> DataFrame:
    return cells.groupBy(USER, "level").agg(
        F.sum("done").alias("done"),
        F.sum("counted").alias("counted"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.max("newest").alias("newest"),
    )


def _numbered(events: DataFrame, n: int, slice_width: int, carried: DataFrame | None) -> DataFrame:
    numbered = numbered_completions(
        events,
        n,
        None,
        loadouts=True,
        stop_after=n,
        slice_width=slice_width,
        carried=carried,
    )
    return numbered.select(*(c.split()[0] for c in ROWS.replace(LOADOUT_TYPE, "x").split(", ")))


def update_journeys(
    load: DataFrame,
    log: DataFrame,
    path: str,
    load_id: str,
    n: int = 1000,
    slice_width: int = HOUR,
    fold_after: int = FOLD_AFTER,
) -> None:
    """Take over one load of flat events. `log` is the whole flat log with this load in it; it is
    read only where users are late, or where a load comes a second time, perhaps corrected: then all
    journeys are made anew. One update at a time."""
    spark = load.sparkSession
    root = path.rstrip("/")
    commits = _commits(spark, root)
    last = commits[-1] if commits else None
    if last and last["n"] != n:
        raise ValueError(f"this table keeps journeys of {last['n']} completions")
    version = last["version"] + 1 if last else 1
    base = last["base"] if last else version
    here = f"{root}/v={version}"
    remove(spark, here)
    if not last or any(c["load_id"] == load_id for c in commits):
        every = journey_rows(log)
        _numbered(every, n, slice_width, None).write.parquet(f"{here}/rows")
        _state_of(every).write.parquet(f"{here}/state")
        base = version
    else:
        state = spark.read.schema(STATE).parquet(f"{root}/v={last['version']}/state")
        rows = journey_rows(load)
        until = state.groupBy(USER).agg(
            F.max(F.greatest("last_at", "newest.event_timestamp")).alias("until")
        )
        late = rows.join(until, USER).filter(F.col(AT) <= F.col("until")).select(USER).distinct()
        late.write.parquet(f"{here}/late")
        late = spark.read.schema(f"{USER} string").parquet(f"{here}/late")
        on_time = rows.join(late, USER, "left_anti")
        carried = state.join(on_time.select(USER).distinct(), USER, "left_semi")
        numbered = _numbered(on_time, n, slice_width, carried)
        new_state = _added(state.join(late, USER, "left_anti").unionByName(_state_of(on_time)))
        if not late.isEmpty():
            again = journey_rows(log).join(late, USER, "left_semi")
            numbered = numbered.unionByName(_numbered(again, n, slice_width, None))
            new_state = new_state.unionByName(_state_of(again))
        if version - base >= fold_after:
            # Late users' earlier rows go; all others are taken along.
            kept = _current(spark, root, base, last["version"]).join(late, USER, "left_anti")
            numbered = numbered.unionByName(kept)
            base = version
        numbered.write.parquet(f"{here}/rows")
        new_state.write.parquet(f"{here}/state")
    text = json.dumps({"n": n, "base": base})
    write_text(spark, f"{root}/_commits/v={version:09d}~{load_id}", text)


def _current(spark: SparkSession, root: str, base: int, last: int) -> DataFrame:
    """Rows of the versions from `base` on, without those of users made anew later."""
    versions = range(base, last + 1)
    kept = F.regexp_extract(F.col("_metadata.file_path"), "/v=(\\d+)/", 1).cast("int")
    rows = (
        spark.read.schema(ROWS)
        .parquet(*(f"{root}/v={v}/rows" for v in versions))
        .withColumn("version", kept)
    )
    if last == base:
        return rows.drop("version")
    late = spark.read.schema(f"{USER} string").parquet(
        *(f"{root}/v={v}/late" for v in versions if v > base)
    )
    anew = late.withColumn("anew", kept).groupBy(USER).agg(F.max("anew").alias("anew"))
    current = rows.join(anew, USER, "left")
    return current.filter(F.col("version") >= F.coalesce("anew", F.lit(0))).drop("version", "anew")


def read_journeys(spark: SparkSession, path: str) -> DataFrame:
    """What `journey.time_to_n_levels` gives over the whole log, unsorted."""
    root = path.rstrip("/")
    last = _commits(spark, root)[-1]
    state = spark.read.schema(STATE).parquet(f"{root}/v={last['version']}/state")
    leveled = state.filter(F.col("level").isNotNull() & (F.col("done") > 0))
    far = leveled.groupBy(USER).agg(F.count("*").alias("n")).filter(F.col("n") >= last["n"])
    rows = _current(spark, root, last["base"], last["version"])
    return timeline(rows.join(far.select(USER), USER, "left_semi"))

"""Player journeys: one user's level completions in order, with the loadout played and the time
taken.

A journey numbers all completions of a user, so the plain form is a window per user, and a user who
holds a third of the log would be one task. Here time is cut into slices (one hour by default):

1. *cells*: completions and loadouts are summed per (user, level, slice);
2. windows over a user's cells give, for each slice, what came before it: the number of earlier
   completions, the last of them, and the newest loadout of each level; they also say whether the
   user qualifies at all;
3. rows meet their cell in an equi-join on (user, level, slice), which drops the other users and
   everything past the n-th completion, and are then ordered within (user, slice) only.

The largest group is one user's hour of rows, or one user's cells: levels played times hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions.times import (
    DAY,
    HOUR,
    clock_text,
    duration_text,
    elapsed,
    second_text,
    slice_of,
    to_timestamp_ntz,
    utc_date,
)
from playtrail.sources.schema import LEVEL_COMPLETE, LOADOUT, USER

# Who qualifies for a journey of n levels.
DISTINCT_LEVELS = "distinct_levels"  # completed n different levels
COMPLETIONS = "completions"  # completed a level n times
FROM_FIRST = "from_first"  # completed level 1, and level n or a higher one
RULES = (DISTINCT_LEVELS, COMPLETIONS, FROM_FIRST)

# The completions at which the summary looks.
MILESTONES = (100, 250, 500, 750, 1000)

AT = "event_timestamp"
BEFORE_ALL = -(2**62)


def _is(event: str) -> Column:
    return F.col("event_name") == event


def _has_level() -> Column:
    return F.col("level").isNotNull()


def qualified_users(events: DataFrame, n: int = 1000, rule: str = DISTINCT_LEVELS) -> DataFrame:
    """Users who went far enough; completions without a level do not count."""
    done = events.filter(_is(LEVEL_COMPLETE) & _has_level() & F.col(USER).isNotNull())
    if rule == DISTINCT_LEVELS:
        per_user = done.select(USER, "level").distinct().groupBy(USER).agg(F.count("*").alias("n"))
        return per_user.filter(F.col("n") >= n).select(USER)
    if rule == COMPLETIONS:
        per_user = done.groupBy(USER).agg(F.count("*").alias("n"))
        return per_user.filter(F.col("n") >= n).select(USER)
    if rule == FROM_FIRST:
        per_user = done.groupBy(USER).agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
        return per_user.filter((F.col("lo") == 1) & (F.col("hi") >= n)).select(USER)
    raise ValueError(f"rule must be one of {RULES}")


def pick_users(users: DataFrame, k: int = 1, seed: str = "0") -> DataFrame:
    """k users in a random but repeatable order: the order of a seeded hash."""
    return users.orderBy(F.md5(F.concat(F.lit(seed), F.col(USER))), USER).limit(k)


def _chosen(
    events: DataFrame,
    n: int,
    rule: str,
    users: Sequence[str] | None,
    sample: int | None,
    seed: str,
) -> DataFrame:
    if users is not None:
        return events.filter(F.col(USER).isin(list(users)))
    if sample is None:
        return events
    return events.join(pick_users(qualified_users(events, n, rule), sample, seed), USER, "left_semi")


def _in_order(
    journeys: DataFrame, number: str, users: Sequence[str] | None, sample: int | None
) -> DataFrame:
    """Named or drawn users' journeys in time order. All journeys stay unsorted: a global sort of
    them would only serve display."""
    return journeys if users is None and sample is None else journeys.orderBy(USER, number)


def _loadout() -> Column:
    """Newest-first order: time, then id, then text."""
    return F.when(_is(LOADOUT), F.struct(AT, "event_id", "unit_names"))


def summed_cells(rows: DataFrame, in_play: Column, loadouts: bool) -> DataFrame:
    """Completions and the newest loadout per user, level and slice."""
    moment = F.when(in_play, F.col(AT))
    cells = (
        rows.filter(_is(LEVEL_COMPLETE))
        .groupBy(USER, "level", "slice")
        .agg(
            F.count("*").alias("done"),
            F.count(moment).alias("counted"),
            F.min(moment).alias("first_at"),
            F.max(moment).alias("last_at"),
        )
    )
    if loadouts:
        # Apart from the completions: a maximum over text is aggregated by sorting, and only the
        # loadouts should pay for that.
        newest = (
            rows.filter(_is(LOADOUT))
            .groupBy(USER, "level", "slice")
            .agg(F.max(_loadout()).alias("newest"))
            .withColumns({"done": F.lit(0).cast("bigint"), "counted": F.lit(0).cast("bigint")})
        )
        cells = cells.unionByName(newest, allowMissingColumns=True)
    return cells


def _cells(
    rows: DataFrame,
    n: int,
    rule: str | None,
    in_play: Column,
    loadouts: bool,
    stop_after: int | None,
    carried: DataFrame | None,
) -> DataFrame:
    cells = summed_cells(rows, in_play, loadouts)
    if carried is not None:
        # What the rows' users did before any of the rows is one more, first slice.
        first = F.lit(BEFORE_ALL).cast("bigint")
        cells = cells.unionByName(carried.withColumn("slice", first), allowMissingColumns=True)
    user = Window.partitionBy(USER)
    before = user.orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    same_level = Window.partitionBy(USER, "level")
    before_here = same_level.orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)

    # By user first: one exchange then also serves the windows by user and level.
    cells = (
        cells.withColumn("start_at", F.min("first_at").over(user))
        .withColumn("earlier", F.coalesce(F.sum("counted").over(before), F.lit(0)))
        .withColumn("before_at", F.max("last_at").over(before))
    )
    if loadouts:
        cells = cells.withColumn("carried", F.max("newest").over(before_here))
    leveled = F.when(_has_level() & (F.col("done") > 0), F.col("level"))
    if rule == DISTINCT_LEVELS:
        first_slice = F.min(F.when(F.col("done") > 0, F.col("slice"))).over(same_level)
        cells = cells.withColumn(
            "new_level", leveled.isNotNull() & (F.col("slice") == first_slice)
        )
        qualifies = F.count_if("new_level").over(user) >= n
    elif rule == COMPLETIONS:
        qualifies = F.sum(F.when(_has_level(), F.col("done"))).over(user) >= n
    elif rule is None:
        qualifies = F.lit(True)
    elif rule == FROM_FIRST:
        qualifies = (F.min(leveled).over(user) == 1) & (F.max(leveled).over(user) >= n)
    else:
        raise ValueError(f"rule must be one of {RULES}")
    kept = cells.withColumn("qualifies", qualifies).filter(
        F.col("qualifies") & (F.col("counted") > 0)
    )
    if stop_after is not None:
        kept = kept.filter(F.col("earlier") < stop_after)
    return kept.select(
        F.col(USER).alias("cell_user"),
        F.col("level").alias("cell_level"),
        F.col("slice").alias("cell_slice"),
        "earlier",
        "before_at",
        "start_at",
        *(["carried"] if loadouts else []),
    )


def journey_rows(events: DataFrame, loadouts: bool = True) -> DataFrame:
    """The events that journeys are made of."""
    done = _is(LEVEL_COMPLETE)
    wanted = done | (_is(LOADOUT) & _has_level()) if loadouts else done
    return events.filter(wanted & F.col(USER).isNotNull())


def numbered_completions(
    events: DataFrame,
    n: int,
    rule: str | None,
    bounded: bool = False,
    loadouts: bool = False,
    stop_after: int | None = None,
    slice_width: int = HOUR,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Completions of the qualified users, of all without a rule, with `number`, `previous_at`,
    `start_at`, `loadout`. `carried` holds what the users have done before the events, summed by
    user and level; numbers, times and loadouts then go on from there."""
    done, level = _is(LEVEL_COMPLETE), F.col("level")
    in_play = level.between(1, n) if bounded else F.lit(True)
    rows = journey_rows(events, loadouts).withColumn("slice", slice_of(F.col(AT), slice_width))
    cells = _cells(rows, n, rule, in_play, loadouts, stop_after, carried)
    # Levels meet null-safe: a completion without a level is numbered too.
    same_cell = (
        (F.col(USER) == F.col("cell_user"))
        & level.eqNullSafe(F.col("cell_level"))
        & (F.col("slice") == F.col("cell_slice"))
    )
    here = Window.partitionBy(USER, "slice").orderBy(
        "event_timestamp", "event_id", "level", "duration_seconds_dbl"
    )
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    at_level = (
        Window.partitionBy(USER, "slice", "level")
        .orderBy("event_timestamp")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = (
        rows.join(cells, same_cell)
        .withColumn("number", F.col("earlier") + F.count_if(done).over(so_far))
        .withColumn(
            "previous_at",
            F.coalesce(F.max(F.when(done, F.col(AT))).over(earlier), F.col("before_at")),
        )
    )
    if loadouts:
        played = F.coalesce(F.max(_loadout()).over(at_level), F.col("carried"))
        numbered = numbered.withColumn("loadout", played).filter(done)
    if stop_after is not None:
        numbered = numbered.filter(F.col("number") <= stop_after)
    return numbered


def user_level_progression(
    events: DataFrame,
    min_levels: int = 1000,
    users: Sequence[str] | None = None,
    sample: int | None = None,
    seed: str = "0",
    slice_width: int = HOUR,
) -> DataFrame:
    """Every completion of the users with `min_levels` different levels, numbered in time order.

    All qualified users come out, unsorted, unless `users` names some or `sample` draws that many of
    them; these come in time order.
    """
    chosen = _chosen(events, min_levels, DISTINCT_LEVELS, users, sample, seed)
    numbered = numbered_completions(chosen, min_levels, DISTINCT_LEVELS, slice_width=slice_width)
    moment = to_timestamp_ntz(F.col(AT))
    journeys = numbered.select(
        USER,
        "event_name",
        moment.alias("completion_timestamp"),
        utc_date(F.col(AT)).alias("completion_date"),
        clock_text(F.col(AT)).alias("completion_time"),
        "level",
        F.col("duration_seconds_dbl").alias("duration_seconds"),
        elapsed(F.col(AT), F.col("start_at")).alias("seconds_since_first_level"),
        F.col("number").alias("level_completion_number"),
    )
    return _in_order(journeys, "level_completion_number", users, sample)


def timeline(numbered: DataFrame) -> DataFrame:
    moment = to_timestamp_ntz(F.col(AT))
    since_start = elapsed(F.col(AT), F.col("start_at"))
    return numbered.select(
        USER,
        F.col("number").alias("completion_number"),
        "level",
        moment.alias("completion_timestamp"),
        second_text(F.col(AT)).alias("formatted_time"),
        F.col("duration_seconds_dbl").alias("level_duration_seconds"),
        F.col("loadout.unit_names").alias("units_used"),
        since_start.alias("total_seconds_elapsed"),
        duration_text(since_start).alias("elapsed_time_formatted"),
        elapsed(F.col(AT), F.col("previous_at")).alias("seconds_since_previous_level"),
        elapsed(F.col(AT), F.col("loadout.event_timestamp")).alias(
            "seconds_between_loadout_and_completion"
        ),
    )


def time_to_n_levels(
    events: DataFrame,
    n: int = 1000,
    users: Sequence[str] | None = None,
    sample: int | None = None,
    seed: str = "0",
    slice_width: int = HOUR,
) -> DataFrame:
    """First n completions, replays included, of the users with n different levels; each with the
    newest loadout at or before it for the same level."""
    chosen = _chosen(events, n, DISTINCT_LEVELS, users, sample, seed)
    numbered = numbered_completions(
        chosen, n, DISTINCT_LEVELS, loadouts=True, stop_after=n, slice_width=slice_width
    )
    return _in_order(timeline(numbered), "completion_number", users, sample)


def time_to_n_levels_from_first(
    events: DataFrame,
    n: int = 1000,
    users: Sequence[str] | None = None,
    sample: int | None = None,
    seed: str = "0",
    slice_width: int = HOUR,
) -> DataFrame:
    """The same for the users who started at level 1 and reached level n: all their completions of
    the levels 1 to n."""
    chosen = _chosen(events, n, FROM_FIRST, users, sample, seed)
    numbered = numbered_completions(
        chosen, n, FROM_FIRST, bounded=True, loadouts=True, slice_width=slice_width
    )
    return _in_order(timeline(numbered), "completion_number", users, sample)


def milestone_summary(
    events: DataFrame,
    n: int = 1000,
    milestones: Sequence[int] = MILESTONES,
    users: Sequence[str] | None = None,
    sample: int | None = None,
    seed: str = "0",
    slice_width: int = HOUR,
) -> DataFrame:
    """One row per user with n completions: time from the first to the n-th and to each milestone.
    The mean is over n, not over the n - 1 gaps."""
    chosen = _chosen(events, n, COMPLETIONS, users, sample, seed)
    numbered = numbered_completions(
        chosen, n, COMPLETIONS, stop_after=max(n, *milestones), slice_width=slice_width
    )
    marks = sorted({1, n, *milestones})
    per_user = (
        numbered.filter(F.col("number").isin(marks))
        .groupBy(USER)
        .agg(*[F.max(F.when(F.col("number") == k, F.col(AT))).alias(f"at_{k}") for k in marks])
    )
    start, finish = F.col("at_1"), F.col(f"at_{n}")
    seconds = elapsed(finish, start)
    return per_user.select(
        USER,
        to_timestamp_ntz(start).alias("first_level_time"),
        to_timestamp_ntz(finish).alias(f"level_{n}_time"),
        elapsed(finish, start, HOUR).alias("total_hours"),
        elapsed(finish, start, DAY).alias("total_days"),
        duration_text(seconds).alias(f"time_to_{n}_levels"),
        (seconds / F.lit(float(n))).alias("avg_seconds_per_level"),
        *[
            elapsed(F.col(f"at_{k}"), start, HOUR).alias(f"hours_to_{k}")
            for k in milestones
        ],
    )

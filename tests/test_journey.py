"""Journeys against a plain per-user walk through the events."""

import random
from collections import defaultdict

import pytest
from small import event, flat, rows, table

from playtrail.functions.times import HOUR, MINUTE
from playtrail.operators import journey

N = 4


def walk(events, n, rule, bounded=False, stop=True):
    """Completions of qualified users in order, as (user, number, level, time, start, previous,
    loadout text, loadout time)."""
    by_user = defaultdict(list)
    for user, at, name, *_, bag in events:
        params = dict(bag)
        level = params.get("level", (None, None))[1]
        units = params.get("unit_names", (None,))[0]
        by_user[user].append((at, name, level, units))
    found = []
    for user, log in by_user.items():
        if user is None:
            continue
        done = [(at, lv) for at, name, lv, _ in log if name == "level_complete"]
        known = [lv for _, lv in done if lv is not None]
        fits = {
            journey.DISTINCT_LEVELS: len(set(known)) >= n,
            journey.COMPLETIONS: len(known) >= n,
            journey.FROM_FIRST: bool(known) and min(known) == 1 and max(known) >= n,
        }[rule]
        if not fits:
            continue
        if bounded:
            done = [(at, lv) for at, lv in done if lv is not None and 1 <= lv <= n]
        done.sort(key=lambda d: (d[0], d[1] is not None, d[1] or 0))
        previous = None
        for number, (at, level) in enumerate(done, 1):
            if stop and number > n:
                break
            played = [
                (t, units or "")
                for t, name, lv, units in log
                if name == "battle_start_loadout" and lv is not None and lv == level and t <= at
            ]
            newest = max(played) if played else (None, None)
            found.append((user, number, level, at, done[0][0], previous, newest[1] or None, newest[0]))
            previous = at
    return sorted(found, key=lambda f: f[:2])


def make_log(seed, users=12, hot=400):
    """A few short journeys and one long one; times repeat and span slice borders."""
    rnd = random.Random(seed)
    log = []

    def add(user):
        at = rnd.randrange(30 * HOUR // (7 * MINUTE)) * 7 * MINUTE + rnd.choice((0, 0, 1, 999_999))
        named = {}
        if rnd.random() < 0.9:
            named["level"] = rnd.randrange(1, 7)
        name = rnd.choice(("level_complete", "battle_start_loadout", "level_fail"))
        if name == "battle_start_loadout" and rnd.random() < 0.9:
            named["unit_names"] = rnd.choice(("A", "B", "C,D"))
        log.append(event(user, name, at, duration_seconds=rnd.random(), **named))

    for _ in range(hot):
        add("hot")
    for u in range(users):
        for _ in range(rnd.randrange(1, 25)):
            add(f"u{u:02d}")
    add(None)
    return log


def timeline(df):
    got = []
    for r in df.collect():
        at = r.completion_timestamp
        got.append(
            (
                r.user_pseudo_id,
                r.completion_number,
                r.level,
                at,
                r.total_seconds_elapsed,
                r.seconds_since_previous_level,
                r.units_used,
                r.seconds_between_loadout_and_completion,
            )
        )
    return sorted(got, key=lambda g: g[:2])


def expected_timeline(walked):
    from datetime import datetime, timedelta

    def seconds(a, b):
        return None if b is None else (a - b) // 1_000_000

    return [
        (
            user,
            number,
            level,
            datetime(1970, 1, 1) + timedelta(microseconds=at),
            seconds(at, start),
            seconds(at, previous),
            units,
            seconds(at, loaded),
        )
        for user, number, level, at, start, previous, units, loaded in walked
    ]


@pytest.mark.parametrize("width", [HOUR, 5 * MINUTE, 24 * HOUR])
@pytest.mark.parametrize("seed", [1, 2])
def test_time_to_n_levels(spark, seed, width):
    log = make_log(seed)
    events = flat(spark, log)
    got = timeline(journey.time_to_n_levels(events, N, slice_width=width))
    assert got == expected_timeline(walk(log, N, journey.DISTINCT_LEVELS))
    got = timeline(journey.time_to_n_levels_from_first(events, N, slice_width=width))
    assert got == expected_timeline(walk(log, N, journey.FROM_FIRST, bounded=True, stop=False))


@pytest.mark.parametrize("seed", [3, 4])
def test_progression(spark, seed):
    log = make_log(seed)
    got = [
        (r.user_pseudo_id, r.level_completion_number, r.level, r.seconds_since_first_level)
        for r in journey.user_level_progression(flat(spark, log), N).collect()
    ]
    walked = walk(log, N, journey.DISTINCT_LEVELS, stop=False)
    assert sorted(got) == [(w[0], w[1], w[2], (w[3] - w[4]) // 1_000_000) for w in walked]


def test_qualified_users(spark):
    log = make_log(5, users=30)
    events = flat(spark, log)
    for rule in journey.RULES:
        expected = {w[0] for w in walk(log, N, rule)}
        assert {u for u, in table(journey.qualified_users(events, N, rule), "user_pseudo_id")} == (
            expected
        )
        assert 0 < len(expected) < 31


def test_named_and_drawn_users(spark):
    log = make_log(6)
    events = flat(spark, log)
    everyone = rows(journey.time_to_n_levels(events, N))
    users = sorted({r["user_pseudo_id"] for r in everyone})
    some = journey.time_to_n_levels(events, N, users=users[:2])
    assert rows(some) == [r for r in everyone if r["user_pseudo_id"] in users[:2]]
    drawn = {
        seed: rows(journey.time_to_n_levels(events, N, sample=1, seed=seed)) for seed in "1234567"
    }
    assert rows(journey.time_to_n_levels(events, N, sample=1, seed="1")) == drawn["1"]
    names = {r["user_pseudo_id"] for part in drawn.values() for r in part}
    assert len(names) > 1 and names <= set(users)
    assert all(len({r["user_pseudo_id"] for r in part}) == 1 for part in drawn.values())


def test_newest_loadout_edges(spark):
    def done(at, **kw):
        return event("u", "level_complete", at, **kw)

    def load(at, units=None, **kw):
        named = {} if units is None else {"unit_names": units}
        return event("u", "battle_start_loadout", at, **named, **kw)

    far = 50 * HOUR
    log = [
        load(10, "old", level=1),
        load(20, "same moment", level=1),
        done(20, level=1),
        load(30, level=1),  # newest, without units
        done(40, level=1),
        load(45, "no level"),
        done(50),  # no level: no loadout
        done(far, level=1),  # loadout from another slice
        load(far + 1, "later", level=1),
        done(far + 2, level=2),  # never loaded
    ]
    got = journey.time_to_n_levels(flat(spark, log), 2)
    got = sorted(table(got, "completion_number", "level", "units_used"))
    assert got == [(1, 1, "same moment"), (2, 1, None)]
    every = timeline(journey.time_to_n_levels_from_first(flat(spark, log), 2))
    assert [(e[1], e[2], e[6], e[7]) for e in every] == [
        (1, 1, "same moment", 0),
        (2, 1, None, 0),
        (3, 1, None, (far - 30) // 1_000_000),
        (4, 2, None, None),
    ]


def test_milestones(spark):
    hours = {"exact": range(4), "short": range(3), "long": range(0, 45, 5)}
    log = [
        event(user, "level_complete", h * HOUR + 30 * MINUTE, level=1)
        for user, times in hours.items()
        for h in times
    ]
    log.append(event("long", "level_complete", 0))  # no level, yet numbered
    got = journey.milestone_summary(flat(spark, log), 4, (2, 4, 6))
    assert got.columns[2] == "level_4_time"
    assert sorted(
        table(
            got,
            "user_pseudo_id",
            "total_hours",
            "total_days",
            "time_to_4_levels",
            "avg_seconds_per_level",
            "hours_to_2",
            "hours_to_6",
        )
    ) == [
        ("exact", 3, 0, "0 days, 3 hours, 0 minutes", 2700.0, 1, None),
        ("long", 10, 0, "0 days, 10 hours, 30 minutes", 9450.0, 0, 20),
    ]

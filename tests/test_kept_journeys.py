"""Journeys kept from load to load against journeys of the whole log."""

import random

import pytest
from pyspark.sql import functions as F
from small import event, flat, rows

from playtrail.operators.journey import time_to_n_levels
from playtrail.sources import journeys as kept_module
from playtrail.sources.journeys import read_journeys, update_journeys
from playtrail.sources.sample_tables import sample_events

SF = "/root/testdata/sf0.001"


def random_log(seed, users=6, n=260):
    """Completions and loadouts of few users, one of them hot, with many equal times."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        user = draw.choice(["hot"] * users + [f"u{i}" for i in range(users)] + [None])
        at = f"2024-01-0{draw.randrange(1, 6)} {draw.randrange(0, 4):02d}:0{draw.randrange(0, 6)}:00"
        level = draw.choice([1, 2, 3, 4, None])
        more = {} if level is None else {"level": level}
        name = draw.choice(["level_complete", "level_complete", "battle_start_loadout", "level_fail"])
        if name == "battle_start_loadout":
            more["unit_names"] = draw.choice(["A", "B,C", "D"])
        if name == "level_complete":
            more["duration_seconds"] = draw.random()
        out.append(event(user, name, at, **more))
    return out


def numbered_ids(events):
    """The log gives every event an id, as sequences need one to break ties."""
    return events.withColumn("event_id", F.xxhash64(*[c for c in events.columns if c != "event_id"]))


def union(parts):
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


@pytest.mark.parametrize("seed, by_day", [(1, True), (2, False), (3, False)])
def test_equal_to_the_whole_log_after_each_load(spark, tmp_path, seed, by_day):
    """Loads by day, where nobody is late, and loads of any days, where most users are."""
    events = numbered_ids(flat(spark, random_log(seed))).cache()
    key = F.day("event_date") - 1 if by_day else F.abs(F.hash("event_id", F.lit(seed))) % 5
    path = str(tmp_path / "journeys")
    seen = []
    for k in range(5):
        seen.append(events.filter(key == k))
        log = union(seen)
        update_journeys(seen[-1], log, path, f"load-{k}", 3, fold_after=2)
        assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(log, 3))
    anew = [spark.read.parquet(f"{path}/v={v}/late").count() for v in range(2, 6)]
    assert (sum(anew) == 0) == by_day
    assert rows(time_to_n_levels(events, 3))


def test_the_log_is_not_read_when_nobody_is_late(spark, tmp_path):
    events = numbered_ids(flat(spark, random_log(7))).cache()
    path = str(tmp_path / "journeys")
    first, second = (events.filter(F.day("event_date") % 6 <= d) for d in (2, 0))
    second = events.filter(F.day("event_date") > 2)
    update_journeys(first.filter(F.day("event_date") <= 2), first.filter(F.day("event_date") <= 2), path, "a", 3)

    class Closed:
        def __getattr__(self, name):
            raise AssertionError("the log was read")

    update_journeys(second, Closed(), path, "b", 3)
    log = events.filter(F.day("event_date") <= 2).unionByName(second)
    assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(log, 3))


def test_repeated_and_corrected_loads(spark, tmp_path):
    events = numbered_ids(flat(spark, random_log(11))).cache()
    parts = [events.filter(F.abs(F.hash("event_id")) % 3 == k) for k in range(3)]
    path = str(tmp_path / "journeys")
    for k in range(3):
        update_journeys(parts[k], union(parts[: k + 1]), path, f"load-{k}", 3)
    update_journeys(parts[1], events, path, "load-1", 3)
    assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(events, 3))
    fewer = parts[1].filter(F.day("event_date") < 3)
    log = union([parts[0], fewer, parts[2]])
    update_journeys(fewer, log, path, "load-1", 3)
    assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(log, 3))


def test_a_stopped_update_is_done_again(spark, tmp_path, monkeypatch):
    events = numbered_ids(flat(spark, random_log(13))).cache()
    half = events.filter(F.day("event_date") <= 3)
    path = str(tmp_path / "journeys")
    update_journeys(half, half, path, "a", 3)
    before = rows(read_journeys(spark, path))

    def stopped(*_):
        raise OSError("stopped")

    rest = events.filter(F.day("event_date") > 3)
    with monkeypatch.context() as patched:
        patched.setattr(kept_module, "write_text", stopped)
        with pytest.raises(OSError):
            update_journeys(rest, events, path, "b", 3)
    assert rows(read_journeys(spark, path)) == before
    update_journeys(rest, events, path, "b", 3)
    assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(events, 3))


def test_empty_loads_and_another_n(spark, tmp_path):
    events = numbered_ids(flat(spark, random_log(17))).cache()
    path = str(tmp_path / "journeys")
    none = events.limit(0)
    update_journeys(none, none, path, "a", 2)
    assert read_journeys(spark, path).count() == 0
    update_journeys(events, events, path, "b", 2)
    update_journeys(none, events, path, "c", 2)
    assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(events, 2))
    with pytest.raises(ValueError):
        update_journeys(none, events, path, "d", 3)


def test_sample_log_by_days(spark, tmp_path):
    log = sample_events(spark, SF).cache()
    path = str(tmp_path / "journeys")
    for k, (low, high) in enumerate((("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-02-28"))):
        seen = log.filter(F.col("event_date") <= high)
        update_journeys(seen.filter(F.col("event_date") >= low), seen, path, f"load-{k}", 5)
    assert rows(read_journeys(spark, path)) == rows(time_to_n_levels(log, 5))

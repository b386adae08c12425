"""Scalar helpers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from small import micros

from playtrail.functions.numeric import percent2, ratio2, round2
from playtrail.functions.texts import (
    ad_label,
    clean_loadout,
    clean_unit_name,
    short_ad_label,
    split_units,
    trim_space,
)
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


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_round2_takes_halves_up(spark):
    values = [1.005, 2.675, -1.005, 0.125, None]
    expected = [1.01, 2.68, -1.01, 0.13, None]
    got = [one(spark, round2(F.lit(v).cast("double")))[0] for v in values]
    assert got == expected
    odd = [float("inf"), -1e300, float("nan")]
    got = [one(spark, round2(F.lit(v)))[0] for v in odd]
    assert got[:2] == odd[:2] and got[2] != got[2]


def test_ratios(spark):
    n, zero = F.lit(3), F.lit(0)
    assert one(spark, ratio2(F.lit(2), n), percent2(F.lit(2), n)) == (0.67, 66.67)
    assert one(spark, ratio2(n, zero), percent2(n, zero)) == (None, None)


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_times_ignore_the_session_zone(spark, setting, zone):
    setting(session__timeZone=zone)
    # 02:30 on this day does not exist in Los Angeles.
    at = F.lit(micros("2024-03-10 02:30:07.000123"))
    assert one(spark, to_timestamp_ntz(at), utc_date(at), second_text(at), clock_text(at)) == (
        datetime(2024, 3, 10, 2, 30, 7, 123),
        date(2024, 3, 10),
        "2024-03-10 02:30:07",
        "02:30:07.000123",
    )


def test_day_borders(spark):
    last = F.lit(micros("2024-01-01 23:59:59.999999"))
    before_epoch = F.lit(-1)
    assert one(spark, utc_date(last), utc_date(before_epoch), slice_of(before_epoch, HOUR)) == (
        date(2024, 1, 1),
        date(1969, 12, 31),
        -1,
    )


def test_elapsed_truncates(spark):
    a, b = F.lit(0), F.lit(2 * HOUR - 1)
    assert one(spark, elapsed(b, a), elapsed(b, a, HOUR), elapsed(a, b, HOUR), elapsed(b, a, DAY)) == (
        7199,
        1,
        -1,
        0,
    )


def test_duration_text(spark):
    seconds = F.lit(2 * 86400 + 3 * 3600 + 4 * 60 + 5)
    nothing = F.lit(None).cast("bigint")
    assert one(spark, duration_text(seconds), duration_text(nothing)) == (
        "2 days, 3 hours, 4 minutes",
        None,
    )


def test_texts(spark):
    loadout = F.lit(" 9 - Stinger Drone ,12-Tank,\t Scout ,")
    assert one(spark, split_units(loadout))[0] == ["9 - Stinger Drone", "12-Tank", "Scout", ""]
    assert one(spark, clean_loadout(loadout))[0] == "Stinger Drone, Tank, Scout, "
    assert one(spark, clean_unit_name(F.lit("No 9 - X")), trim_space(F.lit("　a b\n"))) == (
        "No 9 - X",
        "a b",
    )


def test_ad_labels(spark):
    name = F.lit("RV_Watched_Daily_Spin_Wheel_2X")
    assert one(spark, ad_label(name), short_ad_label(name, F.lit(7))) == (
        "Daily Spin Wheel 2X",
        "Daily_Spin_Whee: 7",
    )

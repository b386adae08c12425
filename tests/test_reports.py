"""Reports on hand-made events with answers worked out by hand."""

import datetime as dt

import pytest
from small import event, flat, rows, table

from playtrail.operators import (
    ads,
    boost,
    churn,
    cohort,
    economy,
    journey,
    levels,
    overview,
    retention,
    units,
)
from playtrail.operators.filters import Filters, last_week, level_choice, name_matches, row_limit
from playtrail.plans.dashboard import ad_impression_tables, dashboard, rewarded_ad_drilldown

DAY1, DAY5 = "2024-01-01", "2024-01-05"
WEEK = Filters(DAY1, DAY5)


def opened(user, at, **kw):
    return event(user, "first_open", at, **kw)


def played(user, level, result="complete", at=1, **kw):
    return event(user, f"level_{result}", at, level=level, **kw)


# ---- arguments


def test_filter_arguments():
    assert not Filters(start=DAY1).has_cohort and not Filters(end=DAY1).has_cohort
    assert not Filters("", "").has_cohort and WEEK.has_cohort
    assert Filters(country="FI", version="1").without("country") == Filters(version="1")
    with pytest.raises(ValueError):
        Filters("2024-13-01", DAY5)
    with pytest.raises(ValueError):
        Filters(cohort_scope="some")
    week = last_week(dt.date(2024, 3, 8), platform="ios")
    assert (week.start, week.end) == (dt.date(2024, 3, 1), dt.date(2024, 3, 8))


def test_numbers_as_arguments():
    assert (row_limit(None, 50), row_limit("", 50), row_limit("0", 50)) == (50, 50, 0)
    assert row_limit("all", 50) is None
    assert (level_choice("all"), level_choice(" "), level_choice("7")) == (None, None, 7)
    for bad in ("x", -1):
        with pytest.raises(ValueError):
            row_limit(bad, 50)


def test_required_arguments(spark):
    events = flat(spark, [])
    with pytest.raises(ValueError):
        retention.rewarded_ads_cohort(events, "")
    with pytest.raises(ValueError):
        retention.ad_impressions_cohort(events, "")
    with pytest.raises(ValueError):
        overview.available_countries(events, mode="other")
    with pytest.raises(ValueError):
        journey.qualified_users(events, 1, "other")


def test_filters_on_events(spark):
    events = flat(
        spark,
        [
            event("a", "x", 1, platform="IOS", country="FI", version="1"),
            event("b", "x", 1, platform="ANDROID", country="fi", version="2"),
        ],
    )

    def left(**kw):
        return [u for u, in table(Filters(**kw).on_attributes(events), "user_pseudo_id")]

    assert left() == left(platform="all", country=" ", version="all") == ["a", "b"]
    assert left(platform="android") == ["b"]
    assert left(country="FI") == ["a"]
    assert left(version="2") == ["b"]
    assert left(platform=" ") == []
    assert left(country="FI' OR '1'='1") == []


def test_name_patterns(spark):
    names = ["RV_Watched_A", "RVxWatched_A", "RV_Watched", "level_start"]
    events = flat(spark, [event(n, n, 1) for n in names])

    def hit(pattern):
        return [n for n, in table(events.filter(name_matches(pattern)), "event_name")]

    assert hit("RV_Watched_%") == ["RV_Watched_A", "RVxWatched_A"]
    assert hit("RV_Watched_A") == ["RV_Watched_A"]
    assert hit("%start") == ["level_start"]


# ---- cohort


def test_cohort_edges(spark):
    events = flat(
        spark,
        [
            opened("before", "2023-12-31 23:59:59.999999"),
            opened("before", "2024-01-02"),
            opened("last moment", "2024-01-05 23:59:59.999999"),
            opened("after", "2024-01-06"),
            opened("moved", "2023-12-01", platform="ANDROID"),
            opened("moved", "2024-01-03"),
            event("never", "level_start", "2024-01-02"),
        ],
    )
    assert table(cohort.user_cohort(events, WEEK), "user_pseudo_id") == [("last moment",)]
    ios = Filters(DAY1, DAY5, platform="ios")
    assert {u for u, in table(cohort.user_cohort(events, ios), "user_pseudo_id")} == {
        "last moment",
        "moved",
    }
    anywhere = Filters(DAY1, DAY5, platform="ios", cohort_scope="global")
    assert table(cohort.user_cohort(events, anywhere), "user_pseudo_id") == [("last moment",)]
    assert cohort.user_cohort(events).count() == 4
    narrowed = cohort.narrow_to_cohort(events, ios)
    assert {u for u, in table(narrowed, "user_pseudo_id")} == {"last moment", "moved"}
    assert cohort.narrow_to_cohort(events, Filters()).count() == events.count()


# ---- ads


def test_ads(spark):
    events = flat(
        spark,
        [
            opened("a", DAY1),
            opened("b", DAY1),
            opened("c", DAY1),
            event("a", "RV_Watched_X", "2024-01-02"),
            event("a", "RV_Watched_X", "2024-01-09"),  # outside the range of days
            event("a", "RV_Watched_Y", "2024-01-02"),
            event("b", "RV_Watched_Y", "2024-01-02"),
            event("z", "RV_Watched_Y", "2024-01-02"),  # never installed
        ],
    )
    assert table(ads.rewarded_ads(events, WEEK), *ads.rewarded_ads(events).columns) == [
        ("RV_Watched_Y", 2, 2, 1.0, 3, 0.67),
        ("RV_Watched_X", 1, 1, 1.0, 3, 0.33),
    ]
    everyone = ads.rewarded_ads(events)
    assert table(everyone, "event_name", "total_count", "unique_users", "total_users") == [
        ("RV_Watched_Y", 3, 3, 4),
        ("RV_Watched_X", 2, 1, 4),
    ]
    # One user with two ads counts twice.
    assert rows(ads.rewarded_ads_totals(everyone)) == [
        {
            "event_name": "TOTAL",
            "total_count": 5,
            "unique_users": 4,
            "avg_per_user": 1.25,
            "total_users": 4,
            "avg_per_all_users": 1.25,
        }
    ]
    assert table(ads.rewarded_ads_by_install(events, WEEK), "event_name", "total_count") == [
        ("RV_Watched_X", 2),
        ("RV_Watched_Y", 2),
    ]
    assert table(ads.top_ads(everyone, 1), "event_name") == [("RV_Watched_Y",)]


# ---- levels


def test_level_analysis(spark):
    events = flat(
        spark,
        [
            played("a", 1, "fail", duration_seconds=10.0),
            played("a", 1, "fail", duration_seconds=20),
            played("a", 1, duration_seconds=30.0),
            played("a", 1),  # replay without a duration
            played("b", 1, "fail"),
            played("b", 2),
            event("b", "level_complete", 1),  # no level
        ],
    )
    got = table(levels.level_analysis(events), *levels.level_analysis(events).columns)
    assert got == [
        (1, 2, 3, 5, 2, 40.0, 30.0, 15.0, 4.0),
        (2, 1, 0, 1, 1, 100.0, None, None, 1.0),
    ]
    assert levels.level_analysis(events, level_count="1").count() == 1
    assert levels.level_analysis(events, level_count="0").count() == 0
    assert table(levels.average_completion_rate(levels.level_analysis(events)), "*") == [(70.0,)]
    assert sorted(table(levels.user_attempts(events), "user_pseudo_id", "level", "attempts", "completed")) == [
        ("a", 1, 4, 1),
        ("b", 1, 1, 0),
        ("b", 2, 1, 1),
    ]


# ---- boost


def test_boost_times_and_levels(spark):
    ad = "RV_Watched_Silver_Coin_In_Game"
    events = flat(
        spark,
        [
            event("a", ad, 100, level=1),
            event("a", ad, 300, level=1),
            played("a", 1, at=99),  # before: without
            played("a", 1, at=100),  # at the same moment: with
            played("a", 1, at=900),  # the same case again
            played("a", 1, "fail", at=50),  # without
            played("b", 1, at=500),  # someone else's ad
            played("a", 2, at=500),  # another level
            event("c", ad, 1, level=3),  # an ad without an outcome
        ],
    )
    assert {
        (r["level"], r["user_pseudo_id"], r["event_name"], r["had_silver_boost"])
        for r in rows(boost.level_with_boost(events))
    } == {
        (1, "a", "level_complete", 0),
        (1, "a", "level_complete", 1),
        (1, "a", "level_fail", 0),
        (1, "b", "level_complete", 0),
        (2, "a", "level_complete", 0),
    }
    report = boost.silver_boost(events)
    assert table(report, *report.columns) == [
        (1, 4, 1, 1, 2, 25.0, 100.0, 66.67),
        (2, 1, 0, 0, 1, 0.0, None, 100.0),
    ]
    assert table(boost.boost_impact(report), "level", "impact") == [(1, 33.33), (2, -100.0)]


# ---- units


def test_loadout_text(spark):
    texts = ["1 - A, 2 - B,", "1 - A, 2 - B,", "2 - B,1 - A", "1 - A,\t1 - A", " "]
    events = flat(
        spark,
        [event(str(i), "battle_start_loadout", 1, unit_names=t, level=i) for i, t in enumerate(texts)]
        + [event("n", "battle_start_loadout", 1, level=1)],
    )
    assert table(units.unit_frequency(events), "name", "usage_count", "unique_loadouts") == [
        ("1 - A", 5, 3),
        ("2 - B", 3, 2),
    ]
    assert table(units.top_loadouts(events, k=2), "loadout", "usage_count") == [
        ("1 - A, 2 - B,", 2),
        (" ", 1),
    ]
    assert table(units.unit_frequency(events, level="2"), "name", "usage_count") == [
        ("1 - A", 1),
        ("2 - B", 1),
    ]
    both = units.unit_loadout(events)
    frequency, tops = units.split_unit_loadout(both)
    assert (frequency.count(), tops.count()) == (2, 4)
    assert {r["additional_info"] for r in rows(tops)} == {None}
    ranked = units.ranked_loadouts(units.top_loadouts(events))
    assert table(ranked, "rank", "units")[0] == ("#1", "A, B, ")


def test_tied_loadouts_keep_name_order(spark):
    texts = [f"{i:02d}" for i in range(21)]
    events = flat(spark, [event("u", "battle_start_loadout", 1, unit_names=t) for t in texts])
    assert [t for t, in table(units.top_loadouts(events), "loadout")] == texts[:20]


def test_unit_upgrades(spark):
    events = flat(
        spark,
        [
            event("a", "unit_upgrade", 1, unit_name="X", level=1),
            event("a", "unit_upgrade", 1, unit_name="X", level=4),
            event("b", "unit_upgrade", 1, unit_name="X", level=5),
            event("b", "unit_upgrade", 1, unit_name="", level=5),
            event("b", "unit_upgrade", 1, unit_name="Y"),
        ],
    )
    got = units.unit_upgrades(events)
    assert table(got, *got.columns) == [("X", 3, 3.33, 1, 5)]


# ---- churn


def test_reach_over_gaps(spark):
    events = flat(
        spark,
        [
            played("a", 1, "fail"),
            played("b", 1),
            played("b", 2),
            played("c", 5, "fail"),  # counts as having reached 1 and 2
            played("c", 5),
            played("c", 5),
        ],
    )
    report = churn.churn(events)
    assert table(report, *report.columns) == [
        (1, 3, 1, 33.33, 50.0, 2.0),
        (2, 2, 1, 50.0, 0.0, 1.0),
        (5, 1, 0, 0.0, 33.33, 1.5),
    ]
    # The last level shown still has its churn.
    assert table(churn.churn(events, level_count=2), "level", "churn_rate")[1] == (2, 50.0)
    assert table(churn.hardest_level(report), "*") == [(1, 2.0)]
    assert table(churn.max_churn_level(report), "*") == [(2, 50.0)]
    assert table(churn.max_churn_level(churn.churn(flat(spark, []))), "*") == [(None, 0.0)]


# ---- economy


def test_boxes_and_base_station(spark):
    events = flat(
        spark,
        [
            event("a", "booster_box_opened", 1, booster_box_ID="gold"),
            event("a", "booster_box_opened", 1, booster_box_ID="gold"),
            event("b", "booster_box_opened", 1, booster_box_ID="gold"),
            event("b", "booster_box_opened", 1),
            event("a", "base_station_upgrade", 1, Skill="Attack", level=1),
            event("a", "base_station_upgrade", 1, Skill="Attack"),
            event("b", "base_station_upgrade", 1, Skill="Health", level=1),
        ],
    )
    boxes = economy.booster_boxes(events)
    assert table(boxes, *boxes.columns) == [("gold", 3, 2, 1.5)]
    stations = economy.base_station(events)
    assert table(stations, *stations.columns) == [
        ("Attack", None, 1, 1),
        ("Attack", 1, 1, 1),
        ("Health", 1, 1, 1),
    ]
    pivot = economy.base_station_pivot(stations)
    assert table(pivot, "upgrade_level", "Attack", "Health") == [(None, 1, None), (1, 1, 1)]
    assert {s for s, in table(economy.base_station_skills(stations), "skill")} == {
        "Attack",
        "Health",
    }


# ---- overview


def test_options(spark):
    events = flat(
        spark,
        [
            opened("a", DAY1, country="FI", version="1.9"),
            event("a", "x", DAY1, country="SE", version="1.10"),
            opened("b", "2024-01-09", country="FI", version="1.9"),
        ],
    )
    assert table(overview.available_countries(events), "*") == [("FI", 2), ("SE", 1)]
    assert table(overview.available_versions(events), "*") == [("1.9", 2), ("1.10", 1)]
    assert table(overview.available_countries(events, WEEK), "*") == [("FI", 1), ("SE", 1)]
    # The list of countries leaves the chosen country out.
    one = Filters(DAY1, DAY5, country="SE")
    assert table(overview.available_countries(events, one), "*") == [("FI", 1), ("SE", 1)]
    late = Filters("2024-01-08", "2024-01-10")
    assert table(overview.available_countries(events, late, mode="event_date"), "*") == [("FI", 1)]


def test_empty_log(spark):
    events = flat(spark, [])
    assert table(overview.overall_stats(events), "*") == [(0,) * 7]
    assert ads.rewarded_ads_totals(ads.rewarded_ads(events)).count() == 0
    assert table(overview.overview(events), "*") == [(0, 0, 0.0, 0)]
    for report in dashboard(events, WEEK).values():
        assert report.count() in (0, 1)
    assert retention.rewarded_ads_cohort(events, "RV_Watched_%").count() == 0
    assert journey.time_to_n_levels(events).count() == 0


def test_dashboard_is_the_same_when_narrowed(spark):
    events = flat(
        spark,
        [
            opened("a", DAY1),
            opened("b", "2024-02-01"),
            event("a", "RV_Watched_X", "2024-01-02"),
            event("b", "RV_Watched_X", "2024-01-02"),
            played("a", 1, at="2024-01-02"),
            played("b", 1, "fail", at="2024-01-02"),
            event("a", "booster_box_opened", "2024-01-03", booster_box_ID="gold"),
        ],
    )
    wide, narrow = dashboard(events, WEEK), dashboard(events, WEEK, narrow=True)
    assert len(wide) == 12
    for name, report in wide.items():
        assert rows(report) == rows(narrow[name]), name
    assert table(wide["level_analysis"], "level", "completions", "failures") == [(1, 1, 0)]


# ---- cohort matrices


def test_matrix_offsets(spark):
    watched = "RV_Watched_X"
    events = flat(
        spark,
        [
            event("a", watched, "2023-12-31"),  # before the install
            opened("a", DAY1, platform="IOS"),
            event("a", watched, "2024-01-01 23:59:59.999999"),
            event("a", watched, "2024-01-08", platform="ANDROID"),  # offset 7, other platform
            event("a", watched, "2024-01-08"),
            event("a", "other", "2024-01-09"),  # offset 8 has no column
            event("a", "other", "2024-01-15"),  # active, no ad
            event("a", watched, "2024-03-31"),  # offset 90
            opened("b", DAY1),
            opened("c", DAY1, platform="ANDROID"),
        ],
    )
    ios = Filters(platform="ios")
    for filters in (ios, Filters(DAY1, DAY5, platform="ios")):
        [row] = rows(retention.rewarded_ads_cohort(events, watched, filters))
        assert row.pop("install_date") == dt.date(2024, 1, 1)
        assert {k: v for k, v in row.items() if v} == {
            "cohort_size": 2,
            "day_0_events": 1,
            "day_0_users": 2,
            "day_7_events": 2,
            "day_7_users": 1,
            "day_14_users": 1,
            "day_90_events": 1,
            "day_90_users": 1,
        }
        assert len(row) == 29
    cells = retention.cohort_cells(retention.rewarded_ads_cohort(events, watched, ios))
    found = {(d, e, m, h) for d, e, m, h in table(cells, "day", "events", "avg_events", "heat")}
    assert {c for c in found if c[3]} == {(0, 1, 0.5, 2), (7, 2, 2.0, 5), (90, 1, 1.0, 3)}
    assert rows(rewarded_ad_drilldown(events)) == rows(
        retention.rewarded_ads_cohort(events, "RV_Watched_%")
    )


def test_impressions_by_format(spark):
    events = flat(
        spark,
        [
            opened("a", DAY1),
            event("a", "ad_impression", DAY1, ad_format="INTER"),
            event("a", "ad_impression", "2024-01-02", ad_format="REWARDED"),
            event("a", "other", "2024-01-02", ad_format="INTER"),
        ],
    )
    tables = ad_impression_tables(events)
    for fmt in ("INTER", "REWARDED"):
        assert rows(tables[fmt]) == rows(retention.ad_impressions_cohort(events, fmt))
    assert table(tables["INTER"], "day_0_events", "day_1_events") == [(1, 0)]
    assert table(tables["REWARDED"], "day_0_events", "day_1_events") == [(0, 1)]


def test_all_rows_on_request(spark):
    events = flat(
        spark,
        [event(f"u{k}", "level_complete", DAY1, level=k) for k in range(1, 60)]
        + [opened(f"u{k}", f"2023-{1 + k // 28:02}-{1 + k % 28:02}") for k in range(120)],
    )
    assert levels.level_analysis(events).count() == 50
    assert levels.level_analysis(events, level_count="all").count() == 59
    assert churn.churn(events, level_count="all").count() == 59
    assert retention.rewarded_ads_cohort(events, "RV_Watched_%").count() == 100
    assert retention.rewarded_ads_cohort(events, "RV_Watched_%", limit="all").count() == 120


def test_pivot_holds_every_skill(spark):
    events = flat(
        spark,
        [
            event("a", "base_station_upgrade", DAY1, Skill=skill, level=1)
            for skill in ("Attack", "Shield", "Shield")
        ],
    )
    pivot = economy.base_station_pivot(economy.base_station(events))
    assert rows(pivot) == [{"upgrade_level": 1, "Attack": 1, "Shield": 2}]


def test_matrix_days_of_the_first_install_days(spark):
    """The cut at the last install day shown loses none of its events."""
    events = flat(
        spark,
        [
            opened("early", "2024-01-01"),
            opened("late", "2024-01-02"),
            event("early", "RV_Watched_X", "2024-03-31"),
            event("late", "RV_Watched_X", "2024-04-01"),
            event("late", "RV_Watched_X", "2024-04-02"),
        ],
    )
    first = retention.rewarded_ads_cohort(events, "RV_Watched_X", limit=1)
    assert table(first, "cohort_size", "day_90_events") == [(1, 1)]
    both = retention.rewarded_ads_cohort(events, "RV_Watched_X", limit=2)
    assert table(both, "cohort_size", "day_90_events") == [(1, 1), (1, 1)]


def test_named_and_drawn_journeys_come_in_order(spark):
    events = flat(
        spark,
        [
            event(f"u{k % 3}", "level_complete", f"2024-01-0{1 + k % 7} 0{k % 9}:00:00", level=k)
            for k in range(1, 40)
        ],
    )
    for report in (journey.user_level_progression, journey.time_to_n_levels):
        for how in ({"users": ["u2", "u0"]}, {"sample": 2, "seed": "1"}):
            found = report(events, 5, **how)
            number = [c for c in found.columns if c.endswith("completion_number")][0]
            got = table(found, "user_pseudo_id", number)
            assert got == sorted(got) and len({user for user, _ in got}) == 2

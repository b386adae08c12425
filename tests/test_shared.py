"""Reports from a common pass: the page load, rows with their totals, top loadouts by hash."""

import random

import pytest
from pyspark.sql import functions as F
from small import event, flat, rows

from playtrail.operators import ads, units
from playtrail.operators.filters import ALL, Filters
from playtrail.plans.dashboard import dashboard
from playtrail.plans.shared import page_sums, shared_dashboard
from playtrail.sources.sample_tables import sample_events

SF = "/root/testdata/sf0.001"
FILTERS = (
    Filters(),
    Filters("2024-01-01", "2024-01-09"),
    Filters("2024-01-01", "2024-01-30", platform="ios", country="NATION_8"),
    Filters("2024-01-01", "2024-01-09", platform="ios", cohort_scope="global"),
    Filters(version="1.5.0"),
)
ODD = [
    event(None, "RV_Watched_X", "2024-01-01"),
    event("u", "RV_Watched_X", "2024-01-01"),
    event("u", "RV_Watched_X", "2024-03-01"),
    event("u", "first_open", "2024-01-02", country=None),
    event("u", None, "2024-01-03"),
    event("v", "level_complete", "2024-01-03", level=1, duration_seconds=5),
    event("v", "level_complete", "2024-01-04", level=1),
    event("v", "level_fail", "2024-01-04", level=1, platform="ANDROID"),
    event("v", "RV_Watched_Silver_Coin_In_Game", "2024-01-03 12:00:00", level=1),
    event("v", "unit_upgrade", "2024-01-04", level=7, unit_name="A"),
    event("v", "unit_upgrade", "2024-01-04", unit_name="A"),
    event("v", "battle_start_loadout", "2024-01-05", level=2, unit_names="A, B,,A"),
    event("w", "first_open", None),
    event("w", "base_station_upgrade", "2024-01-05", Skill="Attack"),
    event("w", "booster_box_opened", "2024-01-05", booster_box_ID="b"),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark):
    return sample_events(spark, SF).unionByName(flat(spark, ODD * 2)).cache()


@pytest.mark.parametrize("filters, level", [(FILTERS[0], "10"), (FILTERS[1], None), (FILTERS[2], None), (FILTERS[3], "10")])
def test_page_from_one_pass_equals_the_single_reports(log, tmp_path, filters, level):
    shared = shared_dashboard(log, filters, 8, level, path=str(tmp_path / "page"))
    single = dashboard(log, filters, 8, level)
    assert list(shared) == list(single)
    for name, report in single.items():
        assert shared[name].dtypes == report.dtypes, name
        assert rows(shared[name]) == rows(report), name


def test_the_page_reads_its_sums_only(spark, tmp_path):
    events = sample_events(spark, SF)
    path = str(tmp_path / "page")
    page = shared_dashboard(events, FILTERS[1], path=path)
    assert plan_of(page_sums(events)).count("events.parquet") == 1
    for report in page.values():
        plan = plan_of(report)
        assert "events.parquet" not in plan and "/page]" in plan
    # The sums serve other filters as well.
    other = dashboard(spark.read.parquet(path), FILTERS[2])
    for name, report in dashboard(events, FILTERS[2]).items():
        assert rows(other[name]) == rows(report)


def test_sums_keep_a_hot_user_small(spark, log):
    hot = log.withColumn("user_pseudo_id", F.lit("hot"))
    sums = page_sums(hot)
    assert sums.agg(F.sum("events")).first()[0] == log.count()
    assert sums.count() < log.count()


# ---- totals


@pytest.mark.parametrize("filters", FILTERS)
def test_rows_and_totals_in_one_pass(log, filters):
    separate = ads.rewarded_ads(log, filters)
    wanted = separate.unionByName(ads.rewarded_ads_totals(separate))
    got = ads.rewarded_ads_with_totals(log, filters)
    assert got.dtypes == separate.dtypes
    assert rows(got) == rows(wanted)
    in_order = [r.event_name for r in got.collect()]
    assert in_order == [r.event_name for r in separate.collect()] + ["TOTAL"] * bool(in_order)


def test_totals_without_any_ad(log):
    none = log.filter("event_name = 'level_start'")
    assert ads.rewarded_ads_with_totals(none).collect() == []
    assert ads.rewarded_ads_with_totals(log.limit(0)).collect() == []


def test_totals_take_one_scan(spark):
    events = sample_events(spark, SF)
    assert plan_of(ads.rewarded_ads_with_totals(events)).count("events.parquet") == 1
    assert plan_of(ads.rewarded_ads(events)).count("events.parquet") == 2
    assert "Expand" not in plan_of(ads.rewarded_ads_with_totals(events))


# ---- top loadouts


def uses(spark, counted):
    data = [event("u", "battle_start_loadout", "2024-01-01", unit_names=t) for t, n in counted for _ in range(n)]
    return flat(spark, data)


def shapes():
    draw = random.Random(3)
    flat_counts = [(f"L{i:03d}", 2) for i in range(60)]
    skewed = [("hot", 400)] + [(f"L{i:03d}", 1 + i % 9) for i in range(80)]
    spread = [(f"L{draw.randrange(10**6)}", draw.randrange(1, 30)) for _ in range(70)]
    return {"flat": flat_counts, "skewed": skewed, "spread": spread, "few": [("a", 1), ("b", 2)], "none": []}


@pytest.mark.parametrize("shape", sorted(shapes()))
@pytest.mark.parametrize("k", [0, 1, 5, 20, ALL])
def test_top_loadouts_by_hash(spark, shape, k):
    events = uses(spark, shapes()[shape])
    assert rows(units.top_loadouts_by_hash(events, k=k)) == rows(units.top_loadouts(events, k=k))


@pytest.mark.parametrize("filters", FILTERS)
def test_top_loadouts_by_hash_with_filters(log, filters):
    for level in (None, 10):
        got = units.top_loadouts_by_hash(log, filters, level, 7)
        assert rows(got) == rows(units.top_loadouts(log, filters, level, 7))


def test_equal_hashes_lose_no_loadout(spark, monkeypatch):
    """Four hash values for sixty texts."""
    real = F.xxhash64
    monkeypatch.setattr(units.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(4)))
    for shape, counted in shapes().items():
        events = uses(spark, counted)
        assert rows(units.top_loadouts_by_hash(events, k=6)) == rows(units.top_loadouts(events, k=6)), shape


def shuffled(df):
    """Bytes of all exchanges of a plan that has run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        for i in range(node.subqueries().size()):
            todo.append(node.subqueries().apply(i).child())
    return total


def test_long_texts_are_not_shuffled(spark):
    """Two thousand different loadouts of 2 KB, two of which are used often."""
    base = spark.range(0, 4000, 1, 4)
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("hot"), F.col("id") % 8)).otherwise(F.col("id").cast("string"))
    events = base.select(
        F.lit("battle_start_loadout").alias("event_name"),
        F.concat(text, F.repeat(F.lit("x"), 2000)).alias("unit_names"),
        F.lit("u").alias("user_pseudo_id"),
    )
    plain, lean = units.top_loadouts(events, k=2), units.top_loadouts_by_hash(events, k=2)
    assert rows(plain) == rows(lean)
    assert shuffled(lean) < shuffled(plain) / 10

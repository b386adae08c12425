"""Tables kept load by load beside the log: installs, sketches of users, activity in buckets."""

import random

import pytest
from pyspark.sql import functions as F
from small import event, flat, rows

from playtrail.operators import overview, retention
from playtrail.operators.cohort import user_cohort
from playtrail.operators.filters import ALL, Filters
from playtrail.sources import activity, installs, loads, sketches
from playtrail.sources.sample_tables import sample_events

SF = "/root/testdata/sf0.001"
FILTERS = (
    Filters(),
    Filters("2024-01-02", "2024-01-09"),
    Filters("2024-01-02", "2024-01-20", platform="ios", country="NATION_8"),
    Filters("2024-01-02", "2024-01-20", platform="ios", cohort_scope="global"),
)


@pytest.fixture(scope="module")
def log(spark):
    return sample_events(spark, SF).cache()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- installs


@pytest.mark.parametrize("seed", [1, 2])
def test_cohorts_equal_those_of_the_log_after_every_load(spark, log, tmp_path, seed):
    """Loads in any order, so an install may come before or after later ones; one load is repeated,
    one corrected, and folders are merged in between."""
    path, draw = str(tmp_path / "installs"), random.Random(seed)
    parts = {f"load-{k}": log.filter(F.abs(F.hash("event_id")) % 5 == k) for k in range(5)}
    order = list(parts)
    draw.shuffle(order)
    state = {}
    steps = [(name, parts[name]) for name in order]
    steps += [(order[0], parts[order[0]]), (order[1], parts[order[1]].filter("event_date > '2024-01-10'"))]
    for n, (name, part) in enumerate(steps):
        installs.update_installs(part, path, name)
        state[name] = part
        if n in (2, 5):
            installs.merge_installs(spark, path)
        if n in (0, 4, 6):
            whole = None
            for p in state.values():
                whole = p if whole is None else whole.unionByName(p)
            for filters in FILTERS:
                got = user_cohort(installs.read_installs(spark, path), filters)
                assert rows(got) == rows(user_cohort(whole, filters))


def test_installs_of_a_load_are_read_from_the_installs_only(spark, log, tmp_path):
    path = str(tmp_path / "installs")
    installs.update_installs(log, path, "a")
    kept = installs.read_installs(spark, path)
    assert kept.count() == log.filter("event_name = 'first_open'").select(*installs.COLUMNS).distinct().count()
    assert installs.COLUMNS[-1] == "event_date"


def test_users_without_id_and_empty_loads(spark, tmp_path):
    path = str(tmp_path / "installs")
    events = flat(
        spark,
        [
            event(None, "first_open", "2024-01-01"),
            event("u", "first_open", "2024-01-03"),
            event("u", "first_open", "2024-01-03"),
            event("u", "first_open", "2024-01-02", country=None),
            event("v", "level_start", "2024-01-01"),
            event("w", "first_open", None),
        ],
    )
    installs.update_installs(events, path, "a")
    installs.update_installs(events.limit(0), path, "b")
    assert rows(user_cohort(installs.read_installs(spark, path))) == rows(user_cohort(events))


# ---- sketches


def test_few_users_are_counted_exactly(spark, log, tmp_path):
    """Sketches count up to a few hundred users without error."""
    path = str(tmp_path / "sketches")
    for k in range(3):
        sketches.update_sketches(log.filter(F.col("event_id") % 3 == k), path, f"load-{k}")
    kept = sketches.read_sketches(spark, path)
    exact = overview.overall_stats(log).first().total_users
    assert sketches.approx_users(kept).first().approx_users == pytest.approx(exact, rel=0.01)
    for filters in (Filters("2024-01-03", "2024-01-05"), Filters(platform="ios", country="NATION_8")):
        seen = filters.on_event_date(filters.on_attributes(log))
        exact = seen.select("user_pseudo_id").distinct().count()
        assert sketches.approx_users(kept, filters).first().approx_users == pytest.approx(exact, abs=2)
    before = rows(sketches.approx_users(kept, by="country"))
    sketches.merge_sketches(spark, path)
    assert rows(sketches.approx_users(sketches.read_sketches(spark, path), by="country")) == before
    assert sketches.approx_users(kept.limit(0)).first().approx_users == 0


def test_error_of_many_users_is_within_three_deviations(spark, tmp_path):
    path = str(tmp_path / "sketches")
    n = 60_000
    many = spark.range(n * 3).select(
        (F.col("id") % n).cast("string").alias("user_pseudo_id"),
        F.lit("IOS").alias("platform"),
        F.concat(F.lit("c"), F.col("id") % 7).alias("country"),
        F.lit("1").alias("version"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("event_date"),
    )
    sketches.update_sketches(many, path, "a")
    kept = sketches.read_sketches(spark, path)
    bound = 3 * 0.83 / 2 ** (sketches.LOG_SIZE / 2)
    assert sketches.approx_users(kept).first().approx_users == pytest.approx(n, rel=bound)
    days = Filters("2024-01-02", "2024-01-04")
    exact = days.on_event_date(many).select("user_pseudo_id").distinct().count()
    assert sketches.approx_users(kept, days).first().approx_users == pytest.approx(exact, rel=bound)


# ---- activity


MATRICES = {
    "ads": lambda ev, f, limit: retention.rewarded_ads_cohort(ev, "RV_Watched_%", f, limit),
    "formats": lambda ev, f, limit: retention.ad_impressions_by_format(ev, filters=f, limit=limit),
}


@pytest.fixture(scope="module")
def stored(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("activity") / "t")
    yield activity.write_activity(log, "activity_of_tests", path, 8)
    spark.sql("DROP TABLE activity_of_tests")


@pytest.mark.parametrize("name", sorted(MATRICES))
@pytest.mark.parametrize("filters, limit", [(FILTERS[0], 5), *((f, ALL) for f in FILTERS)])
def test_matrix_over_activity_equals_that_over_the_log(log, stored, name, filters, limit):
    matrix = MATRICES[name]
    assert rows(matrix(stored, filters, limit)) == rows(matrix(log, filters, limit))


def test_only_sums_per_install_day_are_exchanged(stored, setting):
    """No row of a user moves: the exchanges are by install day and for its order."""
    setting(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    for matrix in MATRICES.values():
        for filters in FILTERS:
            plan = plan_of(matrix(stored, filters, ALL))
            for line in plan.split("\n"):
                if "Exchange hashpartitioning" in line:
                    assert "hashpartitioning(install_date" in line
            assert "Bucketed: true" in plan


def test_a_hot_user_is_few_rows(spark, log, tmp_path):
    hot = log.withColumn("user_pseudo_id", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("user_pseudo_id")))
    daily = activity.daily_activity(hot)
    per_user = daily.filter("user_pseudo_id = 'hot'").agg(F.sum("events"), F.count("*")).first()
    assert per_user[0] == hot.filter("user_pseudo_id = 'hot' and event_name is not null").count()
    assert daily.agg(F.sum("events")).first()[0] == hot.filter("event_name is not null").count()


def test_tables_are_of_the_loads_layout(spark, log, tmp_path):
    path = str(tmp_path / "sketches")
    sketches.update_sketches(log, path, "a")
    assert {r.load_id for r in loads.loads(spark, path).collect()} == {"a"}

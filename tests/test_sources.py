"""Parameter bag, readers and writers."""

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from small import event, flat, raw, rows, table, value

from playtrail.sources import events as E
from playtrail.sources.sample_tables import raw_sample_events, sample_events
from playtrail.sources.schema import FLAT_EVENT, OLD_BOX_KEY

SF = "/root/testdata/sf0.001"


def test_params_edge(spark):
    events = flat(
        spark,
        [
            event("int", "x", 1, level=3, duration_seconds=5),
            event("double", "x", 1, duration_seconds=2.5),
            event("wrong", "x", 1, level="3", duration_seconds="2.5"),
            event("real level", "x", 1, level=3.0),
            event("twice", "x", 1, params=[("level", 1), ("level", 2)]),
            event("both", "x", 1, params=[("duration_seconds", value(int_value=1, double_value=9.0))]),
            event("empty", "x", 1),
            event("none", "x", 1, params=None),
        ],
    )
    got = {
        r[0]: r[1:]
        for r in table(
            events, "user_pseudo_id", "level", "duration_seconds", "duration_seconds_dbl"
        )
    }
    assert got == {
        "int": (3, 5.0, None),
        "double": (None, 2.5, 2.5),
        "wrong": (None, None, None),
        "real level": (None, None, None),
        "twice": (1, None, None),
        "both": (None, 9.0, 9.0),
        "empty": (None, None, None),
        "none": (None, None, None),
    }


def test_flat_columns(spark):
    events = flat(spark, [event("a", "x", "2024-01-01 23:59:59.999999", unit_names="A,B")])
    assert [(f.name, f.dataType) for f in events.schema] == [
        (f.name, f.dataType) for f in FLAT_EVENT
    ]
    assert table(events, "event_date", "country", "version", "unit_names") == [
        (dt.date(2024, 1, 1), "FI", "1.0", "A,B")
    ]


def test_box_key_is_an_argument(spark):
    events = raw(spark, [event("a", "booster_box_opened", 1, params=[("id", "old")])])
    assert table(E.flatten_events(events, OLD_BOX_KEY), "box_id") == [("old",)]
    assert table(E.flatten_events(events), "box_id") == [(None,)]


def test_nested_and_flat_sample_agree(spark):
    nested = E.flatten_events(raw_sample_events(spark, SF))
    assert rows(nested) == rows(sample_events(spark, SF))


def test_read_by_day_prunes_days_and_leaves(spark, setting, tmp_path):
    setting(maxMetadataStringLength="1000")
    root = str(tmp_path / "raw")
    raw_sample_events(spark, SF).drop("event_id").write.partitionBy("event_date").parquet(root)
    events = E.flatten_events(E.read_events(spark, root))
    assert rows(events.drop("event_id")) == rows(sample_events(spark, SF).drop("event_id"))
    early = E.flatten_events(E.read_events(spark, root, end=dt.date(2024, 1, 3)))
    assert rows(early) == rows(events.filter("event_date <= '2024-01-03'"))
    some = early.filter(F.col("event_name") == "level_complete").select("user_pseudo_id", "level")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "(event_date#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "<= 2024-01-05" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "EqualTo(event_name,level_complete)" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert read == (
        "struct<user_pseudo_id:string,event_timestamp:bigint,event_name:string,"
        "event_params:array<struct<key:string,value:struct<int_value:bigint>>>>"
    )


def test_shards(spark, tmp_path):
    for day in ("20240101", "20240102", "20240201"):
        at = f"{day[:4]}-{day[4:6]}-{day[6:]}"
        raw(spark, [event("u", "x", at)]).write.parquet(str(tmp_path / f"events_{day}"))
    every = E.flatten_events(E.read_event_shards(spark, str(tmp_path)))
    january = E.read_event_shards(spark, str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert (every.count(), january.count()) == (3, 2)
    assert every.agg(F.max("event_date")).first()[0] == dt.date(2024, 2, 1)


def test_any_bound_and_intraday_shards(spark, tmp_path):
    for shard, at in (
        ("events_20240102", "2024-01-02"),
        ("events_20240103", "2024-01-02 23:00:00"),  # late, or of an earlier zone
        ("events_intraday_20240104", "2024-01-04"),
        ("events_20240104", "2024-01-05 01:00:00"),
        ("events_old_20240103", "2024-01-03"),
    ):
        raw(spark, [event("u", "x", at)]).write.parquet(str(tmp_path / shard))

    def days(start=None, end=None, **more):
        found = E.flatten_events(E.read_event_shards(spark, str(tmp_path), start, end, **more))
        return sorted(r[0].day for r in found.select("event_date").collect())

    assert days() == [2, 2, 4, 5]
    assert days(start=dt.date(2024, 1, 4)) == [4, 5]
    assert days(end=dt.date(2024, 1, 2)) == [2, 2]
    assert days(dt.date(2024, 1, 5), dt.date(2024, 1, 5)) == [5]
    assert days(dt.date(2024, 1, 5), dt.date(2024, 1, 5), margin_days=0) == []
    assert days(dt.date(2025, 1, 1)) == []


def test_event_day_is_the_utc_day_whatever_the_shard(spark, tmp_path):
    """Directories one day off, as in a log cut at another zone's midnight."""
    log = raw_sample_events(spark, SF)
    moved = log.withColumn("event_date", F.date_add("event_date", 1))
    moved.write.partitionBy("event_date").parquet(str(tmp_path / "raw"))
    stored = E.flatten_events(E.read_events(spark, str(tmp_path / "raw")))
    assert rows(stored) == rows(sample_events(spark, SF))
    some = E.read_events(spark, str(tmp_path / "raw"), dt.date(2024, 1, 3), dt.date(2024, 1, 4))
    wanted = sample_events(spark, SF).filter("event_date between '2024-01-03' and '2024-01-04'")
    assert rows(E.flatten_events(some)) == rows(wanted)


def test_repeated_load_replaces_itself_and_no_other(spark, tmp_path):
    path = str(tmp_path / "flat")
    events = sample_events(spark, SF)
    odd, even = events.filter("event_id % 2 = 1"), events.filter("event_id % 2 = 0")
    for load, part in (("a", odd), ("b", even), ("a", odd), ("b", even)):
        E.write_flat_events(part, path, load)
    assert rows(E.read_flat_events(spark, path)) == rows(events)


def test_events_without_a_user_stay(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(3)
    nobody = events.withColumn("user_id", F.lit(None).cast("bigint"))
    nobody.write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    found = sample_events(spark, str(tmp_path)).select("user_pseudo_id", "country").collect()
    assert [tuple(r) for r in found] == [(None, None)] * 3


def test_flat_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "flat")
    events = sample_events(spark, SF)
    E.write_flat_events(events, path, "whole")
    stored = E.read_flat_events(spark, path)
    assert rows(stored) == rows(events)
    days = {d.name for d in (tmp_path / "flat").iterdir() if d.name.startswith("event_date=")}
    assert len(days) == events.select("event_date").distinct().count()


def test_hot_day_is_split(spark, setting, tmp_path):
    setting(adaptive__advisoryPartitionSizeInBytes="20000", shuffle__partitions="8")
    # A partition is split between the outputs of its map tasks: eight here.
    many = reduce(DataFrame.union, [sample_events(spark, SF)] * 8)
    hot = many.withColumn(
        "event_date",
        F.when(F.col("event_id") % 3 > 0, F.lit(dt.date(2024, 1, 1))).otherwise(F.col("event_date")),
    )
    path = tmp_path / "flat"
    E.write_flat_events(hot, str(path), "hot")
    files = {d.name: len(list(d.rglob("*.parquet"))) for d in path.iterdir() if d.is_dir()}
    assert files["event_date=2024-01-01"] > 2
    assert E.read_flat_events(spark, str(path)).count() == 8_000


def test_write_result(spark, tmp_path):
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        E.write_result(spark.range(3), path, fmt)
        assert spark.read.format(fmt).load(path).count() == 3

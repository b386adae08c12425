"""Incremental flattening."""

import pytest
from pyspark.sql import functions as F
from small import rows

from playtrail.operators.cohort import user_cohort
from playtrail.sources import installs, sketches
from playtrail.sources.events import flatten_events, read_flat_events, write_flat_events
from playtrail.sources.sample_tables import raw_sample_events, sample_events
from playtrail.streaming.ingest import ingest, stream_events

SF = "/root/testdata/sf0.001"


def test_arriving_days_are_appended_once(spark, tmp_path):
    raw, path, state = (str(tmp_path / d) for d in ("raw", "flat", "state"))
    log = raw_sample_events(spark, SF).drop("event_id")
    early = F.col("event_date") < "2024-01-15"

    def arrive(part):
        part.write.mode("append").partitionBy("event_date").parquet(raw)
        query = ingest(stream_events(spark, raw, 5), path, checkpoint=state)
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive

    arrive(log.filter(early))
    first = read_flat_events(spark, path).count()
    assert first == log.filter(early).count()
    arrive(log.filter(~early))
    stored = read_flat_events(spark, path).drop("event_id")
    assert rows(stored) == rows(sample_events(spark, SF).drop("event_id"))


def test_a_stream_keeps_other_tables_up_to_date(spark, tmp_path):
    """Installs and sketches of every micro-batch; what they give is that of the whole log."""
    raw, path, state, kept, users = (
        str(tmp_path / d) for d in ("raw", "flat", "state", "installs", "users")
    )
    log = raw_sample_events(spark, SF).drop("event_id").filter("event_date <= '2024-01-08'")
    also = [
        lambda flat, load: installs.update_installs(flat, kept, load),
        lambda flat, load: sketches.update_sketches(flat, users, load),
    ]
    for part in (F.col("event_date") < "2024-01-05", F.col("event_date") >= "2024-01-05"):
        log.filter(part).write.mode("append").partitionBy("event_date").parquet(raw)
        stream = stream_events(spark, raw)
        ingest(stream, path, checkpoint=state, also=also).awaitTermination(120)
    stored = read_flat_events(spark, path)
    assert rows(user_cohort(installs.read_installs(spark, kept))) == rows(user_cohort(stored))
    exact = stored.select("user_pseudo_id").distinct().count()
    found = sketches.approx_users(sketches.read_sketches(spark, users)).first()[0]
    assert found == pytest.approx(exact, abs=1)


def test_batch_and_stream_share_a_table(spark, tmp_path):
    """Either order keeps all rows, and streamed days have the layout of loaded ones."""
    log = raw_sample_events(spark, SF)
    first, second = log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1")
    for order in ("batch first", "stream first"):
        raw, path, state = (str(tmp_path / order / d) for d in ("raw", "flat", "state"))
        second.write.partitionBy("event_date").parquet(raw)

        def batch():
            write_flat_events(flatten_events(first), path, "backfill")

        if order == "batch first":
            batch()
        ingest(stream_events(spark, raw), path, checkpoint=state).awaitTermination(120)
        if order == "stream first":
            batch()
            batch()
        assert rows(read_flat_events(spark, path)) == rows(sample_events(spark, SF))
        for day in (tmp_path / order / "flat").glob("event_date=*"):
            loads = sorted(d.name.split("=")[1][:5] for d in day.iterdir())
            assert set(loads) <= {"backf", "flat_"}
            assert all(len(list(d.glob("*.parquet"))) == 1 for d in day.iterdir())


def test_progress_goes_to_the_clusters_folder(spark, tmp_path, monkeypatch):
    raw = str(tmp_path / "raw")
    raw_sample_events(spark, SF).drop("event_id").write.partitionBy("event_date").parquet(raw)
    monkeypatch.setattr("playtrail.streaming.ingest.checkpoint_root", lambda _: None)
    with pytest.raises(ValueError):
        ingest(stream_events(spark, raw), str(tmp_path / "flat"))
    monkeypatch.setattr("playtrail.streaming.ingest.checkpoint_root", lambda _: str(tmp_path))
    ingest(stream_events(spark, raw), str(tmp_path / "flat"), "daily").awaitTermination(120)
    assert (tmp_path / "daily" / "commits").is_dir()

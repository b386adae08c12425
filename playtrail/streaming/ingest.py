"""Keep the flat table up to date while day directories of raw events arrive."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from playtrail.session import checkpoint_root
from playtrail.sources.events import by_shard, flatten_events, write_flat_events
from playtrail.sources.schema import BOX_KEY, READ_EVENT_BY_DAY


def stream_events(
    spark: SparkSession, root: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Raw events of `root/event_date=YYYY-MM-DD/` as a stream of new files."""
    reader = spark.readStream.schema(READ_EVENT_BY_DAY)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return by_shard(reader.parquet(root))


def ingest(
    raw: DataFrame,
    path: str,
    name: str = "flat_events",
    checkpoint: str | None = None,
    box_key: str = BOX_KEY,
    also: Sequence[Callable[[DataFrame, str], None]] = (),
    **trigger,
) -> StreamingQuery:
    """Add flattened events to the table at `path`, each file once.

    Every micro-batch is a load of its own, written like a batch load and named after the query and
    its number: one that is repeated after a failure replaces itself, and batch loads to the same
    table stay. `also` names what else takes over each load, as functions of its flat events and its
    id: `lambda flat, load: update_installs(flat, installs, load)` keeps a cohort table up to date.
    They run after the flat table has the load and are repeated with it. Progress is kept under the cluster's checkpoint folder unless `checkpoint` names
    another. The default trigger takes what is there and stops; pass
    `processingTime='5 minutes'` to keep on.
    """
    if checkpoint is None:
        root = checkpoint_root(raw.sparkSession)
        if root is None:
            raise ValueError("no checkpoint folder: set spark.checkpoint.dir or pass one")
        checkpoint = f"{root.rstrip('/')}/{name}"
    started = threading.Event()
    query: list[StreamingQuery] = []

    def load(batch: DataFrame, number: int) -> None:
        # The query's id is kept with its progress, so it is the same after a restart.
        started.wait()
        load_id, flat = f"{name}-{query[0].id}-{number}", flatten_events(batch, box_key)
        write_flat_events(flat, path, load_id)
        for update in also:
            update(flat, load_id)

    stream = raw.writeStream.queryName(name).foreachBatch(load)
    stream = stream.option("checkpointLocation", checkpoint)
    query.append(stream.trigger(**(trigger or {"availableNow": True})).start())
    started.set()
    return query[0]

"""Player-event analytics on Spark DataFrames."""

from playtrail.operators.filters import Filters
from playtrail.sources.events import (
    flatten_events,
    read_event_shards,
    read_events,
    read_flat_events,
    write_flat_events,
)

__all__ = [
    "Filters",
    "flatten_events",
    "read_event_shards",
    "read_events",
    "read_flat_events",
    "write_flat_events",
]

"""Counting inside a task before anything is shuffled, in memory of bounded size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Iterable, Iterator

import pyarrow as pa

LIMIT = 400_000  # counters a task holds before it hands its sums on
ROWS = 20_000  # rows of one Arrow batch


def tallies(
    rows: Iterable[tuple[Hashable, Iterable]], limit: int = LIMIT
) -> Iterator[tuple[Hashable, Counter]]:
    """Partial sums of each group's items. A group comes out once for every time that the task has
    filled `limit` counters, and once at the end."""
    held: dict[Hashable, Counter] = {}
    entries = 0
    for group, items in rows:
        counter = held.get(group)
        if counter is None:
            counter = held[group] = Counter()
        before = len(counter)
        counter.update(items)
        entries += len(counter) - before
        if entries > limit:
            yield from held.items()
            held, entries = {}, 0
    yield from held.items()


def counted_batches(
    found: Iterable[tuple[Hashable, Counter]], group: str, item: str, item_type: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """Columns `group`, `item` and `n` of partial sums."""
    for key, counter in found:
        items, counts = list(counter), list(counter.values())
        for at in range(0, len(items), ROWS):
            some = items[at : at + ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * len(some), pa.string()),
                    pa.array(some, item_type),
                    pa.array(counts[at : at + ROWS], pa.int64()),
                ],
                names=[group, item, "n"],
            )


class Recent:
    """Results by key in two generations: when the newer one is full it becomes the older one, and
    what is asked for again moves up. Frequent keys stay, rare ones fall out, and no result depends
    on it. `make` gives the results of a list of new keys; none of them may be None."""

    def __init__(self, make, size: int):
        self.make, self.size = make, size
        self.newer: dict = {}
        self.older: dict = {}

    def resolve(self, keys: set) -> dict:
        """The result of every key."""
        newer, older = self.newer, self.older
        found, fresh = {}, []
        for key in keys:
            value = newer.get(key)
            if value is None:
                value = older.get(key)
                if value is None:
                    fresh.append(key)
                    continue
                newer[key] = value
            found[key] = value
        made = dict(zip(fresh, self.make(fresh)))
        found.update(made)
        newer.update(made)
        if len(newer) > self.size:
            self.newer, self.older = {}, newer
        return found

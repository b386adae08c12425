"""Minimal perfect hashes of byte strings, with the keys themselves stored for verification.

Keys are dealt to buckets; a bucket of several keys gets the first displacement that sends all of
them to free slots, a bucket of one takes a free slot outright. n keys fill the slots 0 to n - 1.
A look-up reads one displacement and compares the stored key, so strings that are no keys are told
from keys without error. Keys that share all 128 bits of their hash stand apart in a small table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash

from playtrail.llm.sampling import mixed

STEP = np.uint64(0x9E3779B97F4A7C15)
PER_BUCKET = 3
TRIALS = 256  # displacements tried at a time


def digests(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit numbers for each key."""
    joined = b"".join(map(xxhash.xxh3_128_digest, keys))
    return np.frombuffer(joined, dtype="<u8").reshape(-1, 2)


def _placed(hashes: np.ndarray, displacement, slots: int) -> np.ndarray:
    """Slot by hash and displacement: mixed anew for each, so no key runs through few slots only."""
    return (mixed(hashes[..., 1] + displacement * STEP) % np.uint64(slots)).astype(np.int64)


@dataclass
class PerfectHash:
    """`displaced` by bucket: 0 or more, or -1 - slot for a bucket of one key. `keys` holds all keys
    in order of their slots, `ends` where each of them ends."""

    displaced: np.ndarray
    keys: np.ndarray
    ends: np.ndarray
    apart: dict[bytes, int] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.ends)

    def terms(self) -> list[bytes]:
        whole, at = self.keys.tobytes(), [0, *self.ends.tolist()]
        return [whole[a:b] for a, b in zip(at, at[1:])]

    def slots(self, words: list[bytes], hashes: np.ndarray | None = None) -> np.ndarray:
        """Slot of each word, -1 for one that is no key."""
        found = np.full(len(words), -1, dtype=np.int64)
        main = self.size - len(self.apart)
        if len(words) and main:
            hashes = digests(words) if hashes is None else hashes
            d = self.displaced[(hashes[:, 0] % np.uint64(len(self.displaced))).astype(np.int64)]
            slot = np.where(d < 0, -1 - d, 0)
            many = d >= 0
            slot[many] = _placed(hashes[many], d[many].astype(np.uint64), main)
            found = np.where(self._same(words, slot), slot, -1)
        if self.apart:
            for i in np.flatnonzero(found < 0).tolist():
                found[i] = self.apart.get(words[i], -1)
        return found

    def _same(self, words: list[bytes], slot: np.ndarray) -> np.ndarray:
        """Whether the key stored at each slot is the word."""
        width = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.where(slot > 0, self.ends[slot - 1], 0)
        alike = self.ends[slot] - first == width
        at = np.flatnonzero(alike)
        wide = width[at]
        reach = np.cumsum(wide) - wide
        place = np.arange(int(wide.sum())) - np.repeat(reach, wide)
        stored = self.keys[np.repeat(first[at], wide) + place]
        given = np.frombuffer(b"".join(words[i] for i in at.tolist()), dtype=np.uint8)
        wrong = np.repeat(np.arange(len(at)), wide)[stored != given]
        alike[at[wrong]] = False
        return alike


def build(keys: list[bytes]) -> PerfectHash:
    """A hash of the distinct keys."""
    keys = sorted(set(keys))
    hashes = digests(keys)
    seen: set[tuple[int, int]] = set()
    twins = []
    for i, pair in enumerate(map(tuple, hashes.tolist())):
        if pair in seen:
            twins.append(i)
        seen.add(pair)
    if twins:
        main = sorted(set(range(len(keys))) - set(twins))
        extra = [keys[i] for i in twins]
        keys, hashes = [keys[i] for i in main], hashes[main]
    else:
        extra = []
    n = len(keys)
    n_buckets = max(1, -(-n // PER_BUCKET))
    bucket = (hashes[:, 0] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    heights = np.bincount(bucket, minlength=n_buckets)
    first = np.cumsum(heights) - heights
    displaced = np.zeros(n_buckets, dtype=np.int64)
    taken = np.zeros(max(n, 1), dtype=bool)
    slot_of = np.zeros(n, dtype=np.int64)
    tallest = np.argsort(-heights, kind="stable")
    for b in tallest[heights[tallest] > 1].tolist():
        own = order[first[b] : first[b] + heights[b]]
        displaced[b], slot_of[own] = _free(hashes[own], taken)
        taken[slot_of[own]] = True
    singles = np.flatnonzero(heights == 1)
    free = np.flatnonzero(~taken[:n])[: len(singles)]
    slot_of[order[first[singles]]] = free
    displaced[singles] = -1 - free
    by_slot = [keys[i] for i in np.argsort(slot_of, kind="stable").tolist()] + extra
    ends = np.cumsum(np.fromiter(map(len, by_slot), dtype=np.int64, count=len(by_slot)))
    apart = {key: n + i for i, key in enumerate(extra)}
    return PerfectHash(displaced, np.frombuffer(b"".join(by_slot), dtype=np.uint8), ends, apart)


def _free(hashes: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
    """First displacement that sends the keys of a bucket to free slots, and these slots."""
    start = 0
    while True:
        tried = np.arange(start, start + TRIALS, dtype=np.uint64)
        slots = _placed(hashes[None, :, :], tried[:, None], len(taken))
        ordered = np.sort(slots, axis=1)
        good = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
        if good.any():
            at = int(np.argmax(good))
            return start + at, slots[at]
        start += TRIALS

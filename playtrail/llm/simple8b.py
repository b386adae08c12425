"""Simple-8b: runs of ids packed into 64-bit words, in Numpy.

The upper four bits of a word select how many ids it holds and with how many bits each; the first id
stands in the lowest bits. An id too wide for any shared word escapes into a word of its own. Every
selector and position is found with whole-array operations; only the walk from word to word while
packing is a loop. Unpacking handles all words of one selector at a time.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the public format: bits of an id and ids of a word, for selectors 2 to 14.
# Selector 15 is the escape: one id of up to 60 bits. 0 and 1, runs of zeros, are not written.
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
FIRST_SELECTOR = 2
RUN = 16
ESCAPE, ESCAPE_BITS = 15, 60

_COUNT_OF = np.ones(16, dtype=np.int64)
_BITS_OF = np.full(16, ESCAPE_BITS, dtype=np.int64)
_COUNT_OF[FIRST_SELECTOR:ESCAPE], _BITS_OF[FIRST_SELECTOR:ESCAPE] = COUNTS, BITS
# First id that needs more bits than each selector has, and which selector small ids need.
_TABLED = 1 << 16
_LIMITS = np.uint64(1) << np.array(BITS, dtype=np.uint64)
_WIDTH_OF = np.searchsorted(_LIMITS, np.arange(_TABLED, dtype=np.uint64), side="right")
_WIDTH_OF = _WIDTH_OF.astype(np.int8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of a sequence of ids below 2**60."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    most = ids.max()
    if most >> np.uint64(ESCAPE_BITS):
        raise ValueError("ids must be below 2**60")
    # Zeros behind the end: they fit everywhere, so the last word may be filled up with them.
    padded = np.concatenate([ids, np.zeros(COUNTS[0], dtype=np.uint64)])
    # Per id its narrowest width by number, then the largest of 1, 2, 4, ... 32 ids from each place.
    if most < _TABLED:
        width = _WIDTH_OF[padded.view(np.int64)]
    else:
        width = np.searchsorted(_LIMITS, padded, side="right").astype(np.int8)
    largest, size = {1: width}, 1
    while size * 2 < COUNTS[0]:
        widths = largest[size]
        largest[2 * size] = np.maximum(widths[:-size], widths[size:])
        size *= 2
    selector = np.full(len(padded), ESCAPE, dtype=np.int8)
    # From the widest to the narrowest, so that the last that fits holds the most ids.
    for k in range(len(BITS) - 1, -1, -1):
        size = 1 << (COUNTS[k].bit_length() - 1)
        widths = largest[size]
        if COUNTS[k] > size:
            more = COUNTS[k] - size
            widths = np.maximum(widths[:-more], widths[more:])
        np.putmask(selector[: len(widths)], widths <= k, FIRST_SELECTOR + k)
    # The walk takes RUN words at a time; the words between follow from where a run of them begins.
    step = np.append(np.arange(n) + _COUNT_OF[selector[:n]], n)
    np.minimum(step, n, out=step)
    far, run = step, 1
    while run < RUN:
        far, run = far[far], 2 * run
    jumps, starts, at = memoryview(far), [], 0
    while at < n:
        starts.append(at)
        at = jumps[at]
    start = np.empty((len(starts), run), dtype=np.int64)
    start[:, 0] = starts
    for k in range(1, run):
        start[:, k] = step[start[:, k - 1]]
    start = start[start < n]
    chosen = selector[start].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.flatnonzero(np.bincount(chosen)):
        which = np.flatnonzero(chosen == s)
        at = start[which]
        word = padded[at]
        for j in range(1, _COUNT_OF[s]):
            word |= padded[at + j] << np.uint64(j * _BITS_OF[s])
        words[which] |= word
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The `n` ids of the words."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT_OF[selector]
    start = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        shifts = (np.arange(_COUNT_OF[s]) * _BITS_OF[s]).astype(np.uint64)
        mask = np.uint64((1 << int(_BITS_OF[s])) - 1)
        ids[start[which][:, None] + np.arange(_COUNT_OF[s])] = (
            words[which][:, None] >> shifts
        ) & mask
    return ids[:n]

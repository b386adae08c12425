"""Substring dedup: words covered by a window that stands anywhere else are removed.

Windows are judged in two passes, as most of them are unique and need not travel.

1. The texts are dealt to blocks by a hash. Every block sketches its windows: for each row of a
   count-min sketch, the cells they fall into, and which of them twice. The rows are cut into shards
   of a fixed number of cells; a shard adds up the pieces of all blocks and answers each with one
   bit per cell: is the estimate of two or more? An estimate is never below the true count, so no
   repeated window is lost, and the bits are all that comes back.
2. Only windows whose cells are all estimated repeated go on, as 128-bit fingerprints with the place
   of each in its block, and are grouped exactly. The answer is the places of those that are repeated,
   so the words to remove are known without looking at any window again. A block's places count the
   words of its texts in the order of the texts themselves, which no shuffle changes.

A piece holds a cell or fingerprint once per block, however often it stands there, so a passage
that a third of all texts share gives its shard one entry per block. Where a block itself holds a
window twice is sent by block, not by window. Words are cut and hashed as whole arrays. The number
of blocks and shards follows the amount of text; both stay of a fixed size. The texts are shuffled
once and that exchange serves all passes.

Defined results: a null or empty text has no words and stays as it is; texts shorter than a window
keep everything; repeated rows are documents of their own, so they remove each other's windows;
where nothing is removed a text keeps its white space, otherwise its remaining words are joined by
one space; an empty table gives no rows. Fingerprints of different windows could only be equal with
a chance of about the square of the number of windows over 2**128.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrail.llm.common import give_back, kept, own_columns, table
from playtrail.llm.sampling import mixed

WINDOW = 35
DEPTH = 2
CELL_BITS = 24
BLOCK_BYTES = 6_000_000  # of text in a block
SHARD_BYTES = 8_000_000  # of text whose windows share a shard
MAX_WORDS = 200_000
PORTION_BYTES = 1_000_000  # of text that is split into words at a time
BETWEEN = b"\xff"  # no UTF-8 text holds this byte

_ODD = np.uint64(0xD6E8FEB86659FD93)
_LANE = 0xA5A3564E27F8862D
_SEED = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1

CHUNK, LONG = 8, 64  # bytes of a word that are read at a time, and of one hashed by itself
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(CHUNK + 1)], dtype=np.uint64)


class WordPrints(dict):
    """Number of each word and, by that number, its 128-bit hash as two lanes; a word is hashed when
    it is first met. Word 0 stands between texts and equals no word."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.lanes = (array("Q"), array("Q"))
        self[BETWEEN]  # noqa: B018

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        both = xxhash.xxh3_128_intdigest(word)
        self.lanes[0].append(both >> 64)
        self.lanes[1].append(both & _ALL)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.reset()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def lane(self, numbers: np.ndarray, lane: int) -> np.ndarray:
        return np.frombuffer(self.lanes[lane], dtype="u8")[numbers]


def _joined(left: np.ndarray, right: np.ndarray, lane: int) -> np.ndarray:
    x = left * _ODD + right + np.uint64(_LANE * lane & _ALL)
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def window_prints(words: np.ndarray, width: int, lane: int) -> np.ndarray:
    """Hash of every window of `width` words, built from windows of powers of two."""
    total = len(words) - width + 1
    if total <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, size, done, result = words, 1, 0, None
    rest = width
    while rest:
        if rest & 1:
            piece = power[done : done + total]
            result = piece if result is None else _joined(result, piece, lane)
            done += size
        rest >>= 1
        if rest:
            power, size = _joined(power[:-size], power[size:], lane), size * 2
    return result


def _portions(texts: list[bytes | None]):
    """The texts in their order, PORTION_BYTES or one text at a time."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text or b"")
        if held >= PORTION_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def cut_words(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in a row, where their words begin and end there, and how many each text has."""
    data = b" " + b"".join((text or b"") + b" " for text in texts) + b" " * CHUNK
    white = _WHITE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    sizes = np.fromiter((len(text or b"") + 1 for text in texts), dtype=np.int64, count=len(texts))
    counts = np.diff(np.searchsorted(begins, np.cumsum(sizes)), prepend=0)
    return data, begins, ends, counts


def word_prints(data: bytes, begins: np.ndarray, ends: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Hashes of words, each lane with seeds of its own. Words are read eight bytes at a time; the
    few long ones are hashed by themselves."""
    chunks = np.ndarray(len(data) - CHUNK + 1, dtype="<u8", buffer=data, strides=(1,))
    sizes = ends - begins
    seeds = [np.uint64(_SEED * (lane + 1) & _ALL) for lane in range(lanes)]
    prints = [mixed(sizes.astype(np.uint64) + seed) for seed in seeds]
    which, at, left = slice(None), begins, sizes
    for _ in range(LONG // CHUNK):
        if not len(at):
            break
        chunk = chunks[at] & _FIRST_BYTES[np.minimum(left, CHUNK)]
        for lane, seed in enumerate(seeds):
            before = prints[lane][which]
            prints[lane][which] = mixed(before * _ODD + mixed(chunk ^ seed))
        rest = np.flatnonzero(left > CHUNK)
        which = rest if isinstance(which, slice) else which[rest]
        at, left = at[rest] + CHUNK, left[rest] - CHUNK
    for k in np.flatnonzero(sizes > LONG).tolist():
        both = xxhash.xxh3_128_intdigest(data[begins[k] : ends[k]])
        for lane in range(lanes):
            prints[lane][k] = both >> 64 * lane & _ALL
    return prints


def _covered(starts: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which of the words lie in windows that begin at these places, each given once."""
    marks = np.zeros(n_words + width + 1, dtype=np.int64)
    marks[starts] += 1
    marks[starts + width] -= 1
    return np.cumsum(marks)[:n_words] > 0


class Windows:
    """Words of a block's texts, where they are asked for, and the fingerprints of all windows that
    lie in one text, or their first lane only. A portion of the texts is split at a time."""

    def __init__(
        self, texts: list[bytes | None], width: int, with_words: bool = True, lanes: int = 2
    ):
        self.words, self.n_words = [] if with_words else None, 0
        all_counts, starts = [np.zeros(0, dtype="i8")], [np.zeros(0, dtype="i8")]
        found = [[np.zeros(0, dtype="u8")] for _ in range(lanes)]
        for some in _portions(texts):
            data, begins, ends, counts = cut_words(some)
            if with_words:
                self.words += data.split()
            # The words from every place to the end of its text.
            room = np.repeat(np.cumsum(counts), counts) - np.arange(len(begins))
            inside = np.flatnonzero(room >= width)
            for lane, prints in enumerate(word_prints(data, begins, ends, lanes)):
                found[lane].append(window_prints(prints, width, lane)[inside])
            all_counts.append(counts)
            starts.append(inside + self.n_words)
            self.n_words += len(begins)
        self.counts = np.concatenate(all_counts)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.starts = np.concatenate(starts)
        self.first, self.second = [*map(np.concatenate, found), None][:2]

    def covered(self, repeated: np.ndarray, width: int) -> np.ndarray:
        """Which of the words lie in a repeated window."""
        return _covered(self.starts[repeated], self.n_words, width)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _cells(windows: Windows, row: int, shards: int) -> np.ndarray:
    """Shard and cell of every window in one row of the sketch, as one number."""
    cells = np.empty(len(windows.first), dtype=np.uint64)
    for at in range(0, len(cells), 1 << 16):
        some = windows.first[at : at + (1 << 16)]
        hashes = mixed(some + np.uint64(int(_ODD) * (row + 1) & _ALL))
        cell = hashes & np.uint64((1 << CELL_BITS) - 1)
        cells[at : at + (1 << 16)] = _shard_of(hashes, shards) << np.uint64(CELL_BITS) | cell
    return cells


def _counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and whether each stands there twice or more."""
    # One more than there are keys: the end is new, too.
    new = np.ones(len(sorted_keys) + 1, dtype=bool)
    new[1:-1] = sorted_keys[1:] != sorted_keys[:-1]
    return sorted_keys[new[:-1]], ~new[1:][new[:-1]]


def _slices(shards: np.ndarray):
    """Number and bounds of every shard in a sorted list of them."""
    at = np.flatnonzero(np.diff(shards, prepend=-1))
    return zip(shards[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shards)])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Bytes of ascending numbers: their differences, byte plane by byte plane, compressed."""
    steps = np.diff(numbers.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.cumsum(planes.reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool)


PIECE = "shard int, block int, n int, keys binary, twice binary, places binary"
ANSWER = "block int, shard int, repeated binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_PIECE = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("n", pa.int32()),
        ("keys", pa.binary()),
        ("twice", pa.binary()),
        ("places", pa.binary()),
    ]
)
_ANSWER = pa.schema(
    [
        ("block", pa.int32()),
        ("shard", pa.int32()),
        ("repeated", pa.binary()),
    ]
)


def sketch_pieces(windows: Windows, shards: int, depth: int):
    """Row after row, shard after shard: the block's cells and which of them it fills twice."""
    for row in range(depth):
        keys = _cells(windows, row, shards)
        keys.sort()
        keys, twice = _counted(keys)
        first = np.arange(shards + 1, dtype=np.uint64) << np.uint64(CELL_BITS)
        at = np.searchsorted(keys, first).tolist()
        for shard, (a, b) in enumerate(pairwise(at)):
            if a < b:
                cells = keys[a:b] & np.uint64((1 << CELL_BITS) - 1)
                yield row * shards + shard, cells, twice[a:b]


def merge_sketch(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Add up one shard of the sketch, counting no further than two; for every piece, which of its
    cells are estimated repeated."""
    counts = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    for cells, twice in pieces:
        counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
    return [counts[cells] > 1 for cells, _ in pieces]


def _among(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which numbers are in a sorted list; a table of their low bits settles most of them."""
    low = np.uint64((1 << 22) - 1)
    table_ = np.zeros(1 << 22, dtype=bool)
    table_[(keys & low).astype(np.int64)] = True
    found = table_[(wanted & low).astype(np.int64)]
    rest = np.flatnonzero(found)
    at = np.minimum(np.searchsorted(keys, wanted[rest]), len(keys) - 1)
    found[rest] = keys[at] == wanted[rest]
    return found


def candidates(windows: Windows, shards: int, depth: int, answers: dict[int, bytes]) -> np.ndarray:
    """Windows all of whose cells are estimated repeated."""
    found = np.ones(len(windows.starts), dtype=bool)
    flagged: list[list[np.ndarray]] = [[] for _ in range(depth)]
    for number, cells, _ in sketch_pieces(windows, shards, depth):
        row, shard = divmod(number, shards)
        repeated = cells[_flags(answers[number], len(cells))]
        flagged[row].append(repeated | np.uint64(shard << CELL_BITS))
    for row in range(depth):
        keys = np.concatenate(flagged[row]) if flagged[row] else np.zeros(0, dtype=np.uint64)
        if not len(keys):
            return np.zeros(0, dtype=np.int64)
        found &= _among(_cells(windows, row, shards), keys)
    return np.flatnonzero(found)


def exact_pieces(windows: Windows, chosen: np.ndarray, shards: int):
    """Shard after shard: fingerprints of the chosen windows, each once, whether it stands twice,
    and where its first window begins, in ascending order. At last, where all windows begin that
    stand twice in the block, as a piece without fingerprints for one of the shards."""
    first, second, starts = windows.first[chosen], windows.second[chosen], windows.starts[chosen]
    order = np.lexsort((first, second))
    first, second, starts = first[order], second[order], starts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(order)))
    inner = np.sort(starts[np.repeat(many > 1, many)])
    # Sorting is stable, so the first of equal ones is the first of the block.
    first, second, starts, twice = first[at], second[at], starts[at], many > 1
    shard = _shard_of(second, shards)
    order = np.argsort(shard << np.uint64(32) | starts.astype(np.uint64))
    prints, starts, twice = np.column_stack([first, second])[order], starts[order], twice[order]
    for number, a, b in _slices(shard[order].astype(np.int64)):
        yield number, prints[a:b], twice[a:b], starts[a:b]
    if len(inner):
        yield int(windows.first[0] % np.uint64(shards)), prints[:0], twice[:0], inner


def merge_exact(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For every piece, which of its fingerprints stand twice or more over all pieces."""
    prints = np.concatenate([p for p, _ in pieces])
    weights = np.concatenate([1 + t.astype(np.int64) for _, t in pieces])
    order = np.lexsort((prints[:, 1], prints[:, 0]))
    ordered = prints[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    repeated = np.zeros(len(order), dtype=bool)
    repeated[order] = (np.bincount(group, weights[order]) > 1)[group]
    return np.split(repeated, np.cumsum([len(p) for p, _ in pieces])[:-1])


def remove_repeated(
    docs: DataFrame, text: str = "text", window: int = WINDOW, depth: int = DEPTH
) -> DataFrame:
    """The columns of `docs` with what is left of the texts, and `passages`: number of words, of
    removed words, and the SHA-256 of the remaining words joined by one space. A column of that name
    is replaced."""
    names = docs.columns
    at = names.index(text)
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    blocks, shards = 1 + size // BLOCK_BYTES, 1 + size // SHARD_BYTES
    columns = [
        F.col(f"`{n}`").cast("binary" if n == text else docs.schema[n].dataType).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType)))
    placed = docs.select(F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), *columns)
    here = f"c{at}"

    def windows_of(texts: list[bytes | None], lanes: int) -> Windows:
        give_back()  # what the block before took
        return Windows(texts, window, with_words=False, lanes=lanes)

    def in_order(rows: pa.Table) -> tuple[list[int], list[bytes | None]]:
        """The rows of a block by their texts: equal texts have equal windows, so places in this
        order are the same in every task."""
        texts = rows.column(here).to_pylist()
        order = sorted(range(len(texts)), key=lambda row: texts[row] or b"")
        return order, [texts[row] for row in order]

    def sketch(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block = key[0].as_py()
        windows = windows_of(rows.column(here).to_pylist(), lanes=1)
        return _table(
            [
                (number, block, len(cells), _squeezed(cells), _bits(twice), None)
                for number, cells, twice in sketch_pieces(windows, shards, depth)
            ],
            _PIECE,
        )

    def estimate(rows: pa.Table) -> pa.Table:
        given = rows.to_pylist()
        pieces = [(_unsqueezed(r["keys"]), _flags(r["twice"], r["n"])) for r in given]
        answers = merge_sketch(pieces)
        return _table([(r["block"], r["shard"], _bits(a)) for r, a in zip(given, answers)], _ANSWER)

    def fingerprint(
        key: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table
    ) -> pa.Table:
        windows = windows_of(in_order(rows)[1], lanes=2)
        estimated = {r["shard"]: r["repeated"] for r in replies.to_pylist()}
        chosen = candidates(windows, shards, depth, estimated)
        return _table(
            [
                (
                    number,
                    key[0].as_py(),
                    len(prints),
                    prints.astype("<u8").tobytes(),
                    _bits(twice),
                    _squeezed(starts),
                )
                for number, prints, twice, starts in exact_pieces(windows, chosen, shards)
            ],
            _PIECE,
        )

    def group(rows: pa.Table) -> pa.Table:
        given = rows.to_pylist()
        # Of a block's own repetitions the places are handed on as they are.
        known = [(r["block"], r["shard"], r["places"]) for r in given if not r["n"]]
        given = [r for r in given if r["n"]]
        pieces = [
            (np.frombuffer(r["keys"], dtype="<u8").reshape(-1, 2), _flags(r["twice"], r["n"]))
            for r in given
        ]
        merged = merge_exact(pieces) if pieces else []
        found = [
            (r["block"], r["shard"], _squeezed(_unsqueezed(r["places"])[repeated & ~twice]))
            for r, (_, twice), repeated in zip(given, pieces, merged)
            if (repeated & ~twice).any()
        ]
        return _table(known + found, _ANSWER)

    kept_fields = [
        *(T.StructField(f"c{i}", placed.schema[f"c{i}"].dataType) for i in range(len(names))),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]

    def remove(rows: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()  # what the block before took
        order, texts = in_order(rows)
        counts = np.concatenate([cut_words(some)[3] for some in _portions(texts)])
        starts = [_unsqueezed(r) for r in replies.column("repeated").to_pylist()]
        starts = np.concatenate([np.zeros(0, dtype=np.int64), *starts])
        gone = _covered(starts, int(counts.sum()), window)
        ends = np.cumsum(counts)
        removed = np.diff(np.append(0, np.cumsum(gone))[np.append(0, ends)])
        left, digests = [None] * len(order), [None] * len(order)
        for row, text_, a, b, less in zip(
            order, texts, (ends - counts).tolist(), ends.tolist(), removed.tolist()
        ):
            words = (text_ or b"").split()
            if less:
                words = compress(words, (~gone[a:b]).tolist())
            kept = b" ".join(words)
            left[row] = kept if less else text_
            digests[row] = hashlib.sha256(kept).hexdigest()
        back = np.argsort(order)
        counts, removed = pa.array(counts[back], pa.int64()), pa.array(removed[back], pa.int64())
        del gone, starts, texts  # the worker may wait while later stages need the memory
        give_back()
        rows = rows.drop_columns(["block"])
        rows = rows.set_column(at, here, pa.array(left, rows.schema.field(here).type))
        rows = rows.append_column("n_words", counts)
        rows = rows.append_column("n_removed", removed)
        return rows.append_column("kept_sha256", pa.array(digests, pa.string()))

    texts = placed.groupBy("block")
    estimates = texts.applyInArrow(sketch, PIECE).groupBy("shard").applyInArrow(estimate, ANSWER)
    prints = texts.cogroup(estimates.groupBy("block")).applyInArrow(fingerprint, PIECE)
    exact = prints.groupBy("shard").applyInArrow(group, ANSWER)
    done = texts.cogroup(exact.groupBy("block")).applyInArrow(remove, T.StructType(kept_fields))
    return done.select(
        *(
            F.col(f"c{i}").cast(docs.schema[n].dataType).alias(n)
            for i, n in enumerate(names)
            if n != "passages"
        ),
        F.struct("n_words", "n_removed", "kept_sha256").alias("passages"),
    )


def _hashable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "passages.*")


@own_columns
def stage_substring_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns; of changed ones what is left of the text, and its
    length where there is a column `n_chars`."""
    left = remove_repeated(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("passages.n_removed") > 0, F.length("text").cast("bigint"))
        left = left.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return left.drop("passages")


# A word is removed where the last repeated window that begins at or before it reaches it.
OP5_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM docs WHERE len(w) >= 35),
windows AS (SELECT r, p, array_to_string(list_slice(w, p, p + 34), ' ') AS t FROM starts),
repeated AS (
    SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY t) AS n FROM windows) WHERE n > 1
),
words AS (
    SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
),
marked AS (
    SELECT words.r, word, i,
           coalesce(max(p) OVER (PARTITION BY words.r ORDER BY i) >= i - 34, FALSE) AS gone
    FROM words LEFT JOIN repeated ON repeated.r = words.r AND p = i
),
summed AS (
    SELECT r, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
    FROM marked GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (r)
"""

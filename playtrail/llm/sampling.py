"""Sampled piece segmentations that can be drawn again, and lossless decoding.

Encoding draws from the distribution of all segmentations of each pre-token: forward sums are
filtered over the lattice once per prefix, for all new prefixes of a portion of text together; then
a segmentation is sampled backwards from the end. The random numbers are a hash of the seed, the
row's key, the pre-token's place in the text and the step, so a row gets the same ids on any
cluster, in any partition and order of rows. All pre-tokens of a batch are sampled together in
Numpy.

Decoding concatenates what the ids stand for and takes the first space away. Any text comes back
byte by byte: spaces are pieces, and whatever has no piece, also the vocabulary's own mark for
spaces, is written as bytes.

Defined results: a null or empty text has no ids and decodes to the empty text; a null key counts as
an empty one; equal keys with equal texts get equal ids, so repeated rows do; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrail.llm.common import kept, table
from playtrail.llm.pieces import LONG, Pieces, SampleTrie, pre_tokens, read_pieces

VOCABULARY = "piece_bpe_32k.model"
MAX_NODES = 600_000
PIECE_BYTES = 2_000_000  # text sampled at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, a public bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


class Ends(dict):
    """Node of each pre-token; one that is missing gets its node in the trie first. Long ones get
    the numbers -1, -2, ... until `settled` inserts them."""

    def __init__(self, trie: SampleTrie):
        super().__init__()
        self.trie = trie
        self.long: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            self.long.append(word)
            return -len(self.long)
        node = self[word] = self.trie.reach(word)
        return node

    def settled(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes, after all that is new in the trie has been computed."""
        self.trie.fill()
        long = np.array([self.trie.insert(word) for word in self.long], dtype=nodes.dtype)
        self.long = []
        below = np.flatnonzero(nodes < 0)
        nodes[below] = long[-1 - nodes[below]]
        return nodes


class Sampler:
    def __init__(self, pieces: Pieces, seed: int, sharpness: float, max_nodes: int = MAX_NODES):
        self.trie = SampleTrie(pieces, sharpness)
        self.ends = Ends(self.trie)
        self.seed, self.max_nodes = seed, max_nodes
        self.bytes_ = np.array(pieces.bytes_)
        self.used = np.zeros(1, dtype=np.int32)  # portions of text in which a pre-token ended here

    def _make_room(self) -> None:
        """Drop the rare pre-tokens of a full trie: those met in one portion only, then in two, four
        and so on, until it is half empty. No sample depends on what is kept."""
        nodes = np.fromiter(self.ends.values(), dtype=np.int64, count=len(self.ends))
        self._count(nodes[:0])
        times, least = self.used[nodes], 2
        while (times >= least).sum() > self.max_nodes // 8:
            least *= 2
        number = self.trie.thin_out(nodes[times >= least])
        kept = {w: int(number[n]) for w, n in self.ends.items() if self.used[n] >= least}
        self.used = self.used[number >= 0] // 2
        self.ends.clear()
        if self.trie.size > self.max_nodes // 2:
            self.trie.clear()
            self.used = np.zeros(1, dtype=np.int32)
        else:
            self.ends.update(kept)

    def _count(self, ends: np.ndarray) -> None:
        if len(self.used) < self.trie.size:
            more = np.zeros(self.trie.size - len(self.used), dtype=np.int32)
            self.used = np.concatenate([self.used, more])
        seen = np.zeros(self.trie.size, dtype=bool)
        seen[ends] = True
        self.used += seen

    def encode(self, keys: list[str], texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of every text."""
        if self.trie.size > self.max_nodes:
            self._make_room()
        words = [list(map(self.ends.__getitem__, pre_tokens(text))) for text in texts]
        many = np.array([len(w) for w in words], dtype=np.int64)
        ends = self.ends.settled(np.array([n for w in words for n in w], dtype=np.int32))
        self._count(ends)
        first = np.concatenate([[0], np.cumsum(many)])
        place = np.arange(len(ends)) - np.repeat(first[:-1], many)
        streams = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)
        state = mixed(np.repeat(streams, many) + place.astype(np.uint64) * _STEP)
        ids, widths = self._sample(ends, state)
        reach = np.concatenate([[0], np.cumsum(widths)])[first]
        return [ids[a:b] for a, b in zip(reach[:-1], reach[1:])]

    def _sample(self, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in order, and how many each has."""
        trie = self.trie
        first, origin, piece_of, width_of = (
            np.frombuffer(x, dtype="i4") if len(x) else np.zeros(0, "i4")
            for x in (trie.first, trie.origin, trie.piece, trie.width)
        )
        reached = np.frombuffer(trie.reached) if len(trie.reached) else np.zeros(0)
        widths = np.zeros(len(ends), dtype=np.int64)
        taken = []
        live, node = np.arange(len(ends)), ends
        while len(live):
            state = mixed(state + _STEP)
            drawn = (state >> np.uint64(32)).astype(np.float64) / 2.0**32
            edge = first[node]
            over = np.flatnonzero(reached[edge] <= drawn)
            while len(over):
                edge[over] += 1
                over = over[reached[edge[over]] <= drawn[over]]
            taken.append((live, edge))
            widths[live] += width_of[edge]
            node = origin[edge]
            more = np.flatnonzero(node)
            live, node, state = live[more], node[more], state[more]
        end = np.cumsum(widths)
        ids = np.zeros(end[-1] if len(end) else 0, dtype=np.int32)
        for who, edge in taken:
            piece, width = piece_of[edge], width_of[edge]
            end[who] -= width
            ids[end[who]] = piece
            spelled = np.flatnonzero(piece < 0)
            for word, code in zip(who[spelled].tolist(), (-1 - piece[spelled]).tolist()):
                raw = chr(code).encode("utf-8", "surrogateescape")
                ids[end[word] : end[word] + len(raw)] = self.bytes_[list(raw)]
        return ids, widths


def _kept_sampler(pieces: Pieces, seed: int, sharpness: float) -> Sampler:
    key = ("sampler", hash(pieces), seed, sharpness)
    return kept(key, lambda: Sampler(pieces, seed, sharpness))


def decoder(pieces: Pieces):
    """Function from ids to UTF-8 bytes."""
    surface = pieces.surface()

    def decode(ids) -> bytes:
        return b"".join(map(surface.__getitem__, ids))[1:]

    return decode


ENCODED = "struct<ids:array<int>,decoded_sha256:string,lossless:boolean>"


def _portions(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or b"")
        if held >= PIECE_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_sampled(
    docs: DataFrame,
    key: Column,
    text: Column,
    seed: int = 0,
    sharpness: float = 1.0,
    vocabulary: str | None = None,
) -> Column:
    """Struct of the sampled `ids`, the SHA-256 of the text they decode to, and whether that is the
    text itself. `sharpness` is the power the probabilities are raised to: 0 makes all segmentations
    equally likely, a large one leaves the best."""
    pieces = read_pieces(vocabulary or public_tokenizers.path(VOCABULARY))
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = T._parse_datatype_string(ENCODED)

    @F.arrow_udf(kind)
    def over(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sampler, decode = _kept_sampler(sent.value, seed, sharpness), decoder(sent.value)
        for keys, texts in batches:
            keys, texts = keys.to_pylist(), texts.to_pylist()
            ids, digests, same = [], [], []
            for a, b in _portions(texts):
                for found, given in zip(sampler.encode(keys[a:b], texts[a:b]), texts[a:b]):
                    back = decode(found.tolist())
                    ids.append(found)
                    digests.append(hashlib.sha256(back).hexdigest())
                    same.append(back == (given or b""))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            yield pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    pa.array(digests, pa.string()),
                    pa.array(same, pa.bool_()),
                ],
                names=["ids", "decoded_sha256", "lossless"],
            )

    return over(F.coalesce(key.cast("string"), F.lit("")), text.cast("binary"))


def decode_ids(docs: DataFrame, ids: Column, vocabulary: str | None = None) -> Column:
    """The text of a list of ids; null for null."""
    pieces = read_pieces(vocabulary or public_tokenizers.path(VOCABULARY))
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("binary")
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = decoder(sent.value)
        for batch in batches:
            yield pa.array(
                [None if row is None else decode(row) for row in batch.to_pylist()], pa.binary()
            )

    return over(ids).cast("string")


def _encoded(docs: DataFrame) -> DataFrame:
    coded = docs.select("doc_id", encode_sampled(docs, F.col("doc_id"), F.col("text")).alias("e"))
    return coded.select(
        "doc_id",
        F.size("e.ids").cast("bigint").alias("n_ids"),
        "e.ids",
        "e.decoded_sha256",
        "e.lossless",
    )


def op6_piece_sampling(spark, sf_dir: str) -> DataFrame:
    return _encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_piece_encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, for the last stage of the pipeline."""
    return _encoded(docs)

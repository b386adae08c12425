"""Unigram pieces, the lattice over a trie of pre-tokens, and its forward scores.

The vocabulary is read from a public SentencePiece file, never trained. Its scores are negative
ranks of merges; rank r gets the probability of Zipf's law, proportional to 1 / (r + 1).

Texts are cut into pre-tokens: a run of word characters or of other signs, each with the space before
it, or a single white-space character. No piece crosses them, so each pre-token is a lattice of its
own. A pre-token of more than `LONG` characters, as texts without spaces are, is computed like any
other, but its prefixes are not kept to be shared. A character without a piece is written as its UTF-8
bytes. An extra space stands before every text that is not empty, as usual for such vocabularies;
decoding takes it away again.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from math import exp, inf, log

import numpy as np

LONG = 48
_PRE_TOKEN = re.compile(r" ?\w+| ?[^\w\s]+|\s")
# The mark of a space in the vocabulary, and what an unknown character costs more than
# the rarest piece.
SPACE = "▁"
UNKNOWN_COST = 10.0


def pre_tokens(text: bytes | None) -> list[str]:
    if not text:
        return []
    return _PRE_TOKEN.findall(" " + text.decode("utf-8", "surrogateescape"))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


@dataclass(frozen=True)
class Pieces:
    """Ids and log-probabilities of pieces; ids of the 256 bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: tuple[int, ...]
    unknown: float
    longest: int

    def __hash__(self) -> int:
        return hash((frozenset(self.scores.items()), frozenset(self.ids.items()), self.bytes_))

    def surface(self) -> dict[int, bytes]:
        """What every id stands for."""
        back = {i: utf8(piece) for piece, i in self.ids.items()}
        return back | {i: bytes([b]) for b, i in enumerate(self.bytes_)}


def read_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ranks, bytes_ = {}, {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[1:-1], 16)] = i
        # Runs of spaces have no rank, and no pre-token holds one.
        elif not (model.is_control(i) or model.is_unknown(i) or SPACE in piece[1:]):
            text = piece.replace(SPACE, " ")
            ids[text], ranks[text] = i, -model.get_score(i)
    total = sum(1 / (r + 1) for r in ranks.values())
    scores = {piece: -log((r + 1) * total) for piece, r in ranks.items()}
    return Pieces(
        ids,
        scores,
        tuple(bytes_[b] for b in range(256)),
        min(scores.values()) - UNKNOWN_COST,
        max(map(len, ids)),
    )


class Trie:
    """Pre-tokens by their characters. A node stands for a prefix; what is computed for it is
    computed once for all pre-tokens that begin with it. `start` is called for the root and `enter`
    for every new node, in the order of their numbers; `path` has the nodes of all shorter
    prefixes. `endings` has every ending of every piece, with the id where it is one itself, so a
    search for the pieces that end at a node stops where no longer one can follow."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.endings = {p[k:]: -1 for p in pieces.ids for k in range(len(p))} | pieces.ids
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.size = 1
        self.start()

    def start(self) -> None:
        raise NotImplementedError

    def enter(self, word: str, path: list[int], end: int) -> None:
        raise NotImplementedError

    def insert(self, word: str) -> int:
        """The node where the pre-token ends."""
        children, node, path = self.children, 0, [0]
        if len(word) > LONG:
            for end in range(1, len(word) + 1):
                self.enter(word, path, end)
                path.append(self.size)
                self.size += 1
            return path[-1]
        for end, char in enumerate(word, 1):
            key = node << 21 | ord(char)
            node = children.get(key, 0)
            if not node:
                self.enter(word, path, end)
                node = children[key] = self.size
                self.size += 1
            path.append(node)
        return node


class CountTrie(Trie):
    """Best score of each prefix and the number of tokens of that segmentation; the fewer win where
    scores are equal."""

    def start(self) -> None:
        self.best, self.tokens_to = array("d", [0.0]), array("l", [0])

    def enter(self, word: str, path: list[int], end: int) -> None:
        best, tokens_to, endings = self.best, self.tokens_to, self.endings
        scores = self.pieces.scores
        top, fewest = -inf, 0
        for first in range(end - 1, -1, -1):
            piece = word[first:end]
            i = endings.get(piece)
            if first == end - 1 and (i is None or i < 0):
                node = path[first]
                top = best[node] + self.pieces.unknown
                fewest = tokens_to[node] + len(utf8(piece))
            if i is None:
                break
            if i >= 0:
                node = path[first]
                score, tokens = best[node] + scores[piece], tokens_to[node] + 1
                if score > top or score == top and tokens < fewest:
                    top, fewest = score, tokens
        best.append(top)
        tokens_to.append(fewest)

    def tokens(self, word: str) -> int:
        return self.tokens_to[self.insert(word)]


class SampleTrie(Trie):
    """Forward sums of each prefix, and for every node its incoming edges with the cumulative
    probability with which backward sampling takes them. The edges of a node lie side by side from
    `first` on; the cumulative probability of its last one is 1.

    Many pre-tokens are inserted together: `reach` gives them their nodes, and `fill` then computes
    the edges of all new nodes, a step back at a time, and their sums, a depth at a time."""

    def __init__(self, pieces: Pieces, sharpness: float = 1.0):
        self.sharpness = sharpness
        super().__init__(pieces)
        # Endings of pieces as a trie read backwards: keys of its steps in order, where each leads
        # (0 is the start), and the piece found there, or -1, with its score.
        state = {"": 0} | {ending: k for k, ending in enumerate(self.endings, 1)}
        keys = np.array([state[e[1:]] << 21 | ord(e[0]) for e in self.endings], dtype=np.int64)
        order = np.argsort(keys)
        self.steps, self.leads = keys[order], order + 1
        self.found = np.array([-1, *self.endings.values()], dtype=np.int32)
        scores = pieces.scores
        self.score = sharpness * np.array([0.0, *(scores.get(e, 0.0) for e in self.endings)])

    def start(self) -> None:
        self.forward = array("d", [0.0])
        self.first = array("i", [0])
        self.reached = array("d")
        self.origin = array("i")
        self.piece = array("i")  # id, or -1 - code point of a character written as bytes
        self.width = array("i")
        self.parent, self.char = array("i", [0]), array("i", [0])
        self.depths = array("i")  # of nodes whose edges are not computed yet, the last ones

    def reach(self, word: str) -> int:
        """The node where a pre-token of at most `LONG` characters ends; `fill` must follow."""
        children, node = self.children, 0
        for at, char in enumerate(word):
            after = children.get(node << 21 | ord(char))
            if after is None:
                break
            node = after
        else:
            return node
        size, rest = self.size, list(map(ord, word[at:]))
        for code in rest:
            children[node << 21 | code] = size
            self.parent.append(node)
            node, size = size, size + 1
        self.char.extend(rest)
        self.depths.extend(range(at + 1, len(word) + 1))
        self.size = size
        return node

    def fill(self) -> None:
        """Edges and sums of the new nodes."""
        many = len(self.depths)
        if not many:
            return
        new = self.size - many
        parent, char = np.frombuffer(self.parent, "i4"), np.frombuffer(self.char, "i4")
        edges, count = [], np.zeros(many, dtype=np.int32)
        row, node = np.arange(many), np.arange(new, self.size)
        state = np.zeros(many, dtype=np.int64)
        while len(row):
            code, before = char[node], parent[node]
            key = state << 21 | code
            step = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            known = self.steps[step] == key
            state = np.where(known, self.leads[step], 0)
            piece, score = self.found[state], self.score[state]
            width = np.ones(len(row), dtype=np.int32)
            if not edges:  # a character without a piece is written as its bytes
                bare = piece < 0
                piece, width = np.where(bare, -1 - code, piece), np.where(bare, _utf8_width(code), 1)
                score = np.where(bare, self.sharpness * self.pieces.unknown, score)
                taken = np.arange(len(row))
            else:
                taken = np.flatnonzero(piece >= 0)
            rows = row[taken]
            edges.append((rows, count[rows], before[taken], piece[taken], width[taken], score[taken]))
            count[rows] += 1
            longer = np.flatnonzero(known & (before > 0))
            row, node, state = row[longer], before[longer], state[longer]
        first = np.cumsum(count, dtype=np.int64) - count
        at = np.concatenate([first[rows] + rank for rows, rank, *_ in edges])
        origin, piece, width, score = (_placed([e[k] for e in edges], at) for k in range(2, 6))
        forward = np.append(np.frombuffer(self.forward), np.zeros(many))
        reached = np.zeros(len(at))
        depths = np.frombuffer(self.depths, "i4")
        by_depth = np.argsort(depths, kind="stable")
        for nodes in np.split(by_depth, np.flatnonzero(np.diff(depths[by_depth])) + 1):
            # Sums run from edge to edge, so that none depends on the other nodes.
            place = np.arange(count[nodes].max())
            there = place < count[nodes][:, None]
            edge = np.where(there, first[nodes][:, None] + place, 0)
            logs = np.where(there, forward[origin[edge]] + score[edge], -np.inf)
            top = logs.max(axis=1)
            shares = np.exp(logs - top[:, None])
            total = np.cumsum(shares, axis=1)[:, -1]
            forward[new + nodes] = top + np.log(total)
            reached[edge[there]] = np.cumsum(shares / total[:, None], axis=1)[there]
        reached[first + count - 1] = 1.0
        first += len(self.reached)
        del parent, char, depths  # arrays cannot grow while they are looked into
        self.forward.frombytes(forward[new:].tobytes())
        self.reached.frombytes(reached.tobytes())
        columns = (self.first, first), (self.origin, origin), (self.piece, piece), (self.width, width)
        for held, more in columns:
            held.frombytes(more.astype("i4").tobytes())
        del self.depths[:]

    def enter(self, word: str, path: list[int], end: int) -> None:
        forward, endings, scores = self.forward, self.endings, self.pieces.scores
        sharpness = self.sharpness
        logs, edges = [], []
        for first in range(end - 1, -1, -1):
            piece = word[first:end]
            i = endings.get(piece)
            if first == end - 1 and (i is None or i < 0):
                logs.append(forward[path[first]] + sharpness * self.pieces.unknown)
                edges.append((path[first], -1 - ord(piece), len(utf8(piece))))
            if i is None:
                break
            if i >= 0:
                logs.append(forward[path[first]] + sharpness * scores[piece])
                edges.append((path[first], i, 1))
        self.parent.append(path[-1])
        self.char.append(ord(word[end - 1]))
        top = max(logs)
        shares = [exp(x - top) for x in logs]
        total = sum(shares)
        forward.append(top + log(total))
        self.first.append(len(self.reached))
        reached = 0.0
        for (before, i, width), share in zip(edges, shares):
            reached += share / total
            self.reached.append(reached)
            self.origin.append(before)
            self.piece.append(i)
            self.width.append(width)
        self.reached[-1] = 1.0

    def thin_out(self, wanted: np.ndarray) -> np.ndarray:
        """Leave only the nodes on the way to `wanted` ones, which are of shared prefixes, and give
        the new number of every node, or -1. Nothing is computed anew."""
        self.children = {}  # its memory is needed for the new one
        parent, char = (np.array(x, dtype=np.int64) for x in (self.parent, self.char))
        needed = np.zeros(self.size, dtype=bool)
        needed[0] = True
        level = np.unique(wanted)
        while len(level):
            level = level[~needed[level]]
            needed[level] = True
            level = np.unique(parent[level])
        kept = np.flatnonzero(needed)
        number = np.where(needed, np.cumsum(needed) - 1, -1)
        starts = np.append(np.frombuffer(self.first, dtype="i4"), len(self.reached)).astype(np.int64)
        width = np.diff(starts)[kept]
        first = np.cumsum(width) - width
        edge = np.arange(int(width.sum())) + np.repeat(starts[kept] - first, width)
        origin = number[np.frombuffer(self.origin, dtype="i4")[edge]] if len(edge) else edge
        parent, char = number[parent[kept]], char[kept]
        self.children = dict(zip((parent[1:] << 21 | char[1:]).tolist(), range(1, len(kept))))
        self.parent, self.char = (array("i", x.astype("i4").tobytes()) for x in (parent, char))
        self.forward = _taken(self.forward, kept)
        self.first = array("i", first.astype("i4").tobytes())
        self.origin = array("i", origin.astype("i4").tobytes())
        for name in ("reached", "piece", "width"):
            setattr(self, name, _taken(getattr(self, name), edge))
        self.size = len(kept)
        return number


def _utf8_width(codes: np.ndarray) -> np.ndarray:
    """Bytes of each character; a surrogate stands for one that is no UTF-8."""
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    return np.where((codes >= 0xDC80) & (codes <= 0xDCFF), 1, width)


def _placed(parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    values = np.concatenate(parts)
    placed = np.empty_like(values)
    placed[at] = values
    return placed


def _taken(values: array, at: np.ndarray) -> array:
    """Some of the values, in order."""
    if not len(at):
        return array(values.typecode)
    return array(values.typecode, np.frombuffer(values, dtype=values.typecode)[at].tobytes())

"""Alignment of two tokenizers: which tokens of a byte-level BPE and of a piece model share bytes.

Each side reports where its tokens end: the tokenizers library as character offsets, sentencepiece
as the byte spans of its proto. Spans are coarse: the tokens of a character that is split over
several of them, and byte-fallback pieces, share one span. Such tokens are cut finely by the length
of the bytes they stand for. Where tokens of both sides end at the same byte, the text is cut into
groups; within it, every pair of tokens that overlaps is a link.

Both tokenizers cut at a space that follows no white space, if the byte-level side splits by its
usual pattern and no piece holds a space after another character. Then each distinct stretch from
such a space to the next is aligned once per worker and kept for later texts. `Aligner` looks both
conditions up; where one fails, and for a text that holds a stretch of which a side's bytes do not
join to the text, the whole text is aligned at once. Letters and signs behind them are aligned apart,
once for all stretches that have them, where no piece holds a letter before a sign; the byte-level
side always cuts there.

The counts of id pairs are corpus-wide, so the work has two passes. The first aligns every text and
stores each document's id pairs with their number, and the sums of each task; the sums are added by
pair. The second looks the stored pairs up in the table of counts, which is broadcast in portions of
at most `MAX_PAIRS` pairs; the number of pairs is bounded by the two vocabularies, whatever the
number of texts. Texts are tokenized once only.

Defined results: a null or empty text, one that is not UTF-8, and one whose joined bytes differ from
space + text on either side has no tokens, zeros and an empty digest; such texts add to no count.
Repeated rows count again; of equally frequent partners of an id all are best; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrail.llm.common import kept, table, workspace

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SPACE_MARK = "▁"
PORTION = 1_000_000  # bytes of text aligned at a time
CHUNK = 50_000  # characters of new stretches tokenized as one text
SHIFT = 40
KEPT_STRETCHES = 500_000
KEPT_BYTES = 40_000_000  # of their groups
MAX_PAIRS = 4_000_000
HELD_PAIRS = 1_000_000

# A letter of one code point, and a sign that the byte-level side cuts off it.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIXED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][!-/:-@\[-`{-~]")


def byte_of_sign() -> dict[str, int]:
    """The bytes that the printable signs of a byte-level vocabulary stand for: printable Latin-1
    bytes stand for themselves, all others in ascending order for U+0100 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _byte_reach(text: str) -> np.ndarray:
    """Bytes before each character of a text, and before its end."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.append(0, np.cumsum(wide))


def _refined(stops: np.ndarray, coarse: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Byte where each token ends: what its span says, or, where the span is `coarse`, the end of the
    token before and the token's own bytes."""
    by_bytes = np.cumsum(widths)
    place = np.where(coarse, -1, np.arange(len(stops)))
    last = np.maximum.accumulate(place) if len(place) else place
    shift = np.where(last >= 0, stops[last] - by_bytes[last], 0)
    return by_bytes + shift


class Aligner:
    """Both tokenizers and what they have aligned so far. An alignment is a tuple: the groups as
    bytes, the id pair of every link as `a * width + b`, and the tokens of both sides and the groups
    in one number, SHIFT bits each."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        signs = byte_of_sign()
        n_a, self.width = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [
            bytes(signs[c] for c in self.a.id_to_token(i) or "" if c in signs) for i in range(n_a)
        ]
        names = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_spelled = np.array([self.b.is_byte(i) for i in range(self.width)])
        self.b_bytes = [
            bytes([int(n[1:-1], 16)]) if spelled else n.replace(SPACE_MARK, " ").encode()
            for n, spelled in zip(names, self.b_spelled.tolist())
        ]
        self.a_widths, self.b_widths = (
            np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes)
        )
        most = max(n_a, self.width)
        self.code_type = np.int32 if n_a * self.width < 2**31 else np.int64
        # Decimal digits of every id, right-aligned, and which of them are shown.
        digits = len(str(most))
        self.digits = np.array([list(str(i).zfill(digits).encode()) for i in range(most)], np.uint8)
        self.shown = np.arange(digits) >= digits - np.array([[len(str(i))] for i in range(most)])
        before = json.loads(byte_level)["pre_tokenizer"] or {}
        self.cuts = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", False)
            and not before.get("add_prefix_space")
            and not any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names)
        )
        # Letters and signs behind them are cut by the byte-level side, and by the other one where no
        # piece holds both. Control pieces stand for themselves, not for their text.
        added = json.loads(byte_level).get("added_tokens") or []
        texts = [t["content"] for t in added if not t["special"]]
        b = self.b
        texts += [
            n
            for i, n in enumerate(names)
            if not (b.is_control(i) or b.is_unknown(i) or b.is_byte(i))
        ]
        self.apart = self.cuts and not any(map(MIXED.search, texts))
        self.known = Stretches(self)

    def _tokens_a(
        self, text: str, raw: bytes, reach: np.ndarray | None
    ) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and the byte where each ends; None where their bytes do not join to the text."""
        coded = self.a.encode(text, add_special_tokens=False)
        if b"".join(map(self.a_bytes.__getitem__, coded.ids)) != raw:
            return None
        ids = np.array(coded.ids, dtype=np.int64)
        spans = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)
        stops = spans[:, 1]
        # The tokens of one character have its span in common.
        shared = np.append(spans[1:, 0] < stops[:-1], False)
        if reach is not None:
            stops = reach[stops]
        return ids, _refined(stops, shared, self.a_widths[ids])

    def _tokens_b(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """The same; the model adds the text's first space itself."""
        found = self.b.encode(text[1:], return_type="proto").pieces
        listed = [p.id for p in found]
        if b"".join(map(self.b_bytes.__getitem__, listed)) != raw:
            return None
        ids = np.array(listed, dtype=np.int64)
        stops = np.fromiter((p.end for p in found), dtype=np.int64, count=len(ids)) + 1
        return ids, _refined(stops, self.b_spelled[ids], self.b_widths[ids])

    def align(self, stretches: list[str]) -> list[tuple] | None:
        """Alignment of each of some stretches, which all begin with a space, taken as one text;
        None where a side's bytes do not join to it, or tokens reach over two stretches."""
        text = "".join(stretches)
        raw = text.encode()
        reach = None if text.isascii() else _byte_reach(text)
        left, right = self._tokens_a(text, raw, reach), self._tokens_b(text, raw)
        if left is None or right is None:
            return None
        (a_ids, a_ends), (b_ids, b_ends) = left, right
        cuts = np.union1d(a_ends, b_ends)
        a_at, b_at = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        codes = (a_ids[a_at] * self.width + b_ids[b_at]).astype(self.code_type)
        common = cuts[(a_ends[a_at] == cuts) & (b_ends[b_at] == cuts)]
        stops = np.cumsum(np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches)))
        if reach is not None:
            stops = reach[stops]
        n_groups = np.searchsorted(common, stops, "right")
        if not np.array_equal(common[n_groups - 1], stops):
            return None
        # Groups of the tokens; the tokens of a group stand together, those of A first.
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_many, b_many = np.bincount(a_group), np.bincount(b_group)
        order = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        a_place = np.arange(len(a_ids)) + (np.cumsum(b_many) - b_many)[a_group]
        b_place = np.arange(len(b_ids)) + np.cumsum(a_many)[b_group]
        order[a_place], order[b_place] = a_ids, b_ids
        signs = np.full(len(order), ord(","), dtype=np.uint8)
        signs[a_place[a_ends == common[a_group]]] = ord("|")
        signs[b_place[b_ends == common[b_group]]] = ord(";")
        written = np.column_stack([self.digits[order], signs])
        shown = np.column_stack([self.shown[order], np.ones(len(order), dtype=bool)])
        groups = written[shown].tobytes()
        written_to = np.append(0, np.cumsum(shown.sum(axis=1)))
        n_a, n_b, n_cuts = (np.searchsorted(x, stops, "right") for x in (a_ends, b_ends, cuts))
        ends = written_to[n_a + n_b]
        packed = codes.tobytes()
        size = codes.itemsize
        counts = [np.diff(x, prepend=0).tolist() for x in (n_a, n_b, n_groups)]
        return [
            (groups[a : b - 1], packed[c * size : d * size], x + (y << SHIFT) + (z << 2 * SHIFT))
            for a, b, c, d, x, y, z in zip(
                np.append(0, ends[:-1]).tolist(),
                ends.tolist(),
                np.append(0, n_cuts[:-1]).tolist(),
                n_cuts.tolist(),
                *counts,
            )
        ]

    def _each(self, stretches: list[str]) -> list[tuple]:
        """Alignment of each stretch; an empty tuple where its bytes do not come back."""
        if not stretches:
            return []
        found = self.align(stretches)
        if found is None and len(stretches) > 1:
            half = len(stretches) // 2
            return self._each(stretches[:half]) + self._each(stretches[half:])
        return [()] if found is None else found

    def _stretches(self, stretches: list[str]) -> list[tuple]:
        """The same for stretches without their space; an empty tuple also for one that runs of white
        space belong to."""
        alone = [s for s in stretches if s and not s[-1].isspace()]
        found: dict[str, tuple] = {}
        first = held = 0
        for i, s in enumerate(alone, 1):
            held += len(s)
            if held > CHUNK or i == len(alone):
                some = alone[first:i]
                found.update(zip(some, self._each([" " + s for s in some])))
                first, held = i, 0
        return [found.get(s, ()) for s in stretches]

    def _after_letters(self, signs: list[str]) -> list[tuple]:
        """The same for signs that letters stand before."""
        if not signs:
            return []
        found = self.align([x for s in signs for x in (" a", s)])
        if found is None and len(signs) > 1:
            half = len(signs) // 2
            return self._after_letters(signs[:half]) + self._after_letters(signs[half:])
        return [()] if found is None else found[1::2]

    def parts(self, keys: list[bytes]) -> list[tuple]:
        """The same for keys of `Stretches`: stretches, and signs with a space before them."""
        texts = [k.decode("utf-8", "replace") for k in keys]
        whole = [t for t in texts if not t.startswith(" ")]
        signs = [t for t in texts if t.startswith(" ")]
        found = dict(zip(whole, self._stretches(whole)))
        for at in range(0, len(signs), 2000):
            some = signs[at : at + 2000]
            found.update(zip(some, self._after_letters([t[1:] for t in some])))
        return [found[t] for t in texts]

    def documents(self, texts: list[str | None]) -> list[tuple | None]:
        """The same for whole texts without their first space; None without tokens."""
        found = self.known.joined([t.encode() if t else b"" for t in texts]) if self.cuts else texts
        return [(f if self.cuts and f else self._whole(t)) if t else None for t, f in zip(texts, found)]

    def _whole(self, text: str) -> tuple | None:
        found = self.align([" " + text])
        return found and found[0]


def _gathered(values: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Stretches of the values, one after the other."""
    reach = np.cumsum(widths)
    return values[np.arange(reach[-1]) + np.repeat(starts - (reach - widths), widths)]


class Stretches(dict):
    """Number of each stretch without its space, and by that number its alignment: the groups with a
    `;` behind them, the codes, and how many tokens of both sides and groups it has; nothing where it
    has no alignment. Signs that stand behind letters are kept as well, with a space before them.
    A stretch of letters and signs is put together from the alignments of both."""

    def __init__(self, aligner: Aligner):
        super().__init__()
        self.aligner = aligner
        self.fresh: list[bytes] = []
        self.groups, self.codes = bytearray(), bytearray()
        self.group_at, self.code_at = array("q", [0]), array("q", [0])
        self.counts = array("q")
        self.used = np.zeros(0, dtype=np.int32)  # portions in which each stretch was met

    def __missing__(self, stretch: bytes) -> int:
        number = self[stretch] = len(self)
        self.fresh.append(stretch)
        return number

    def _arrays(self) -> tuple[np.ndarray, ...]:
        """Groups, codes, where both begin and end, and counts. The table cannot grow while any of
        them is held."""
        return (
            np.frombuffer(self.groups, dtype="u1"),
            np.frombuffer(self.codes, dtype=self.aligner.code_type),
            np.frombuffer(self.group_at, dtype="i8"),
            np.frombuffer(self.code_at, dtype="i8"),
            np.frombuffer(self.counts, dtype="i8").reshape(-1, 3),
        )

    def make_room(self, most: int, most_bytes: int) -> None:
        """Forget the rare stretches: those met in one portion only, then in two, four and so on,
        until few enough are left. No result depends on what is kept."""
        groups, codes, group_at, code_at, counts = self._arrays()
        widths, least = np.diff(group_at), 2
        stays = self.used >= least
        while stays.sum() > most or widths[stays].sum() > most_bytes:
            least *= 2
            stays = self.used >= least
        number = np.cumsum(stays) - 1
        left = {s: int(number[n]) for s, n in self.items() if stays[n]}
        many = np.diff(code_at)
        self.groups = bytearray(groups[np.repeat(stays, widths)].tobytes())
        self.codes = bytearray(codes[np.repeat(stays, many)].tobytes())
        self.group_at = array("q", np.append(0, np.cumsum(widths[stays])).tobytes())
        self.code_at = array("q", np.append(0, np.cumsum(many[stays])).tobytes())
        self.counts = array("q", counts[stays].tobytes())
        self.used = self.used[stays] // 2
        self.clear()
        self.update(left)

    def _learn(self) -> None:
        """Align what is new. Letters and signs that are new themselves follow behind the stretch
        that consists of them."""
        known, alone, joined = len(self) - len(self.fresh), [], []
        apart = self.aligner.apart
        for place, stretch in enumerate(self.fresh):
            letters = stretch.rstrip(SIGNS)
            if apart and 0 < len(letters) < len(stretch) and (
                letters.isalpha() or LETTERS.fullmatch(letters.decode("utf-8", "replace"))
            ):
                signs = self[b" " + stretch[len(letters) :]]
                joined.append((place, self[letters], signs))
            else:
                alone.append(place)
        found: list[tuple] = [()] * len(self.fresh)
        most = (1 << SHIFT) - 1
        for place, one in zip(alone, self.aligner.parts([self.fresh[i] for i in alone])):
            if one:
                groups, codes, n = one
                sizes = n & most, n >> SHIFT & most, n >> 2 * SHIFT
                found[place] = (groups + b";", codes, sizes)
        size = np.dtype(self.aligner.code_type).itemsize

        def part(n: int) -> tuple:
            if n >= known:
                return found[n - known]
            sizes = self.counts[3 * n : 3 * n + 3]
            if not sizes[2]:
                return ()
            groups = self.groups[self.group_at[n] : self.group_at[n + 1]]
            return groups, self.codes[size * self.code_at[n] : size * self.code_at[n + 1]], sizes

        for place, letters, signs in joined:
            left, right = part(letters), part(signs)
            if left and right:
                (a, b, c), (d, e, f) = left[2], right[2]
                found[place] = (left[0] + right[0], left[1] + right[1], (a + d, b + e, c + f))
        self.fresh = []
        if not found:
            return
        groups, codes, counts = zip(*(one or (b"", b"", (0, 0, 0)) for one in found))
        for ends, stored, new, unit in (
            (self.group_at, self.groups, groups, 1),
            (self.code_at, self.codes, codes, size),
        ):
            widths = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) // unit
            ends.frombytes((ends[-1] + np.cumsum(widths)).tobytes())
            stored += b"".join(new)
        self.counts.extend(chain.from_iterable(counts))
        self.used = np.append(self.used, np.zeros(len(found), dtype=np.int32))

    def joined(self, texts: list[bytes]) -> list[tuple | None]:
        """Alignment of each text from its stretches; None where one of them has none, or the text
        is empty."""
        if len(self) > KEPT_STRETCHES or len(self.groups) > KEPT_BYTES:
            self.make_room(KEPT_STRETCHES // 2, KEPT_BYTES // 2)
        split = [t.split(b" ") for t in texts if t]
        if not split:
            return [None] * len(texts)
        many = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        each = map(self.__getitem__, chain.from_iterable(split))
        numbers = np.fromiter(each, dtype=np.int64, count=many.sum())
        self._learn()
        seen = np.zeros(len(self.used), dtype=bool)
        seen[numbers] = True
        self.used += seen
        groups, codes, group_at, code_at, counts = self._arrays()
        last = np.cumsum(many) - 1
        whole = np.logical_and.reduceat(counts[numbers, 2] > 0, last + 1 - many).tolist()
        sums = np.add.reduceat(counts[numbers], last + 1 - many).tolist()
        widths = (group_at[numbers + 1] - group_at[numbers], code_at[numbers + 1] - code_at[numbers])
        group_ends, code_ends = (np.cumsum(w)[last].tolist() for w in widths)
        groups = _gathered(groups, group_at[numbers], widths[0]).tobytes()
        codes = _gathered(codes, code_at[numbers], widths[1])
        found, a, c = [], 0, 0
        for ok, b, d, (x, y, z) in zip(whole, group_ends, code_ends, sums):
            one = groups[a : b - 1], codes[c:d].tobytes(), x + (y << SHIFT) + (z << 2 * SHIFT)
            found.append(one if ok else None)
            a, c = b, d
        each = iter(found)
        return [next(each) if t else None for t in texts]


STORED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, codes array<bigint>, times array<bigint>"
)
_STORED_ARROW = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("codes", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int64())),
    ]
)


def _decoded(text: bytes | None) -> str | None:
    try:
        return text.decode("utf-8") if text else None
    except UnicodeDecodeError:
        return None


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = text.as_py()
            ids.append(doc_id)
            texts.append(_decoded(raw))
            held += len(raw or b"")
            if held > PORTION:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


class PairSums:
    """Links of each id pair of a task, handed on when they fill `HELD_PAIRS`."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((codes, times))
        self.held += len(codes)

    def merge(self) -> None:
        if self.parts:
            codes = np.concatenate([c for c, _ in self.parts])
            times = np.concatenate([t for _, t in self.parts])
            found, place = np.unique(codes, return_inverse=True)
            sums = np.zeros(len(found), dtype=np.int64)
            np.add.at(sums, place, times)
            self.parts, self.held = [(found, sums)], len(found)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for codes, times in self.parts:
            for at in range(0, len(codes), 50_000):
                columns = {f.name: [None] for f in _STORED_ARROW}
                columns["codes"], columns["times"] = [codes[at : at + 50_000]], [times[at : at + 50_000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in _STORED_ARROW], schema=_STORED_ARROW
                )
        self.parts, self.held = [], 0


def _aligned_rows(name: str, sent):
    """Mapper of documents to their stored rows, followed by the task's sums, which have no row."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", name), lambda: Aligner(*sent.value))
        row = TaskContext.get().partitionId() << 40
        sums, merged = PairSums(), 0
        for ids, texts in _portions(batches):
            out = []
            for doc_id, found in zip(ids, aligner.documents(texts)):
                groups, packed, counts = found or (b"", b"", 0)
                links = np.frombuffer(packed, dtype=aligner.code_type)
                codes, times = np.unique(links, return_counts=True)
                sums.add(codes, times)
                digest = hashlib.sha256(groups).hexdigest() if found else ""
                n_a, n_b, n_groups = (counts >> k * SHIFT & (1 << SHIFT) - 1 for k in range(3))
                out.append((row, doc_id, n_a, n_b, n_groups, len(links), digest, codes, times))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), _STORED_ARROW)], schema=_STORED_ARROW
            )
            if sums.held > 2 * merged + HELD_PAIRS:
                sums.merge()
                merged = sums.held
                if merged > HELD_PAIRS:
                    yield from sums.rows()
                    merged = 0
        yield from sums.rows()

    return over


DIGEST = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
SUMS = ("n_best", "count_sum")


def _looked_up(name: str, sent, portion: int, portions: int):
    """Mapper of stored rows to their digest and its sums over the pairs of one portion."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = kept(("pairs", name), lambda: sent.value)
        for batch in batches:
            lists, times = batch.column("codes"), batch.column("times")
            here = np.asarray(lists.flatten())
            many = np.asarray(times.flatten())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            mine = np.flatnonzero(here % portions == portion)
            place = np.searchsorted(codes, here[mine])
            n_best, count_sum = (np.zeros(batch.num_rows, dtype=np.int64) for _ in SUMS)
            np.add.at(n_best, owner[mine], many[mine] * best[place])
            np.add.at(count_sum, owner[mine], many[mine] * counts[place])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in DIGEST), pa.array(n_best), pa.array(count_sum)],
                names=[*DIGEST, *SUMS],
            )

    return over


def aligned(
    docs: DataFrame,
    byte_level: str | None = None,
    pieces: str | None = None,
    max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """Digest of the alignment of every text of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    with open(byte_level or public_tokenizers.path(BYTE_LEVEL), encoding="utf-8") as file:
        left = file.read()
    with open(pieces or public_tokenizers.path(PIECES), "rb") as file:
        right = file.read()
    width = Aligner(left, right).width
    path = workspace(spark, "alignment")
    sent = spark.sparkContext.broadcast((left, right))
    (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_aligned_rows(path, sent), STORED)
        .withColumn("is_sum", F.col("row").isNull())
        .write.partitionBy("is_sum")
        .option("compression", "zstd")
        .parquet(f"{path}/aligned")
    )
    stored = spark.read.schema(STORED + ", is_sum boolean").parquet(f"{path}/aligned")
    sums = stored.where("is_sum").select(F.inline(F.arrays_zip("codes", "times")).alias("code", "n"))
    counted = sums.groupBy("code").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("code") % width))
    counted.select("code", "n", (F.col("n") == top).alias("best")).write.parquet(f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs")
    portions = max(1, -(-pairs.count() // max_pairs))
    rows = stored.where("not is_sum").drop("is_sum")
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'bigint'}" for c in DIGEST + SUMS)
    found = None
    for k in range(portions):
        mine = pairs.where(F.col("code") % portions == k).orderBy("code").toArrow()
        columns = tuple(np.asarray(mine.column(c).combine_chunks()) for c in ("code", "n"))
        best = mine.column("best").to_numpy()
        sent = spark.sparkContext.broadcast((*columns, best))
        summed = rows.mapInArrow(_looked_up(f"{path}/{k}", sent, k, portions), schema)
        found = summed if found is None else found.unionByName(summed)
    if portions > 1:
        found = found.groupBy(*DIGEST).agg(*(F.sum(c).alias(c) for c in SUMS))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *SUMS, "groups_sha256"
    )


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))

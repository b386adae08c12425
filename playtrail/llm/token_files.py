"""Token ids of a corpus in binary files: documents in ascending order of id, packed by Simple-8b.

The documents are placed by ranges of their ids, encoded, and written by Spark as Parquet rows, one
row per block: how many ids stand before it in its file, the documents that begin in it, how many
ids each has, and the packed 64-bit words, little-endian. A block holds whole documents, so it is
read and decoded without the others. Spark's writer puts a task's file in place only when the task
ends, so lost executors and repeated tasks leave no half file. Reading adds the ids of all earlier
files, one number per file.

Every distinct word between ASCII white space is encoded once per worker and looked up afterwards.
That gives the ids of the whole text for tokenizers that never look across white space, as the one
used here; the tests compare. A tokenizer that does, or that lacks the control token put between words,
is refused. Of a new word of plain letters, with signs behind them or not, the normalizer and the
pre-tokenizer of this file only make small letters and cut the signs off. So its letters are encoded
by the same model without these two steps, once for all words that share them. Texts of such letters
are lowered, and signs that stand alone cut off, before the words are looked up. A tokenizer with
other such steps encodes every word by them.

Defined results: a null or empty text has the end id only; documents of equal id follow each other
in the order of a hash of their text, repeated ones each with their own row; a null id comes first;
no documents give no blocks. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrail.llm.common import kept, table, workspace
from playtrail.llm.simple8b import pack, unpack

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 16
PORTION = 2_000_000  # bytes of text encoded at a time
MAX_WORDS = 1_000_000
END_WORD = b"\xff"  # no UTF-8 text holds this byte
BETWEEN = "<|endoftext|>"
PROBE = ("a", "Word", "12", "x,y")

# Letters of one code point that no normal form changes and whose lowering is one such letter, and
# signs that are cut off them. What follows are the steps of a tokenizer for which that holds.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
SIGNS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"  # those of them that are cut off by bytes

# What whole texts of ASCII and À to ÿ consist of, how each of their bytes is lowered (behind 0xC3
# stand only bytes from 0x80, and 0x97 and 0xB7 there are signs), and the kind of each byte: white
# space, part of a letter or digit, or a sign.
LATIN = bytes(range(0x80)) + b"\xc3" + bytes(range(0x80, 0xC0))
LOWERED = bytes(b + 32 if 0x80 <= b < 0x9F else b for b in bytes(range(256)).lower())
KINDS = bytes(
    ord(" ") if chr(b) in " \t\n\v\f\r" else ord("a") if b >= 0x80 or chr(b).isalnum() else ord("!")
    for b in range(256)
)
NORMALIZERS = (
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
)
LETTER_RUNS = {
    "type": "Split",
    "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    },
    "behavior": "Removed",
    "invert": True,
}
BY_BYTE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}

BLOCK = (
    "part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, "
    "lengths array<bigint>, words binary"
)


def _slices(values: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Stretches of the values, one after the other."""
    reach = np.cumsum(widths, dtype=np.int64)
    total = int(reach[-1]) if len(reach) else 0
    return values[np.arange(total) + np.repeat(starts - (reach - widths), widths)]


def _latin(text: bytes) -> bool:
    """Whether a text is valid and holds ASCII and the letters from À to ÿ only."""
    if text.translate(None, LATIN) or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return False
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


class PlainWords:
    """Encodes words of plain small letters with the model of a tokenizer. They are told apart by
    the pieces that end a word."""

    def __init__(self, tokenizer, suffix: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer(tokenizer.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all words one after the other, and how many each has; nothing if a word has no
        piece at its end."""
        found, ends = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for some in (words[a : a + 4096] for a in range(0, len(words), 4096)):
            text = " ".join(some)
            coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(coded, dtype=np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some):
                return None
            found.append(ids)
            ends.append(np.diff(last, prepend=-1))
        return np.concatenate(found), np.concatenate(ends)


def plain_words(tokenizer, source: str) -> PlainWords | None:
    """What encodes plain words, if the tokenizer's steps are known to leave them as they are."""
    spec = json.loads(source)
    normal, cut, model = spec.get("normalizer"), spec.get("pre_tokenizer"), spec["model"]
    suffix = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not suffix or model.get("dropout"):
        return None
    steps = (normal or {}).get("normalizers", [normal] if normal else [])
    runs, *rest = (cut or {}).get("pretokenizers") or [None]
    by_byte = [{k: v for k, v in step.items() if k != "trim_offsets"} for step in rest] == [BY_BYTE]
    if any(step not in NORMALIZERS for step in steps) or runs != LETTER_RUNS or not by_byte:
        return None
    # Control tokens are found before all else, and plain words must not hold one.
    if not all("<" in token["content"] for token in spec["added_tokens"]):
        return None
    return PlainWords(tokenizer, suffix)


class WordIds(dict):
    """Number of each word, and its ids by that number. A word gets its number when it is first
    asked for; the ids of all new words of a portion are then encoded together, with a control
    token of the tokenizer between them where it is needed. Word 0 is the end of a document."""

    def __init__(self, source: str, end_id: int, between: str = BETWEEN):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(source)
        self.between, self.between_id = between, self.tokenizer.token_to_id(between)
        # Plain letters may be lowered before they are looked up where the tokenizer lowers them.
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("Az") == "az"
        apart = [self._encoded(word) for word in PROBE]
        if self.between_id is None or self._encoded(" ".join(PROBE)) != sum(apart, []):
            raise ValueError("words cannot be encoded one by one with this tokenizer")
        self.plain = plain_words(self.tokenizer, source)
        self[END_WORD] = 0
        self.ids, self.first = array("i", [end_id]), array("i", [0, 1])
        self.fresh: list[bytes] = []
        self.used = np.zeros(1, dtype=np.int32)  # portions in which each word was met

    def _encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def make_room(self, most: int) -> None:
        """Forget the rare words: those met in one portion only, then in two, four and so on, until
        `most` are left. No id depends on what is kept."""
        least = 2
        while (self.used >= least).sum() > most:
            least *= 2
        stays = self.used >= least
        stays[0] = True
        number = np.cumsum(stays) - 1
        first, ids = np.frombuffer(self.first, dtype="i4"), np.frombuffer(self.ids, dtype="i4")
        widths = np.diff(first)
        kept = ids[np.repeat(stays, widths)]
        ends = np.append(0, np.cumsum(widths[stays]))
        words = {w: int(number[n]) for w, n in self.items() if stays[n]}
        self.ids, self.first = (array("i", x.astype("i4").tobytes()) for x in (kept, ends))
        self.used = self.used[stays] // 2
        self.clear()
        self.update(words)

    def _count(self, numbers: np.ndarray) -> None:
        more = np.zeros(len(self.first) - 1 - len(self.used), dtype=np.int32)
        self.used = np.concatenate([self.used, more])
        seen = np.zeros(len(self.used), dtype=bool)
        seen[numbers] = True
        self.used += seen

    def _plain(self, text: bytes | None) -> bytes:
        """The text, lowered as a whole where that is what becomes of each of its words. If the
        tokenizer's steps are known, commas and full stops behind letters become words of their own,
        as they are tokens of their own: so a word has one number, whatever follows it."""
        text = text or b""
        if b"<" in text:
            return text
        if text.isascii():
            text = text.lower() if self.lowers else text
        elif self.plain and _latin(text):
            text = text.translate(LOWERED) if self.lowers else text
        else:
            return text
        # Signs beside each other are one token: they must stay together.
        if self.plain and b"!! " not in text.translate(KINDS):
            text = text.replace(b", ", b" , ").replace(b". ", b" . ")
        return text

    def __missing__(self, word: bytes) -> int:
        # Control tokens keep their letters.
        small = word.lower() if self.lowers and word.isascii() and b"<" not in word else word
        if small != word:
            number = self[word] = self[small]
            return number
        number = self[word] = len(self.first) - 1 + len(self.fresh)
        self.fresh.append(word)
        return number

    def _learn(self) -> None:
        """Encode the new words and append their ids. What a plain word consists of is taken from
        known words, or encoded once for all new words that have it."""
        words, self.fresh = self.fresh, []
        known = len(self.first) - 1
        stems: dict[str, int] = {}
        others: dict[str, int] = {}
        # What a word consists of: known words, then stems; others from -2 downwards, -1 is nothing.
        heads, tails = [], []
        for word in words:
            stem = word.rstrip(SIGNS)
            if self.plain and stem.isalpha():  # ASCII letters only
                signs = word[len(stem) :]
            else:
                text = word.decode("utf-8", "replace")
                cut = self.plain and PLAIN.fullmatch(text)
                if not cut:
                    heads.append(-2 - others.setdefault(text, len(others)))
                    tails.append(-1)
                    continue
                stem, signs = (x.encode() for x in cut.groups())
            if self.lowers:
                stem = stem.lower() if stem.isascii() else stem.decode().lower().encode()
            number = self.get(stem, known)
            if number >= known:
                number = known + stems.setdefault(stem.decode(), len(stems))
            heads.append(number)
            number = self.get(signs, known) if signs else -1
            if number >= known:
                number = -2 - others.setdefault(signs.decode(), len(others))
            tails.append(number)
        parts = np.column_stack([np.array(x, dtype=np.int64) for x in (heads, tails)]).ravel()
        plain = self.plain.encode(list(stems)) if stems else None
        coded = [plain or self._by_steps(list(stems)), self._by_steps(list(others))]
        first, old = np.frombuffer(self.first, dtype="i4"), np.frombuffer(self.ids, dtype="i4")
        # The ids of the known words in question, then those that are new, then those of nothing.
        mine = np.flatnonzero((parts >= 0) & (parts < known))
        at = parts[mine]
        parts = np.where(parts < -1, known + len(stems) - 2 - parts, parts)
        parts = np.where(parts < known, -1, parts - known + len(mine))
        parts[mine] = np.arange(len(mine))
        ids = [_slices(old, first[at], first[at + 1] - first[at]), *(found for found, _ in coded)]
        widths = np.concatenate([first[at + 1] - first[at], *(many for _, many in coded), [0]])
        starts = np.cumsum(widths) - widths
        del first, old  # arrays cannot grow while they are looked into
        many = widths[parts].reshape(-1, 2).sum(axis=1)
        self.first.frombytes((len(self.ids) + np.cumsum(many)).astype("i4").tobytes())
        self.ids.frombytes(_slices(np.concatenate(ids), starts[parts], widths[parts]).tobytes())

    def _by_steps(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words by every step of the tokenizer, and how many each has."""
        found, widths = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for some in (words[a : a + 512] for a in range(0, len(words), 512)):
            # A word that holds a control token itself is encoded by itself.
            groups = [some] if self.between not in "".join(some) else [[w] for w in some]
            for group in groups:
                text = self.between.join(group)
                coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                coded = np.array(coded, dtype=np.int32)
                if len(group) == 1:
                    found.append(coded)
                    widths.append(np.array([len(coded)]))
                    continue
                cuts = np.flatnonzero(coded == self.between_id)
                found.append(np.delete(coded, cuts))
                widths.append(np.diff(np.append(cuts, len(coded)), prepend=-1) - 1)
        return np.concatenate(found), np.concatenate(widths)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each has."""
        if len(self) > MAX_WORDS:
            self.make_room(MAX_WORDS // 2)
        words = b"".join(self._plain(text) + b" " + END_WORD + b" " for text in texts).split()
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn()
        self._count(numbers)
        first, ids = np.frombuffer(self.first, dtype="i4"), np.frombuffer(self.ids, dtype="i4")
        starts = first[numbers]
        widths = first[numbers + 1] - starts
        reach = np.cumsum(widths, dtype=np.int64)
        return _slices(ids, starts, widths), np.diff(reach[numbers == 0], prepend=0)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            ids.append(i.as_py())
            texts.append(text)
            held += len(text or b"") + 16
            if held >= PORTION:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _block(part: int, number: int, before: int, docs: list, ids: np.ndarray, lengths: list):
    rows = [[part], [number], [before], [len(ids)], [docs], [lengths]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    kinds += [pa.list_(pa.int64())]
    words = pa.array([pack(ids).astype("<u8").tobytes()], pa.binary())
    names = [field.split()[0] for field in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(r, k) for r, k in zip(rows, kinds)), words], names=names
    )


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID
) -> None:
    """Write the ids of `doc_id` and `text` to the shared folder `path`."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("word ids", hash(sent.value), end_id)
        encoder = kept(key, lambda: WordIds(sent.value, end_id))
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for doc_ids, texts in _portions(batches):
            ids, lengths = encoder.encode(texts)
            ends = np.cumsum(lengths)
            # A document begins a new block where the one before has filled one.
            group = (ends - lengths) // BLOCK_IDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                low, high = int(ends[a] - lengths[a]), int(ends[b - 1])
                yield _block(
                    part, number, before, doc_ids[a:b], ids[low:high], lengths[a:b].tolist()
                )
                number, before = number + 1, before + high - low

    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    ordered = placed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    packed = ordered.select("doc_id", "text").mapInArrow(blocks, BLOCK)
    packed.write.option("compression", "zstd").parquet(path)


DECODED = "doc_id bigint, start bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint"


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: `doc_id`, `start` (ids of all documents before it), `n_tokens`,
    `ids` unless left out, and `ids_crc32` of the ids as little-endian 32-bit integers."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("part_start")
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids = unpack(np.frombuffer(at["words"], dtype="<u8"), at["n_ids"])
                ids = ids.astype("<u4")
                ends = np.cumsum([0, *at["lengths"]])
                pieces = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
                shown = ids.astype(np.int32) if with_ids else np.zeros(0, dtype=np.int32)
                offsets = ends if with_ids else np.zeros(len(ends))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at["doc_ids"], pa.int64()),
                        pa.array(ends[:-1] + at["start"], pa.int64()),
                        pa.array(at["lengths"], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shown)),
                        pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                    ],
                    names=[field.split()[0] for field in DECODED.split(", ")],
                )

    # One row per file, so the broadcast side is as small as the list of files.
    placed = blocks.join(F.broadcast(starts), "part").select(
        (F.col("part_start") + F.col("before")).alias("start"),
        "n_ids",
        "doc_ids",
        "lengths",
        "words",
    )
    found = placed.mapInArrow(documents, DECODED)
    return found if with_ids else found.drop("ids")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    path = workspace(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_token_files(spark, path, with_ids=False)

"""Language identification: known words first, shorter and shorter character n-grams for the rest.

Every language has the relative frequencies of its words and of the character n-grams of their
occurrences, the ends of a word being characters too. A word that is known in any language scores
-log10 of its frequency in each of them, and a fixed penalty in the others. A word that is known in
none is cut into n-grams of the greatest length; if any of them is known, the word scores their
mean, else the next shorter ones are tried. A text gets the language of the lowest sum.

Words and n-grams are counted over all texts to learn from: each task sums its own, the sums are
added by (language, word), and the n-grams are counted from the distinct words and their numbers.
The model takes the most frequent ones of each language, as many as `max_words` and, for each length,
`max_grams` allow over all languages; where several are equally frequent at the border, none of them
enters. The border comes from a table of how many words have which count, so nothing is sorted or
collected but the model itself, whose size these two parameters bound. Words met in texts are kept
scored from text to text, which changes no result.

A word is a letter and the letters and combining marks after it, lower-cased; runs of letters of
scripts without spaces are one word and mostly scored by their n-grams. The score is the share of
the language among all, each weighing 10^(-sum / square root of the number of words).

Defined results: a null text and one without a letter are `und` with score 0, and so is any text
where there is nothing to learn from; equal sums go to the language whose name comes first; a null
language is not learned, an empty one is a language like others; repeated rows count again in
learning and get equal results; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrail.llm.common import HELD_OUT, fold, kept, table, workspace
from playtrail.llm.tally import LIMIT, Recent, counted_batches, tallies

UNKNOWN = "und"
LONGEST_GRAM = 5
EDGE = " "
MAX_WORDS = 400_000
MAX_GRAMS = 100_000
STEPS = 1_000_000
PORTION = 500_000  # bytes of text scored at a time
KEPT_WORDS = 150_000  # in each of two generations
MAX_KEPT_WORD = 64  # characters of a word that is kept scored
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: bytes | None) -> list[str]:
    return WORD.findall((text or b"").decode("utf-8", "replace").lower())


def grams(word: str, length: int) -> list[str]:
    marked = f"{EDGE}{word}{EDGE}"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (
        (lang, words(text))
        for batch in batches
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
    )
    yield from counted_batches(tallies(rows, LIMIT), "lang", "item", pa.string())


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of all lengths; the length is that of the item."""
    held: dict[str, Counter] = {}
    entries = 0
    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n"))):
            counter = held.setdefault(lang, Counter())
            before = len(counter)
            for length in range(1, LONGEST_GRAM + 1):
                for gram in grams(word, length):
                    counter[gram] += n
            entries += len(counter) - before
            if entries > LIMIT:
                yield from counted_batches(held.items(), "lang", "item", pa.string())
                held, entries = {}, 0
    yield from counted_batches(held.items(), "lang", "item", pa.string())


COUNTED = "lang string, item string, n bigint"


def _most_frequent(counted: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows of at most `most` items of each group, the most frequent ones, without a border of
    equally frequent ones that would not fit whole; with the group's total."""
    heights = counted.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("items"))
    down = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    reach = heights.withColumn("reach", F.sum("items").over(down))
    border = reach.groupBy(*by).agg(
        F.min(F.when(F.col("reach") <= most, F.col("n"))).alias("least"),
        F.sum(F.col("n") * F.col("items")).alias("total"),
    )
    return counted.join(border, by).where(F.col("n") >= F.col("least")).drop("least")


@dataclass
class Frequencies:
    """Items of one kind. Item i has the entries first[i] to first[i + 1]: languages, and how far
    their scores lie below the penalty."""

    items: list[str]
    first: np.ndarray
    langs: np.ndarray
    below: np.ndarray


@dataclass
class LanguageModel:
    names: list[str]
    words: Frequencies
    grams: Frequencies

    def scorer(self) -> Scorer:
        return Scorer(self)


def _frequencies(rows: pa.Table, number: dict[str, int], penalty: float) -> Frequencies:
    items = rows.column("item").to_pylist()
    langs = np.array([number[x] for x in rows.column("lang").to_pylist()], dtype=np.int32)
    share = np.array(rows.column("n"), dtype=float) / np.array(rows.column("total"), dtype=float)
    order = sorted(range(len(items)), key=items.__getitem__)
    names, first = [], [0]
    for at, i in enumerate(order):
        if not names or items[i] != names[-1]:
            names.append(items[i])
            first.append(at)
        first[-1] = at + 1
    return Frequencies(
        names, np.array(first), langs[order], -np.log10(share[order]) - penalty
    )


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.word_at = {w: i for i, w in enumerate(model.words.items)}
        self.gram_at = {g: i for i, g in enumerate(model.grams.items)}
        self.known = Recent(self._packed, KEPT_WORDS)

    def _spread(self, found: Frequencies, places: list[int], owners: list[int], n: int) -> np.ndarray:
        """Sums over the entries of the items at `places` for each of n owners and each language."""
        at, owner = np.array(places, dtype=np.int64), np.array(owners, dtype=np.int64)
        start, width = found.first[at], found.first[at + 1] - found.first[at]
        entry = np.arange(int(width.sum())) + np.repeat(start - np.cumsum(width) + width, width)
        cell = np.repeat(owner, width) * len(self.model.names) + found.langs[entry]
        sums = np.bincount(cell, found.below[entry], n * len(self.model.names))
        return sums.reshape(n, len(self.model.names))

    def vectors(self, some: list[str]) -> np.ndarray:
        """How far each word's score in each language lies below the penalty, in steps of 1 / STEPS:
        whole numbers add up to the same in any order."""
        known, known_owner, parts, part_owner = [], [], [], []
        many = np.ones(len(some))
        for owner, word in enumerate(some):
            at = self.word_at.get(word)
            if at is not None:
                known.append(at)
                known_owner.append(owner)
                continue
            for length in range(LONGEST_GRAM, 0, -1):
                places = [i for g in grams(word, length) if (i := self.gram_at.get(g)) is not None]
                if places:
                    parts += places
                    part_owner += [owner] * len(places)
                    many[owner] = len(places)
                    break
        by_word = self._spread(self.model.words, known, known_owner, len(some))
        by_grams = self._spread(self.model.grams, parts, part_owner, len(some)) / many[:, None]
        return np.rint((by_word + by_grams) * STEPS).astype(np.int64)

    def _packed(self, some: list[str]) -> list[bytes]:
        return [row.tobytes() for row in self.vectors(some)]

    def score(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        split = [words(t) for t in texts]
        every = set().union(*split)
        if not self.model.names or not every:
            return [(UNKNOWN, 0.0)] * len(texts)
        long = [w for w in every if len(w) > MAX_KEPT_WORD]
        every.difference_update(long)
        known = self.known.resolve(every)
        known.update(zip(long, self._packed(long)))
        number = {w: i for i, w in enumerate(known)}
        vectors = np.frombuffer(b"".join(known.values()), dtype=np.int64)
        vectors = vectors.reshape(len(number), len(self.model.names))
        out = []
        for own in split:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
            sums = vectors[at].sum(axis=0)
            best = int(np.argmin(sums))
            weights = 10.0 ** ((sums[best] - sums) / STEPS / np.sqrt(len(own)))
            out.append((self.model.names[best], float(1 / weights.sum())))
        return out


def fit_languages(
    docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS
) -> LanguageModel:
    """Model of all rows of `docs` (lang, text) with a language. `max_words` bounds the words of all
    languages together, `max_grams` the n-grams of one length."""
    spark = docs.sparkSession
    path = workspace(spark, "language")
    texts = docs.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")
    )
    partial = texts.mapInArrow(_count_words, COUNTED)
    partial.groupBy("lang", "item").agg(F.sum("n").alias("n")).write.parquet(f"{path}/words")
    counted = spark.read.parquet(f"{path}/words")
    partial = counted.mapInArrow(_count_grams, COUNTED)
    partial.groupBy("lang", "item").agg(F.sum("n").alias("n")).write.parquet(f"{path}/grams")
    gram_rows = spark.read.parquet(f"{path}/grams").withColumn("length", F.length("item"))
    totals = dict(counted.groupBy("lang").agg(F.sum("n")).collect())
    names = sorted(totals, key=lambda name: name.encode())
    number = {name: i for i, name in enumerate(names)}
    share = max(1, len(names))
    penalty = 2 + float(np.log10(max(totals.values(), default=1)))
    some = _most_frequent(counted, ["lang"], max_words // share).toArrow()
    parts = _most_frequent(gram_rows, ["lang", "length"], max_grams // share).toArrow()
    return LanguageModel(
        names, _frequencies(some, number, penalty), _frequencies(parts, number, penalty)
    )


def language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("language", name), lambda: sent.value.scorer())
        for ids, texts in _portions(batches):
            pred, score = zip(*scorer.score(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    return texts.mapInArrow(over, "doc_id bigint, lang_pred string, score double")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += len(texts[-1] or b"")
            if held > PORTION:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def op11_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(fold(F.col("doc_id")) != HELD_OUT))
    found = language(docs, model)
    return found.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )

"""Quality classifier by compression: which of two dictionaries suits a text better.

One zstandard dictionary is built from good labelled texts and one from bad ones, of the same size
and from the same number of texts. A text is cut into blocks, so that the dictionary and not the
text's own beginning decides, and every block is compressed with both. The difference of the two
sizes over the whole text, as a share of the text's size and of both compressed sizes, becomes a
probability by a logistic curve fitted on labelled texts that went into neither dictionary.

Defined results: a null or empty text has no difference and gets the curve's value at 0; repeated
rows each get their own score; an empty table gives no rows; without labelled rows of both classes
every score is 0.5. Other columns are not read; equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import (
    HELD_OUT,
    fold,
    labelled_sample,
    logistic,
    table,
    text_udf,
)

BLOCK = 512
DICTIONARY = 112 * 1024
LEVEL = 3
THRESHOLD = 0.5


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def build_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """Content of a dictionary from the texts' blocks. Where there are too few for training, the
    texts' ends themselves serve."""
    blocks = [b for text in texts for b in _blocks(text)]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


@dataclass(frozen=True)
class CompressionModel:
    """`good` and `bad` are dictionary contents of bounded size; `weights` the fitted curve."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def differences(self):
        """Function from a text to its size difference as a share of its size and of both
        compressed sizes: above 0, the good one suits it."""
        sides = []
        for content in (self.bad, self.good):
            known = zstandard.ZstdCompressionDict(content) if content else None
            if known is not None:
                known.precompute_compress(level=LEVEL)
                sides.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False))
            else:
                sides.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        bad, good = sides

        def difference(text: bytes | None) -> tuple[float, float]:
            if not text:
                return 0.0, 0.0
            blocks = _blocks(text)
            with_bad = sum(len(bad.compress(b)) for b in blocks)
            with_good = sum(len(good.compress(b)) for b in blocks)
            more = with_bad - with_good
            return more / len(text), more / (with_bad + with_good)

        return difference

    def scorer(self):
        difference = self.differences()
        constant, *slopes = self.weights

        def score(text: bytes | None) -> tuple[float, int]:
            logit = constant + sum(w * d for w, d in zip(slopes, difference(text)))
            p = float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            return p, int(p >= THRESHOLD)

        return score


def fit_compression(
    docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000
) -> CompressionModel:
    """Dictionaries and curve from at most `rows_per_class` labelled rows of each class."""
    sample = labelled_sample(docs, labels, "quality", rows_per_class)
    return learn_compression([(text, label) for _, text, label in sample])


def learn_compression(sample: list[tuple[bytes, int]]) -> CompressionModel:
    by_class = [[t for t, label in sample if label == k and t] for k in (0, 1)]
    if not all(by_class):
        return CompressionModel(b"", b"", (0.0, 0.0, 0.0))
    least = min(map(len, by_class))
    first = [[t for i, t in enumerate(texts[:least]) if i % 3] for texts in by_class]
    # Not enough to set rows apart: the same rows serve twice.
    first = first if all(first) else by_class
    bad, good = (build_dictionary(texts) for texts in first)
    used = {id(t) for texts in first for t in texts}
    fresh = [(t, label) for t, label in sample if id(t) not in used and t]
    if len({label for _, label in fresh}) < 2:
        fresh = [(t, label) for t, label in sample if t]
    difference = CompressionModel(good, bad, (0.0, 0.0, 0.0)).differences()
    weights = logistic([difference(t) for t, _ in fresh], [label for _, label in fresh])
    return CompressionModel(good, bad, tuple(map(float, weights)))


def quality_score(text: Column, model: CompressionModel) -> Column:
    """Struct of `score` (0 to 1, higher: rather good) and `predicted`."""
    return text_udf(model.scorer, "score double, predicted int")(text)


def op10_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_compression(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_score(F.col("text"), model).alias("q"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "q.score",
        "q.predicted",
    )

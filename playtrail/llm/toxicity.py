"""Toxicity by two Kneser-Ney word models, one of toxic and one of ordinary labelled texts.

Both are interpolated bigram models with the three discounts of modified Kneser-Ney smoothing, each
estimated from the counts of counts of its class and order. A bigram backs off to the class's own
unigrams, and those to one distribution shared by both classes: in how many different contexts a
word was seen in either. So an expression that one class has not shown is judged by common counts
and not by chance. Every word and bigram of the training texts is kept, however rare: what its counts
say about the classes is shrunk towards the backoff, the more so the fewer they are and the more
likely both classes have it alike. A word of no training text is no evidence.

A text's evidence is the difference of the two log-likelihoods divided by the number of words: the
highest of all stretches of `SPAN` words, so long texts are judged by their worst passage and not
diluted. A logistic curve, fitted on labelled texts outside the models, turns it and the logarithm
of the text's length (the highest of many is higher) into a probability.

Defined results: a null, empty or wordless text has no evidence and gets the curve's value at 0;
repeated rows each get their own score; an empty table gives no rows; without labelled rows of both
classes every score is 0.5. Other columns are not read; equal texts have equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
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

THRESHOLD = 0.7
SPAN = 4  # words of a stretch; shorter texts are divided by this many as well
WORD_TEXTS, PAIR_TEXTS = 20.0, 100.0  # texts that the backoff of a word or bigram stands for
SHARED_WEIGHT = 50.0  # words of the backoff that every context counts besides its own
UNKNOWN, BEGIN = 0, 1

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode("utf-8", "replace").lower())


@dataclass(frozen=True)
class ToxicityModel:
    """Log-likelihood ratios: of seen bigrams by `keys` (context * size + word), of words, and of
    the backoff weight of each context."""

    vocabulary: dict[str, int]
    keys: np.ndarray
    ratios: np.ndarray
    word_ratios: np.ndarray
    weights: tuple[float, float, float]

    def evidence(self, text: bytes | None) -> tuple[float, float]:
        get = self.vocabulary.get
        ids = np.array([BEGIN, *(get(w, UNKNOWN) for w in words_of(text))], dtype=np.int64)
        n = len(ids) - 1
        if not n or not len(self.keys):
            return 0.0, 0.0
        before, word = ids[:-1], ids[1:]
        wanted = before * len(self.word_ratios) + word
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        each = np.where(
            self.keys[at] == wanted,
            self.ratios[at],
            self.word_ratios[word],
        )
        sums = np.concatenate([[0.0], np.cumsum(each)])
        span = min(SPAN, n)
        worst = (sums[span:] - sums[:-span]).max() / SPAN
        return float(worst), float(np.log(n))

    def scorer(self):
        constant, by_worst, by_length = self.weights

        def score(text: bytes | None) -> tuple[float, int]:
            worst, length = self.evidence(text)
            logit = np.clip(constant + by_worst * worst + by_length * length, -30, 30)
            p = float(1 / (1 + np.exp(-logit)))
            return p, int(p >= THRESHOLD)

        return score


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from each count: one estimate for 1, 2 and more, from how many there are of
    1 to 4. Where those are too few, 0.75 of a count."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        by_count = np.array([0.0, 0.75, 0.75, 0.75])
    else:
        y = n1 / (n1 + 2 * n2)
        ratios = (n2 / n1, n3 / n2, n4 / max(n3, 1.0))
        by_count = np.array([0.0, *((k - (k + 1) * y * r) for k, r in enumerate(ratios, 1))])
        by_count[1:] = np.clip(by_count[1:], 0.5, [1.0, 2.0, 3.0])
    return by_count[np.minimum(counts, 3).astype(int)]


def differing(toxic: np.ndarray, ordinary: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Of each pair of counts the probability that the classes differ: the counts are a draw at the
    expected log-odds `odds`, or at any others alike. How many differ is estimated from all."""
    n = (toxic + ordinary).astype(np.int64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n.max(initial=0) + 1)))])
    ways = logs[n] - logs[toxic.astype(np.int64)] - logs[ordinary.astype(np.int64)]
    expected = ways - toxic * np.logaddexp(0, -odds) - ordinary * np.logaddexp(0, odds)
    gain = np.exp(np.clip(-np.log(n + 1.0) - expected, -50, 50))
    seen, share = gain[n > 0], 0.01
    for _ in range(20 if len(seen) else 0):
        share = np.clip((share * seen / (share * seen + 1 - share)).mean(), 1e-6, 0.5)
    return share * gain / (share * gain + 1 - share)


def learn_models(texts: list[list[list[str]]]) -> ToxicityModel:
    """Models of ordinary (0) and toxic (1) texts given as lists of words; no curve yet."""
    seen_words = sorted({w for side in texts for words in side for w in words})
    vocabulary = {w: i + 2 for i, w in enumerate(seen_words)}
    size = len(vocabulary) + 2
    seen = []
    for side in texts:
        pairs = [np.zeros(0, dtype=np.int64)]
        for words in side:
            ids = np.array([BEGIN, *(vocabulary.get(w, UNKNOWN) for w in words)], dtype=np.int64)
            pairs.append(np.unique(ids[:-1] * size + ids[1:]))
        seen.append(np.unique(np.concatenate(pairs), return_counts=True))
    keys = np.union1d(seen[0][0], seen[1][0])
    context, word = keys // size, keys % size
    contexts_of = np.bincount(word, minlength=size) + 1e-3  # a word never seen keeps some mass
    shared = contexts_of / contexts_of.sum()
    counted = np.zeros((2, len(keys)))
    for side, (own_keys, own_counts) in enumerate(seen):
        counted[side, np.searchsorted(keys, own_keys)] = own_counts
    pooled = counted.sum(axis=0)
    held = np.bincount(context, pooled, minlength=size) + SHARED_WEIGHT
    backoff = 1 - np.bincount(context, pooled - discounts(pooled), minlength=size) / held
    of_words, of_pairs, of_contexts, singles = [], [], [], []
    for counts in counted:
        single = np.bincount(word, counts, minlength=size)
        unigram = (single - discounts(single)) / max(single.sum(), 1.0)
        unigram = unigram + (1 - unigram.sum()) * shared
        of_contexts.append(np.bincount(context, counts, minlength=size))
        direct = (counts - discounts(counts)) / (of_contexts[-1] + SHARED_WEIGHT)[context]
        of_pairs.append(np.log(direct + backoff[context] * unigram[word]))
        of_words.append(np.log(unigram))
        singles.append(single)
    raw = of_words[1] - of_words[0]
    in_texts = singles[0] + singles[1]
    odds = np.log(max(singles[1].sum(), 1.0) / max(singles[0].sum(), 1.0))
    words_ = differing(singles[1], singles[0], np.full(size, odds)) * raw
    words_ *= in_texts / (in_texts + WORD_TEXTS)
    words_[UNKNOWN] = 0.0
    # Expected of a bigram is what its context's totals and its word say.
    odds = np.log((of_contexts[1] + 0.5) / (of_contexts[0] + 0.5))[context] + words_[word]
    own = differing(counted[1], counted[0], odds) * pooled / (pooled + PAIR_TEXTS)
    ratios = words_[word] + own * (of_pairs[1] - of_pairs[0] - raw[word])
    return ToxicityModel(
        vocabulary, keys, ratios.astype(np.float32), words_.astype(np.float32), (0.0, 0.0, 0.0)
    )


def learn_toxicity(sample: list[tuple[bytes, int]]) -> ToxicityModel:
    """Models on two thirds of the labelled texts, the curve on the rest."""
    if len({label for _, label in sample}) < 2:
        return learn_models([[], []])
    sides: list[list[tuple[bytes, int]]] = [[], []]
    for k in (0, 1):
        texts = dict.fromkeys(t for t, label in sample if label == k)
        for i, text in enumerate(texts):
            sides[int(i % 3 == 2)].append((text, k))
    train, fresh = sides
    if len({label for _, label in fresh}) < 2:
        fresh = train
    model = learn_models([[words_of(t) for t, label in train if label == k] for k in (0, 1)])
    weights = logistic([model.evidence(t) for t, _ in fresh], [label for _, label in fresh])
    return ToxicityModel(
        model.vocabulary,
        model.keys,
        model.ratios,
        model.word_ratios,
        tuple(map(float, weights)),
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000) -> ToxicityModel:
    """Models and curve from at most `rows_per_class` labelled rows of each class."""
    sample = labelled_sample(docs, labels, "toxic", rows_per_class)
    return learn_toxicity([(text, label) for _, text, label in sample])


def toxicity_score(docs: DataFrame, text: Column, model: ToxicityModel) -> Column:
    """Struct of `score` (0 to 1, higher: rather toxic) and `predicted`. The model is bounded by its
    training sample and sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return text_udf(lambda: sent.value.scorer(), "score double, predicted int")(text)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity_score(docs, F.col("text"), model).alias("t"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "t.score",
        "t.predicted",
    )

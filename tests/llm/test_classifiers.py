"""Toxicity by Kneser-Ney models, quality by compression."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.llm import compression as C
from playtrail.llm import toxicity as X
from playtrail.llm.common import HELD_OUT, fold, labelled_sample, logistic, table

SF = "/root/testdata/sf0.01"
SYLLABLES = [a + b for a in "bdklmnprst" for b in "aeiou"]


def words(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n)]


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        said = words(rng, rng.randrange(20, 200))
        if k % 4 == 0:
            for _ in range(1 + len(said) // 40):
                said.insert(rng.randrange(len(said)), rng.choice(["vile", "you fool", "Scum!"]))
        rows.append((" ".join(said).encode(), int(k % 4 == 0)))
    return rows


def test_toxicity_finds_planted_words():
    model = X.learn_toxicity(toxic_corpus(1, 1200))
    score = model.scorer()
    said = [(score(t)[1], label) for t, label in toxic_corpus(2, 400)]
    assert np.mean([p for p, label in said if label]) > 0.9
    assert np.mean([p for p, label in said if not label]) < 0.02
    long = b" ".join(t for t, label in toxic_corpus(3, 300) if not label)
    assert score(long)[1] == 0 and score(long + b" vile scum you fool " + long)[1] == 1


def test_rare_toxic_words_are_evidence():
    rows, rng = toxic_corpus(5, 8000), random.Random(6)

    def planted(expression):
        said = words(rng, rng.randrange(20, 60))
        said.insert(rng.randrange(len(said)), expression)
        return " ".join(said).encode()

    # In 10 of some 1340 toxic training texts, and 3 of 4000 ordinary ones.
    rows += [(planted("zug wortig blaf"), 1) for _ in range(15)]
    rows += [(planted("harm loseful phrase"), 0) for _ in range(5)]
    score = X.learn_toxicity(rows).scorer()
    found = [score(planted("zug wortig blaf"))[1] for _ in range(100)]
    assert np.mean(found) > 0.9
    others = [score(planted(e))[1] for e in ("harm loseful phrase", "never seen") for _ in range(50)]
    assert np.mean(others) < 0.02


def test_toxicity_edges():
    model = X.learn_toxicity(toxic_corpus(1, 200))
    score = model.scorer()
    assert score(None) == score(b"") == score(b" 1 2 ")
    assert 0 <= score(b"\xff\xfe")[0] <= 1
    for sample in ([], [(b"a b", 1)], [(b"a b", 0)] * 3):
        assert X.learn_toxicity(sample).scorer()(b"a b")[0] == 0.5


def test_discounts_come_from_counts_of_counts():
    counts = np.array([1] * 100 + [2] * 40 + [3] * 20 + [4] * 12 + [9, 0])
    y = 100 / 180
    taken = X.discounts(counts)
    assert taken[0] == pytest.approx(1 - 2 * y * 0.4)
    assert taken[100] == pytest.approx(2 - 3 * y * 0.5)
    assert taken[140] == taken[-2] == pytest.approx(3 - 4 * y * 0.6) and taken[-1] == 0


def test_compression_tells_styles_apart():
    rng = random.Random(4)

    def text(good):
        said = words(rng, rng.randrange(30, 300))
        return (" ".join(w if good else w.upper() + "!!" for w in said)).encode()

    model = C.learn_compression([(text(k % 3 > 0), int(k % 3 > 0)) for k in range(600)])
    score = model.scorer()
    assert np.mean([score(text(True))[1] for _ in range(60)]) > 0.95
    assert np.mean([score(text(False))[1] for _ in range(60)]) < 0.05
    assert 0 <= score(b"")[0] <= 1 and score(None) == score(b"")
    assert C.learn_compression([(b"x", 1)]).scorer()(b"y")[0] == 0.5
    assert C.learn_compression([(b"x", 1), (b"z", 0)]).scorer()(b"y")[0] >= 0


def test_whole_text_counts():
    model = C.learn_compression(
        [(b"good words here " * 40, 1), (b"BAD!! THINGS!! " * 40, 0)] * 20
    )
    difference = model.differences()
    assert difference(b"good words here " * 2000) != difference(
        b"good words here " * 2000 + b"BAD!! THINGS!! " * 2000
    )


def test_logistic_of_separable_rows_is_finite():
    weights = logistic([[-1.0], [1.0]] * 20, [0, 1] * 20)
    assert np.isfinite(weights).all() and weights[1] > 0


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    drawn = labelled_sample(docs, labels, "quality", 20)
    assert len(drawn) == 40 and sorted({label for *_, label in drawn}) == [0, 1]
    ids = spark.createDataFrame([(i,) for i, *_ in drawn], "doc_id bigint")
    assert ids.where(fold(F.col("doc_id")) == HELD_OUT).count() == 0
    assert drawn == labelled_sample(docs.repartition(7), labels.repartition(3), "quality", 20)


@pytest.mark.parametrize("which", ["toxicity", "compression"])
def test_columns_nulls_and_empty_tables(spark, documents, which):
    docs = documents([(1, None), (1, None), (None, ""), (2, "abc " * 30_000), (3, "x")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    if which == "toxicity":
        column = X.toxicity_score(docs, F.col("text"), X.fit_toxicity(docs, none))
    else:
        column = C.quality_score(F.col("text"), C.fit_compression(docs, none))
    scored = docs.select("doc_id", column.alias("s"))
    assert [r["s"]["score"] for r in scored.collect()] == [0.5] * 5
    assert scored.limit(0).count() == 0 and docs.limit(0).select(column).count() == 0


def test_held_out_quality(spark):
    """Of held-out labels: nearly all good texts are kept, and most bad ones are found."""
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    scored = C.op10_compression_quality(spark, SF).join(labels, "doc_id").where("held_out")
    counts = {(r[0], r[1]): r[2] for r in scored.groupBy("quality", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts.get((1, 0), 0)) >= 0.95
    assert counts[0, 0] / (counts[0, 0] + counts.get((0, 1), 0)) >= 0.6


def test_held_out_toxicity(spark):
    """The training labels are few here; clean texts must not be called toxic."""
    labels = table(spark, SF, "labels").select("doc_id", "toxic")
    scored = X.op2_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    counts = {(r[0], r[1]): r[2] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 0.02 * counts[0, 0]

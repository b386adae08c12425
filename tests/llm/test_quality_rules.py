import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.llm import quality_rules as Q
from playtrail.llm.common import HELD_OUT, fold, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(runs)
    covered = {i + k for i, run in enumerate(runs) if counts[run] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \n\t ",
    "a",
    "a b c a b c a b c",
    "x\nx\n\n x\nx",
    "é😀 #1 <b> 50%|$&*\x0bz\x0cw",
    "nbsp joined em space",
    "aa bb cc dd aa bb cc ee aa bb",
]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert Q.text_statistics(text.encode() if text is not None else None)[:5] == plain(text)


def test_statistics_of_random_texts():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab \n#é") for _ in range(rng.randrange(60)))
        assert Q.text_statistics(text.encode())[:5] == plain(text)


def test_column_says_what_the_list_says(spark, documents):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["a$$", "bb", "CC", "d."]) for _ in range(60))) for k in range(80)]
    stats = [Q.text_statistics(t.encode()) for _, t in rows]
    features = Q.feature_rows(stats)
    rules = Q.DecisionList(
        [
            (Q.Condition(1, True, 0.25), Q.Condition(2, False, 0.2)),
            (Q.Condition(0, False, 2.0),),
        ]
    )
    judged = Q.judge(documents(rows), rules).select("doc_id", "quality.*").collect()
    kept = {r["doc_id"]: r["kept"] for r in judged}
    for (i, _), ok, s in zip(rows, rules.keeps(features), stats):
        assert kept[i] == (bool(ok) and not (s[0] < 50 or 100 * s[4] > 50 * s[0]))


def test_learns_a_conjunction_and_spares_the_rest():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, len(Q.FEATURES)))
    bad = (rows[:, 1] > 0.7) & (rows[:, 2] < 0.4)
    learned = Q.learn_decision_list(rows, bad)
    fresh = rng.random((2000, len(Q.FEATURES)))
    truth = (fresh[:, 1] > 0.7) & (fresh[:, 2] < 0.4)
    kept = learned.keeps(fresh)
    assert kept[~truth].mean() > 0.98 and (~kept)[truth].mean() > 0.9


def test_no_rules_from_noise():
    rng = np.random.default_rng(2)
    rows = rng.random((1500, len(Q.FEATURES)))
    learned = Q.learn_decision_list(rows, rng.random(1500) < 0.1)
    assert learned.keeps(rng.random((1000, len(Q.FEATURES)))).mean() > 0.98


def test_nulls_empty_and_no_labels(spark, documents):
    docs = documents([(1, None), (1, None), (None, ""), (2, "w " * 60 + "v " * 60)])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rules = Q.fit_quality_rules(docs, labels)
    assert rules.rules == []
    rows = Q.judge(docs, rules).collect()
    assert [r["quality"]["kept"] for r in sorted(rows, key=lambda r: str(r["doc_id"]))] == [
        False,
        False,
        False,
        False,
    ]
    assert Q.judge(docs.limit(0), rules).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rules = Q.fit_quality_rules(docs, labels)
    judged = Q.judge(docs.select("doc_id", "text"), rules).join(labels.withColumnRenamed("quality", "label"), "doc_id")
    held = judged.where(fold(F.col("doc_id")) == HELD_OUT).where("not quality.base_failed")
    counts = {(r[0], r[1]): r[2] for r in held.groupBy("label", "quality.kept").count().collect()}
    good = counts.get((1, True), 0) / max(1, counts.get((1, True), 0) + counts.get((1, False), 0))
    assert good >= 0.98


def test_stage_returns_the_columns_of_documents(spark, documents):
    docs = documents([(k, " ".join(f"w{k}x{j}" for j in range(70))) for k in range(5)] + [(9, "a")])
    kept = Q.stage_quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= {0, 1, 2, 3, 4}
    assert kept.first()["quality"] == "q"

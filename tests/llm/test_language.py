"""Language identification against a plain version, and its accuracy on held-out texts."""

import math
import zlib
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from playtrail.llm.common import HELD_OUT, fold, table
from playtrail.llm.language import fit_languages, language, op11_language

SF = "/root/testdata/sf0.01"


def training(spark, rows):
    kind = "doc_id bigint, lang string, text string, item string, n int, total int, length int"
    return spark.createDataFrame([(i, *r, "x", 1, 2, 3) for i, r in enumerate(rows)], kind)


def plain(learned, texts, longest=5):
    counts = defaultdict(Counter)
    parts = defaultdict(lambda: defaultdict(Counter))
    find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
    for lang, text in learned:
        if lang is not None:
            for word in find((text or "").lower()):
                counts[lang][word] += 1
                for k in range(1, longest + 1):
                    for i in range(len(word) + 3 - k):
                        parts[lang][k][f" {word} "[i : i + k]] += 1
    names = sorted(counts)
    penalty = 2 + math.log10(max(sum(c.values()) for c in counts.values()))

    def below(table, item):
        return [
            -math.log10(table(x)[item] / sum(table(x).values())) - penalty if item in table(x) else 0
            for x in names
        ]

    def word_score(word):
        if any(word in counts[x] for x in names):
            return below(lambda x: counts[x], word)
        for k in range(longest, 0, -1):
            cut = [f" {word} "[i : i + k] for i in range(len(word) + 3 - k)]
            known = [g for g in cut if any(g in parts[x][k] for x in names)]
            if known:
                rows = [below(lambda x: parts[x][k], g) for g in known]
                return [sum(c) / len(known) for c in zip(*rows)]
        return [0.0] * len(names)

    out = []
    for text in texts:
        found = find((text or "").lower())
        if not found:
            out.append(("und", 0.0))
            continue
        sums = [round(sum(c), 4) for c in zip(*map(word_score, found))]
        best = min(range(len(names)), key=lambda i: sums[i])
        share = 1 / sum(10 ** ((sums[best] - s) / math.sqrt(len(found))) for s in sums)
        out.append((names[best], share))
    return out


LEARNED = [
    ("en", "the cat and the dog, the end"),
    ("en", "A Dog! and a bird"),
    ("fr", "le chat et le chien é"),
    ("fr", "un chien, une fin"),
    ("zh", "中文字"),
    (None, "ignored words here"),
    ("", "zzz"),
    ("de", None),
]
TEXTS = ["the bird", "chiens", "birdlike", "中文", "zzzz", "ж", "", None, "123 !?", "le dog", "İstanbul ét", "a" * 5000]


def test_equals_plain_version(spark):
    model = fit_languages(training(spark, LEARNED))
    assert model.names == ["", "en", "fr", "zh"]
    docs = spark.createDataFrame([(i, t, 1.0, "z") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, score double, lang_pred string")
    got = {r[0]: (r[1], r[2]) for r in language(docs, model).collect()}
    for i, (name, score) in enumerate(plain(LEARNED, TEXTS)):
        assert got[i][0] == name, TEXTS[i]
        assert abs(got[i][1] - score) < 1e-4
        assert 0 <= got[i][1] <= 1


def test_partitions_and_portions_decide_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    models = [fit_languages(docs.repartition(n)) for n in (1, 6)]
    got = [sorted(map(tuple, language(docs.repartition(n), m).collect())) for n, m in zip((1, 6), models)]
    assert got[0] == got[1]


def test_nothing_to_learn_and_empty_table(spark):
    model = fit_languages(training(spark, [(None, "a b"), ("en", "12")]))
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in language(docs, model).collect()} == {(1, "und", 0.0), (None, "und", 0.0)}
    model = fit_languages(training(spark, []))
    assert language(docs.limit(0), model).collect() == []


def test_bounds_keep_the_most_frequent(spark):
    rows = [("en", "a a a b b c d"), ("fr", "x x y z")]
    model = fit_languages(training(spark, rows), max_words=4, max_grams=1000)
    # Of c and d, and of y and z, none may enter alone.
    assert model.words.items == ["a", "b", "x"]


def test_tie_goes_to_the_first_name(spark):
    model = fit_languages(training(spark, [("b", "same"), ("a", "same")]))
    docs = spark.createDataFrame([(1, "same same")], "doc_id bigint, text string")
    assert tuple(language(docs, model).collect()[0]) == (1, "a", 0.5)


def test_query_on_held_out_texts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang", "text")
    rows = op11_language(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    for lang in {r.lang for r in held}:
        own = [r.lang_pred == lang for r in held if r.lang == lang]
        assert sum(own) >= 0.97 * len(own)


def test_held_out_rows_are_not_learned(spark):
    docs = table(spark, SF, "documents")
    spoiled = docs.withColumn(
        "lang", F.when(fold(F.col("doc_id")) == HELD_OUT, F.lit("zz")).otherwise(F.col("lang"))
    )
    assert "zz" not in fit_languages(spoiled.where(fold(F.col("doc_id")) != HELD_OUT)).names

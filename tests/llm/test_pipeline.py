"""The pipeline against a plain version of it, stage by stage."""

import re

import pytest
from pyspark.sql import functions as F
from test_jaccard import plain as plain_components
from test_passages import plain as plain_passages

import corpus_pipeline
from playtrail.llm import decontaminate as D
from playtrail.llm import quality_rules as Q
from playtrail.llm.common import table, workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_run_equals_the_plain_version(spark):
    docs = {
        r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
    }
    rules = Q.fit_quality_rules(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = {}
    for i, text in docs.items():
        s = Q.text_statistics(text.encode())
        if s[0] >= 50 and 100 * s[4] <= 50 * s[0] and rules.keeps(Q.feature_rows([s]))[0]:
            kept[i] = text
    groups = plain_components(list(kept.items()), 80, 5)
    kept = {i: kept[i] for i, _, root in groups if i == root}

    changed = {i: n for i, _, n, _ in plain_passages(list(kept.items()), 35)}
    stages = [f for _, f in corpus_pipeline.STAGES]
    frame = spark.createDataFrame(
        [(i, t, "x", "y", len(t)) for i, t in kept.items()],
        table(spark, SF, "documents").schema,
    )
    deduped = {r["doc_id"]: r for r in stages[2](spark, frame, SF).collect()}
    assert set(deduped) == set(kept)
    for i, text in kept.items():
        assert (deduped[i]["text"] == text) == (changed[i] == 0)
        assert deduped[i]["n_chars"] == len(deduped[i]["text"])

    lowered = str.maketrans(D.UPPER, D.LOWER)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(r["text"].translate(lowered))
        k = min(10, len(w))
        windows |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    clean = set()
    for i, r in deduped.items():
        w = WORD.findall(r["text"].translate(lowered))
        sizes = {len(x) for x in windows}
        if not any(tuple(w[j : j + k]) in windows for k in sizes for j in range(len(w) - k + 1)):
            clean.add(i)

    result = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in result} == clean
    assert all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in result)


CLASHING = (
    "doc_id bigint, text string, n_chars bigint, id_ string, hash_ bigint, _quality string, "
    "quality int, _passages int, passages string, bad_id bigint, component int, node string, "
    "`with.dot` int, tags map<string,int>, parts array<struct<a:int>>"
)


def clashing(spark, texts):
    extra = ("i", 1, "q", 2, 3, "p", 4, 5, "n", 6)
    rows = [
        (i, t, len(t or ""), *extra, {"k": i or 0}, [(i,)]) for i, t in texts
    ]
    return spark.createDataFrame(rows, CLASHING)


def test_stages_hand_on_any_columns(spark):
    sample = table(spark, SF, "documents").orderBy("doc_id").limit(12).collect()
    texts = [(r.doc_id, r.text) for r in sample]
    texts += texts[:4] + [(None, None), (None, ""), (None, texts[0][1]), (99, "x " * 9000)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = clashing(spark, texts)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [k for _, k in out.dtypes] == [k for _, k in docs.dtypes], name
        for r in out.collect():
            assert (r["id_"], r["_quality"], r["passages"], r["with.dot"]) == ("i", "q", "p", 6)
            assert r["tags"] == {"k": r["doc_id"] or 0} and r["parts"][0]["a"] == r["doc_id"]
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, clashing(spark, texts), SF).count() == len(texts)


def test_repeated_rows_that_differ_in_a_map_leave_one(spark):
    docs = clashing(spark, [(1, "some words of a text here")] * 3)
    docs = docs.unionByName(docs.withColumn("tags", F.create_map(F.lit("z"), F.lit(9))))
    kept = corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()
    assert len(kept) == 1 and kept[0]["tags"] == {"k": 1}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        whole = spark.read.parquet(f"{SF}/{name}.parquet")
        whole.limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Elsewhere:
        master = "spark://somewhere:7077"

    class Unset:
        get = staticmethod(lambda name, default=None: default)

    class Session:
        sparkContext, conf = Elsewhere(), Unset()

    with pytest.raises(ValueError):
        workspace(Session(), "x")
    Elsewhere.master = "local[2]"
    assert workspace(Session(), "x") != workspace(Session(), "x")

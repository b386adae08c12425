"""Registered queries: names, and equality with their SQL."""

import pytest
from compare import difference, duck

import corpus_pipeline
from playtrail.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "n-gram Jaccard join",
        "substring dedup",
        "benchmark decontamination",
        "piece encoding",
    ]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(duck(SF), SQL[name], QUERIES[name](spark, SF)) is None


@pytest.mark.parametrize("name", ["op3_decontaminate", "op7_chat_format"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"):
        assert node not in plan

import pytest

from playtrail.llm.common import shipped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    shipped(lambda session: None)(spark)


@pytest.fixture
def documents(spark):
    """Table of (doc_id, text) pairs, with columns that clash with names used inside."""

    def make(rows):
        kind = (
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "quality string, passages int, block int, node string"
        )
        data = [(i, t, "en", "s", len(t or ""), "q", 1, 2, "n") for i, t in rows]
        return spark.createDataFrame(data, kind)

    return make

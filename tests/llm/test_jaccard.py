import random

import numpy as np
import pytest

from playtrail.llm import jaccard as J
from playtrail.llm.components import components

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def plain(rows, percent, size):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        sets.append((i, grams or ({tuple(w)} if w else set())))
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    found = roots([i for i, _ in sets], links)
    return sorted((i, len(s), found[i]) for i, s in sets)


def found(docs, percent, size):
    rows = J.similar_documents(docs, percent, size)
    return sorted(map(tuple, rows.select("doc_id", "n_shingles", "component_id").collect()))


def families(seed, n):
    """Texts in families that differ by a few words, some of them sharing a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(15))
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 70))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            tail = shared if rng.random() < 0.3 else ""
            rows.append((len(rows), " ".join(text) + " " + tail))
    return rows


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5), (50, 1)])
def test_equals_brute_force(documents, percent, size):
    rows = families(percent, 120)
    assert found(documents(rows), percent, size) == plain(rows, percent, size)


def test_cut_tiles_give_the_same(documents, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 5)
    monkeypatch.setattr(J, "TASK_ROWS", 40)
    monkeypatch.setattr(J, "SMALL_TILE", 3)
    monkeypatch.setattr(J, "SMALL_ROWS", 0)
    rows = families(11, 140)
    assert found(documents(rows), 60, 1) == plain(rows, 60, 1)


def test_edges(documents):
    rows = [(5, "A b"), (3, "a B"), (4, "a b c"), (7, None), (8, ""), (9, " \n"), (2, "x " * 50_000)]
    rows += [(1, "x " * 40_000), (6, "q")]
    assert found(documents(rows), 90, 3) == plain(rows, 90, 3)


def test_null_and_repeated_ids(documents):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "lone text"), (None, None)]
    got = J.similar_documents(documents(rows)).select("doc_id", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        ["(None, 4)", "(4, 4)", "(4, 4)", "(None, None)", "(None, None)"]
    )


def test_no_documents(documents):
    assert J.similar_documents(documents([(1, "x")]).limit(0)).count() == 0


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 300)))
        b = np.unique(rng.choice(pool, rng.integers(1, 300)))
        x, y = J.bitmap(a), J.bitmap(b)
        words = min(len(x), len(y)) // 8
        passed = J.slack(len(a), J.folded(x, words), len(b), J.folded(y, words), 60) >= 0
        assert passed or not J.linked(a, b, 60)
    assert not J.linked(a, a[:0])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 240)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    nodes = {n for link in links for n in link}
    assert {r["node"]: r["component"] for r in got} == {
        n: r for n, r in roots(nodes, links).items() if n != r
    }
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, J.op9_jaccard_join(spark, SF).collect()))
    assert got == plain(list(map(tuple, docs)), 90, 3)


def test_stage_keeps_one_of_each_group(spark, documents):
    text = " ".join(f"w{k}" for k in range(80))
    docs = documents([(3, text), (1, text + " more"), (2, "other words here"), (4, None), (5, None)])
    left = J.stage_jaccard_join(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4, 5]


def test_stage_with_repeated_clashing_and_null_ids(spark, documents):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(80)) for x in "abcd")
    rows = [(3, a), (3, a), (3, a + " more")]  # repeated, and a near copy of the same id
    rows += [(5, b), (4, b), (5, "a clean text without any copy")]  # an id of two texts
    rows += [(None, c), (None, c), (None, c + " more")]
    rows += [(None, d), (9, d), (6, "lone"), (7, None), (7, None), (None, "")]
    left = J.stage_jaccard_join(spark, documents(rows), SF)
    assert left.columns == documents(rows).columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    by_start = {x: [r for r in got if (r[1] or "").startswith(f"{x}0 ")] for x in "abcd"}
    assert [len(by_start[x]) for x in "abcd"] == [1, 1, 1, 1]
    assert by_start["a"][0][0] == 3 and by_start["b"] == [(4, b)] and by_start["d"] == [(9, d)]
    rest = sorted((r for r in got if not any(r in v for v in by_start.values())), key=str)
    assert rest == sorted(
        [(5, "a clean text without any copy"), (6, "lone"), (7, None), (7, None), (None, "")],
        key=str,
    )


def test_blocks_of_a_large_tile_do_not_share_a_task(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 20)
    monkeypatch.setattr(J, "TASK_ROWS", 200)
    nodes = spark.range(600).selectExpr("id AS node", "50L AS n", "X'00' AS bits")
    tiles = nodes.selectExpr("7L AS token", "node", "n")
    alone = nodes.selectExpr("node", "node AS component")
    rows = J.dealt_tiles(tiles, nodes, alone, 90)
    held = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert sum(held) > 20 * 600 and max(held) <= 4 * 20

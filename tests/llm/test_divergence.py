"""Source divergence against plain Python, and the perfect hashes it recounts with."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from playtrail.llm import perfect_hash
from playtrail.llm.divergence import shares, source_divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "lang string, source string, text string, shard int, n int, value string, rank int"


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, min_docs, top):
    rows = [(lang or "", source or "", text) for lang, source, text in rows]
    docs = defaultdict(Counter)
    for lang, _, text in rows:
        docs[lang].update(set(plain_terms(text)))
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        groups = {source: Counter() for x, source, _ in rows if x == lang}
        for x, source, text in rows:
            if x == lang:
                groups[source].update(t for t in plain_terms(text) if t in kept)

        def p(counter):
            whole = sum(counter.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // whole for t in kept}

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        own = {s: p(c) for s, c in groups.items()}
        all_ = p(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(gap(own[s][t], own[o][t]) for t in kept)) for o in groups if o != s]
            best = [
                (t, gap(own[s][t], all_[t])) for t in groups[s] if own[s][t] > all_[t]
            ]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 2, "v", 3) for r in rows], COLUMNS)
    got = source_divergence(table, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, n=300):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ÉTÉ", "straße", "日本"]
    rows = []
    for _ in range(n):
        source = draw.choice(["hot", "hot", "b", "c", None, ""])
        lean = 3 if source == "hot" else 1
        text = " ".join(draw.choice(words[: len(words) // lean]) for _ in range(draw.randrange(30)))
        rows.append((draw.choice(["en", "en", "de", None]), source, draw.choice([text, text.upper(), f"{text}, 12 {text}"])))
    return rows + [("xx", "lonely", "rare words only"), ("xx", "other", None), ("yy", "z", "")]


@pytest.mark.parametrize("options", [{}, {"max_keys": 9, "shard_keys": 1, "limit": 20, "slot_bytes": 200}])
def test_equals_plain_python(spark, options):
    rows = corpus(5)
    assert found(spark, rows, min_docs=4, top=3, **options) == plain(rows, 4, 3)


def test_partitions_decide_nothing(spark):
    rows = corpus(6, 80)
    table = spark.createDataFrame([(*r, 1, 2, "v", 3) for r in rows], COLUMNS)
    got = [
        sorted(map(tuple, source_divergence(table.repartition(n), min_docs=3).collect()))
        for n in (1, 5)
    ]
    assert got[0] == got[1] == plain(rows, 3, 10)


def test_ties_go_by_bytes(spark):
    rows = [("en", "a", "zz éé aa ☃☃ bb")] * 3 + [("en", "b", "q")] * 3
    assert found(spark, rows, min_docs=3, top=3) == plain(rows, 3, 3)
    rows = [("en", s, "x y") for s in ("s10", "s9", "s1", "é")] * 3
    assert found(spark, rows, min_docs=2) == plain(rows, 2, 10)


def test_empty_null_and_very_long(spark):
    assert found(spark, []) == []
    rows = [(None, None, None), (None, "b", ""), ("l", "s", "Word " * 50_000 + "x" * 20_000)]
    assert found(spark, rows, min_docs=1) == plain(rows, 1, 10)
    assert found(spark, rows, min_docs=5) == plain(rows, 5, 10)


def test_terms_and_shares_are_exact():
    assert terms("Ab-C_d éÉ 1x\x7f日本".encode()) == [t.encode() for t in plain_terms("Ab-C_d éÉ 1x\x7f日本")]
    counts, total = np.array([0, 7, 9 * 10**14]), np.array([3, 7, 10**15])
    assert shares(counts, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, total)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 300, 5000])
def test_perfect_hash_is_minimal_and_verified(n):
    keys = [b"key%d" % i for i in range(n)]
    made = perfect_hash.build(keys)
    slots = made.slots(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert [made.terms()[i] for i in slots] == keys
    assert set(made.slots([b"", b"other", b"key", b"key1x"]).tolist()) == {-1}


def test_keys_with_equal_hashes_are_told_apart(monkeypatch):
    real = perfect_hash.digests
    monkeypatch.setattr(perfect_hash, "digests", lambda keys: real([k[:1] for k in keys]))
    keys = [b"a1", b"a2", b"a3", b"b1", b"c"]
    made = perfect_hash.build(keys)
    assert sorted(made.slots(keys).tolist()) == [0, 1, 2, 3, 4]
    assert made.slots([b"a4", b"b"]).tolist() == [-1, -1]

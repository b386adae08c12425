import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from playtrail.llm import passages as P
from playtrail.llm.passages import Windows

SF = "/root/testdata/sf0.001"


def plain(rows, width):
    """(doc_id, n_words, n_removed, sha) of every row, by counting all windows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in split for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "passages.*").collect()), key=str)


def random_rows(seed, n, letters="ab"):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(30)))) for k in range(n)]


@pytest.mark.parametrize("width", [1, 2, 5, 7])
def test_equals_brute_force(documents, width):
    rows = random_rows(width, 40, "abc") + [(90, "x y z " * 20), (91, None), (92, ""), (93, " \n")]
    assert found(P.remove_repeated(documents(rows), window=width)) == plain(rows, width)


def test_many_blocks_and_shards(documents, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 150)
    monkeypatch.setattr(P, "SHARD_BYTES", 200)
    rows = random_rows(9, 80, "abcd")
    for depth in (1, 2, 3):
        assert found(P.remove_repeated(documents(rows), window=6, depth=depth)) == plain(rows, 6)


def test_repeated_rows_nulls_and_a_long_text(documents):
    rows = [(1, "p q r s"), (1, "p q r s"), (None, "p q r s t"), (2, "u v w"), (3, "z " * 60_000)]
    assert found(P.remove_repeated(documents(rows), window=3)) == plain(rows, 3)


def test_columns_stay_and_untouched_texts_keep_their_white_space(documents):
    docs = documents([(1, " keep\n\tthis "), (2, "a b c d x"), (3, "y a b c d")])
    left = P.remove_repeated(docs, window=4)
    assert left.columns == [c for c in docs.columns if c != "passages"] + ["passages"]
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {1: " keep\n\tthis ", 2: "x", 3: "y"}


def test_no_documents(documents):
    assert P.remove_repeated(documents([(1, "x")]).limit(0)).count() == 0


def test_window_prints_depend_on_every_word_and_its_place():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    for width in (1, 2, 3, 35, 400):
        prints = P.window_prints(words, width, 0)
        assert len(prints) == 400 - width + 1
        for at in (0, width // 2, width - 1):
            other = words.copy()
            other[at] += np.uint64(1)
            assert P.window_prints(other, width, 0)[0] != prints[0]
        assert (P.window_prints(words[3:], width, 0) == prints[3:]).all() or width == 400
    assert len(P.window_prints(words[:2], 3, 0)) == 0


def test_an_estimate_is_never_too_low():
    """A sketch much too small still finds every repeated window."""
    texts = [t.encode() for _, t in random_rows(4, 60, "abcdef")]
    windows = [Windows(texts[:30], 5), Windows(texts[30:], 5)]
    shards, depth = 1, 2
    answers = [{}, {}]
    by_shard = {}
    for k, w in enumerate(windows):
        for number, cells, twice in P.sketch_pieces(w, shards, depth):
            by_shard.setdefault(number, []).append((k, cells & np.uint64(63), twice))
    for number, pieces in by_shard.items():
        merged = P.merge_sketch([(c, t) for _, c, t in pieces])
        for (k, _, _), flags in zip(pieces, merged):
            answers[k][number] = P._bits(flags)
    count = Counter(p for w in windows for p in zip(w.first.tolist(), w.second.tolist()))
    for k, w in enumerate(windows):
        chosen = set(P.candidates(w, shards, depth, answers[k]).tolist())
        for i, p in enumerate(zip(w.first.tolist(), w.second.tolist())):
            assert count[p] < 2 or i in chosen


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, P.op5_substring_dedup(spark, SF).collect()), key=str)
    assert got == plain(list(map(tuple, docs)), 35)


def test_words_are_cut_and_hashed_as_arrays():
    rng = random.Random(3)
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "a", "b", "é", "日"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))).encode() for _ in range(60)]
    texts += [None, b"", b"  ", b"abcdefgh abcdefghi abcdefg", b"x" * 64, b"x" * 65, b"x" * 66]
    texts += [b"a\0 a a\0\0", b"\xff \xffa", b"z" * 200 + b" " + b"z" * 199 + b"y"]
    data, begins, ends, counts = P.cut_words(texts)
    words = [w for t in texts for w in (t or b"").split()]
    assert [data[a:b] for a, b in zip(begins, ends)] == words
    assert counts.tolist() == [len((t or b"").split()) for t in texts]
    first, second = P.word_prints(data, begins, ends, lanes=2)
    assert (P.word_prints(data, begins, ends, lanes=1)[0] == first).all()
    for lane in (first, second):
        assert len(set(lane.tolist())) == len(set(words))
        assert len(set(zip(words, lane.tolist()))) == len(set(words))
    assert not set(first.tolist()) & set(second.tolist())


def test_no_byte_of_a_text_ends_it():
    windows = Windows([b"a \xff b", b"\xff b c"], 2)
    assert windows.counts.tolist() == [3, 3] and len(windows.first) == 4
    assert windows.first[1] == windows.first[2]


def test_pieces_bring_the_places_of_their_windows():
    """Once per window and block, however often it stands there; other windows by their places."""
    texts = [b"h o t " * 50, b"a b c d", b"x y z a b c", b"p q r s"]
    windows = Windows(texts, 3)
    pieces = list(P.exact_pieces(windows, np.arange(len(windows.starts)), 4))
    prints = [tuple(p) for _, some, _, _ in pieces for p in some.tolist()]
    assert len(prints) == len(set(prints)) == 3 + 2 + 3 + 2
    twice = [s for _, some, t, places in pieces for s in places[: len(some)][t].tolist()]
    assert sorted(twice) == [0, 1, 2, 150]
    inner = [places.tolist() for _, some, _, places in pieces if not len(some)]
    assert inner == [[*range(148), 150, 157]]
    assert all((np.diff(places) > 0).all() for *_, places in pieces)

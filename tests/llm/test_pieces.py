"""Token counts and sampled encoding over the piece lattice."""

import math
import random
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playtrail.llm import sampling as S
from playtrail.llm import token_counts as K
from playtrail.llm.pieces import Pieces, pre_tokens, read_pieces, utf8


@pytest.fixture(scope="module")
def pieces():
    return read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


TOY = Pieces(
    {" ": 300, "a": 301, "b": 302, "ab": 303, " a": 304, "ba": 305, " ab": 306},
    dict(zip([" ", "a", "b", "ab", " a", "ba", " ab"], [-2.0, -1.0, -1.5, -2.2, -1.8, -2.1, -3.0])),
    tuple(range(256)),
    -13.0,
    3,
)


def segmentations(pieces, word):
    """Every way to cut a word: list of (score, ids, tokens)."""
    if not word:
        return [(0.0, [], 0)]
    found = []
    for end in range(1, len(word) + 1):
        piece = word[:end]
        here = []
        if piece in pieces.ids:
            here.append((pieces.scores[piece], [pieces.ids[piece]]))
        elif end == 1:
            here.append((pieces.unknown, [pieces.bytes_[b] for b in utf8(piece)]))
        for score, ids in here:
            for rest, more, n in segmentations(pieces, word[end:]):
                found.append((score + rest, ids + more, len(ids) + n))
    return found


def best_count(pieces, word):
    top = max(s for s, *_ in segmentations(pieces, word))
    return min(n for s, _, n in segmentations(pieces, word) if math.isclose(s, top, abs_tol=1e-12))


ENTER = S.SampleTrie.enter
TEXTS = ["", "abab a", "aé▁b", "  ab\n\tba", "a" * 100, "日本 x", "<|x|> \x00\x7f", " a b"]


@pytest.mark.parametrize("text", TEXTS)
def test_pre_tokens_are_the_text(text):
    joined = "".join(pre_tokens(text.encode()))
    assert joined == (" " + text if text else "")


def test_counts_equal_brute_force(pieces):
    rng = random.Random(1)
    for vocabulary in (TOY, pieces):
        for max_nodes in (1, 10**6):
            counts = K.TerminalCounts(vocabulary, max_nodes)
            for _ in range(150):
                word = "".join(rng.choice(" abé▁the") for _ in range(rng.randrange(1, 8)))
                assert counts[word] == best_count(vocabulary, word)


def plain_count(pieces, word):
    """Fewest tokens of a best segmentation, by the usual table over ends."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for first in range(max(0, end - pieces.longest), end):
            piece, (score, n) = word[first:end], best[first]
            if piece in pieces.ids:
                options.append((score + pieces.scores[piece], -(n + 1)))
            elif len(piece) == 1:
                options.append((score + pieces.unknown, -(n + len(utf8(piece)))))
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


def long_runs():
    rng = random.Random(4)
    return {
        "letters": "".join(rng.choice("etaoinshrdlu") for _ in range(10_000)),
        "address": "httpswwwexamplecom" * 30,
        "cjk": "".join(rng.choice("中文字日本語の一二三") for _ in range(10_000)),
        "signs": "-=/." * 2_500,
        "one letter": "a" * 10_000,
        "longer by one": "the" * 16 + "x",
    }


@pytest.mark.parametrize("kind", sorted(long_runs()))
def test_long_runs_are_not_cut(pieces, kind):
    run = long_runs()[kind]
    assert pre_tokens(run.encode()) == [" " + run]
    count = K.counter(pieces)
    wanted = plain_count(pieces, " " + run)
    assert count(run.encode()) == count(run.encode()) == (1, wanted)
    sharp = S.Sampler(pieces, 0, 1e6).encode(["k", "k"], [run.encode()] * 2)
    assert sharp[0].tolist() == sharp[1].tolist() and len(sharp[0]) == wanted
    free = S.Sampler(pieces, 0, 1.0).encode(["k"], [run.encode()])[0]
    assert S.decoder(pieces)(free.tolist()) == run.encode()


def test_count_query_over_a_table(spark, documents, pieces):
    texts = list(long_runs().values()) + ["the cat sat on the mat", "é" * 60, None, ""]
    docs = documents(list(enumerate(texts)))
    got = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", K.token_counts(docs, F.col("text")).alias("c")).select("doc_id", "c.*").collect()}
    for i, text in enumerate(texts):
        words = pre_tokens((text or "").encode())
        assert got[i] == (len(words), sum(plain_count(pieces, w) for w in words))


def test_thinning_out_changes_nothing(pieces):
    """A trie of few nodes that keeps what comes back, against one that never fills."""
    rng = random.Random(9)
    often = ["".join(rng.choice("abethé") for _ in range(5)) for _ in range(30)]
    small, whole = S.Sampler(pieces, 3, 1.0, max_nodes=1500), S.Sampler(pieces, 3, 1.0)
    sizes = []
    for k in range(60):
        rare = ["".join(rng.choice("abethé") for _ in range(7)) for _ in range(60)]
        text = " ".join(rng.choices(often, k=80) + rare + ["x" * 60]).encode()
        one, other = (s.encode([str(k)], [text])[0] for s in (small, whole))
        assert one.tolist() == other.tolist()
        sizes.append(small.trie.size)
    assert max(sizes) < 3000 < whole.trie.size
    kept = sum(" " + w in small.ends for w in often)
    assert kept > 20


@pytest.mark.parametrize("sharpness", [0.0, 1.0, 1e6])
def test_nodes_computed_together_are_those_computed_one_by_one(pieces, sharpness):
    rng = random.Random(6)
    signs = " abethé▁日\U0001f600\x00\udc80"
    for vocabulary in (TOY, pieces):
        together, single = (S.SampleTrie(vocabulary, sharpness) for _ in range(2))
        for _ in range(5):
            words = ["".join(rng.choices(signs, k=rng.randrange(1, 20))) for _ in range(40)]
            nodes = [together.reach(w) for w in words]
            together.fill()
            together.fill()
            assert nodes == [single.insert(w) for w in words]
            assert together.insert("ab" * 40) == single.insert("ab" * 40)
        assert together.children == single.children and together.size == single.size
        for name in ("first", "origin", "piece", "width", "parent", "char"):
            assert getattr(together, name) == getattr(single, name), name
        for name in ("reached", "forward"):
            assert list(getattr(together, name)) == pytest.approx(list(getattr(single, name)), rel=1e-12)


def test_sums_do_not_depend_on_what_is_computed_with_them(pieces):
    words = ["the", "thethe", " thunder", "日本", "é", "a" * 40]
    alone, beside = S.SampleTrie(pieces), S.SampleTrie(pieces)
    others = [f" {k}other{k * k}" for k in range(500)]
    nodes = [beside.reach(w) for w in others + words][len(others) :]
    beside.fill()
    for word, node in zip(words, nodes):
        end = alone.reach(word)
        alone.fill()
        assert alone.forward[end] == beside.forward[node]
        ends = [[*t.first, len(t.reached)] for t in (alone, beside)]
        a, b = (slice(e[n], e[n + 1]) for e, n in zip(ends, (end, node)))
        assert alone.reached[a] == beside.reached[b] and alone.piece[a] == beside.piece[b]


def test_only_long_pre_tokens_are_inserted_alone(pieces, monkeypatch):
    alone = []
    monkeypatch.setattr(
        S.SampleTrie, "enter", lambda trie, word, *rest: (alone.append(word), ENTER(trie, word, *rest))
    )
    texts = [b"the quick brown fox", b"x" * 60 + b" y", None, b"", b"z" * 60]
    sampler = S.Sampler(pieces, 0, 1.0)
    found = [S.decoder(pieces)(ids.tolist()) for ids in sampler.encode(list("abcde"), texts)]
    assert found == [t or b"" for t in texts]
    assert set(alone) == {" " + "x" * 60, " " + "z" * 60}


def test_count_query_columns(spark, documents, pieces):
    docs = documents([(1, None), (1, None), (None, ""), (2, "the cat " * 20_000), (3, "zé▁")])
    rows = docs.select("doc_id", K.token_counts(docs, F.col("text")).alias("c")).collect()
    found = Counter((r["doc_id"], r["c"]["n_tokens"]) for r in rows)
    count = K.counter(pieces)
    assert found[1, 0] == 2 and found[None, 0] == 1
    assert (2, count(b"the cat " * 20_000)[1]) in found and (3, count("zé▁".encode())[1]) in found
    assert docs.limit(0).select(K.token_counts(docs, F.col("text"))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=5))
def test_decoding_is_lossless(text, key):
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    ids = S._kept_sampler(pieces, 0, 1.0).encode([key], [text.encode()])[0]
    assert S.decoder(pieces)(ids.tolist()) == text.encode()


def test_sampled_ids_are_distributed_as_the_lattice_says():
    word = " abab"
    options = segmentations(TOY, word)
    total = sum(math.exp(s) for s, *_ in options)
    wanted = Counter()
    for s, ids, _ in options:
        wanted[tuple(ids)] += math.exp(s) / total
    n = 20_000
    sampler = S.Sampler(TOY, 7, 1.0)
    found = Counter(
        tuple(x.tolist()) for x in sampler.encode([str(k) for k in range(n)], [b"abab"] * n)
    )
    assert set(found) <= set(wanted)
    for ids, p in wanted.items():
        assert abs(found[ids] / n - p) < 5 * math.sqrt(p / n) + 1e-3


def test_a_sharp_distribution_leaves_the_best(pieces):
    ids = S.Sampler(pieces, 0, 1e6).encode(["k"], [b"the quick brown fox"])[0]
    assert len(ids) == K.counter(pieces)(b"the quick brown fox")[1]


def test_batches_and_resets_change_nothing(pieces):
    rng = random.Random(2)
    texts = [
        " ".join("".join(rng.choice("abethé") for _ in range(6)) for _ in range(20)).encode()
        for _ in range(50)
    ]
    keys = [str(k) for k in range(50)]
    whole = S.Sampler(pieces, 3, 1.0).encode(keys, texts)
    small = S.Sampler(pieces, 3, 1.0, max_nodes=1)
    for k in reversed(range(50)):
        assert small.encode([keys[k]], [texts[k]])[0].tolist() == whole[k].tolist()
    other = S.Sampler(pieces, 4, 1.0).encode(keys, texts)
    assert any(a.tolist() != b.tolist() for a, b in zip(whole, other))


def test_encoding_columns(spark, documents):
    rows = [(1, None), (2, "same text here"), (2, "same text here"), (None, "▁ x\n"), (3, "ab " * 30_000)]
    docs = documents(rows)
    coded = S.encode_sampled(docs, F.col("doc_id"), F.col("text"))
    found = docs.select("doc_id", "text", coded.alias("e")).cache()
    assert all(r["e"]["lossless"] for r in found.collect())
    twice = [r["e"]["ids"] for r in found.where("doc_id = 2").collect()]
    assert twice[0] == twice[1]
    back = found.select("text", S.decode_ids(docs, F.col("e.ids")).alias("back"))
    assert all((r["text"] or "") == r["back"] for r in back.collect())
    again = docs.repartition(5).select("doc_id", "text", coded.alias("e"))
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    assert docs.limit(0).select(coded).count() == 0

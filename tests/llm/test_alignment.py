"""Tokenizer alignment against whole-text encoding and a plain walk over bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from playtrail.llm import alignment
from playtrail.llm.alignment import Aligner, aligned
from playtrail.llm.common import table

HARD = [
    None,
    "",
    " ",
    "  ",
    "a",
    "a ",
    " a",
    "  two  spaces   ",
    "line\nline \n x\n  y\t z \r\n",
    "tab\t a  b　 c   d",
    "x▁y and ▁ marks",
    "<|endoftext|> <s> </s><unk> <0x41>",
    "中文字符 日本語のテキスト 한국어",
    "emoji 👩‍👩‍👧‍👦 🏳️‍🌈 é ﬁ Ⅷ \u0000 \x1c x",
    "don't we'll it's 12345 3.14 ...---!!! a_b",
    "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ꙮ ৎ �",
    "x" * 3000,
    "日" * 500,
    "word " * 400,
    "same same",
    "same same",
]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def plain_bytes(models):
    a, b = models
    signs = alignment.byte_of_sign()

    def left(i):
        return bytes(signs[c] for c in a.id_to_token(i))

    def right(i):
        piece = b.id_to_piece(i)
        if piece.startswith("<0x"):
            return bytes([int(piece[3:5], 16)])
        return piece.encode().replace("▁".encode(), b" ")

    return left, right


def owners(parts):
    return [i for i, part in enumerate(parts) for _ in part]


def plain(models, texts):
    """Links by the tokens that own each byte."""
    a, b = models
    left, right = plain_bytes(models)
    docs, pairs = [], Counter()
    for text in texts:
        found = None
        if text:
            a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            a_parts, b_parts = [left(i) for i in a_ids], [right(i) for i in b_ids]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                links = sorted(set(zip(owners(a_parts), owners(b_parts))))
                links = [(a_ids[i], b_ids[j]) for i, j in links]
                a_ends, b_ends, end = {}, {}, 0
                for ids, parts, ends in ((a_ids, a_parts, a_ends), (b_ids, b_parts, b_ends)):
                    end = 0
                    for n, part in enumerate(parts, 1):
                        end += len(part)
                        ends[end] = n
                groups, i, j = [], 0, 0
                for cut in sorted(a_ends.keys() & b_ends.keys()):
                    x, y = a_ids[i : a_ends[cut]], b_ids[j : b_ends[cut]]
                    groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                    i, j = a_ends[cut], b_ends[cut]
                found = len(a_ids), len(b_ids), groups, links
                pairs.update(links)
        docs.append(found)
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = []
    for found in docs:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        tops = sum(pairs[link] == best[link[1]] for link in links)
        out.append((n_a, n_b, len(groups), len(links), tops, sum(pairs[x] for x in links), digest))
    return out


def test_equals_plain_walk_on_hard_texts(spark, documents, models):
    docs = documents(list(enumerate(HARD)))
    got = aligned(docs, max_pairs=100)
    assert got.columns[0] == "doc_id" and got.columns[-1] == "groups_sha256"
    rows = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert [rows[i] for i in range(len(HARD))] == plain(models, HARD)


def test_query_equals_plain_walk(spark, models):
    docs = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    texts = [r.text for r in docs.select("text").collect()]
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    got = {r[0]: tuple(r[1:]) for r in alignment.op12_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i in ids] == plain(models, texts)


def test_whole_texts_where_cutting_is_not_allowed(models):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        left = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        right = file.read()
    cutting, whole = Aligner(left, right), Aligner(left, right)
    assert cutting.cuts
    whole.cuts = False
    for text in HARD[1:]:
        (one,), (other,) = cutting.documents([text]), whole.documents([text])
        assert (one is None) == (other is None)
        if one is not None:
            links = [sorted(np.frombuffer(x[1], dtype=whole.code_type).tolist()) for x in (one, other)]
            assert (one[0], one[2], links[0]) == (other[0], other[2], links[1])


def test_sums_are_handed_on_in_parts(spark, documents, models, monkeypatch):
    sums = alignment.PairSums()
    for _ in range(3):
        sums.add(np.array([5, 7]), np.array([1, 2]))
    sums.merge()
    assert [x.tolist() for x in sums.parts[0]] == [[5, 7], [3, 6]]
    (batch,) = sums.rows()
    assert batch.column("codes").to_pylist() == [[5, 7]] and sums.held == 0


def test_empty_table_null_ids_and_invalid_text(spark, documents):
    assert aligned(documents([])).collect() == []
    bad = documents([(None, "a b"), (None, "a b")])
    rows = [tuple(r) for r in aligned(bad).collect()]
    assert rows[0] == rows[1] and rows[0][0] is None and rows[0][6] > 0
    raw = spark.sql("SELECT 1L AS doc_id, CAST(x'61FF62' AS STRING) AS text")
    assert tuple(aligned(raw).collect()[0]) == (1, 0, 0, 0, 0, 0, 0, "")


def both_models():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        left = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return left, file.read()


def test_letters_and_signs_are_aligned_once():
    aligner, asked = Aligner(*both_models()), []
    assert aligner.apart
    parts = aligner.parts
    aligner.parts = lambda keys: asked.append(keys) or parts(keys)
    aligner.documents(["one zwölf,"])
    aligner.documents(["one, zwölf, (one) zwölf!"])
    assert [sorted(keys) for keys in asked] == [
        sorted([b"one", "zwölf".encode(), b" ,"]),
        [b" !", b"(one)"],
    ]


def test_signs_behind_letters_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_STRETCHES", 40)
    cutting, whole = Aligner(*both_models()), Aligner(*both_models())
    whole.cuts = False
    rng = np.random.default_rng(4)
    letters = ["a", "Word", "don", "été", "ÿß", "中文", "x1", "µ", "ª", "É", "é", "²"]
    signs = [",", "'", "'s", "'.", "...", "\"'", "<", "</s>", "_", "~`", ".\n", "▁", "|>", ""]
    texts = [
        " ".join(rng.choice(letters) + rng.choice(signs) + rng.choice(signs) for _ in range(9))
        for _ in range(150)
    ]
    found, plain_ = cutting.documents(texts), [whole.documents([t])[0] for t in texts]
    again = [cutting.documents([t])[0] for t in texts]
    assert len(cutting.known) < 200
    for one, other, third in zip(found, plain_, again):
        assert (one is None) == (other is None) == (third is None)
        if one is not None:
            links = [
                sorted(np.frombuffer(x[1], dtype=whole.code_type).tolist())
                for x in (one, other, third)
            ]
            assert one[0] == other[0] == third[0] and one[2] == other[2] == third[2]
            assert links[0] == links[1] == links[2]

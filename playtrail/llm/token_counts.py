"""Token counts by a unigram model, computed once per shared prefix of pre-tokens.

Each worker keeps a trie of the distinct pre-tokens it has met. The best unigram score of a prefix is
computed when its node is made and serves every pre-token that begins so; the count at the node
where a pre-token ends is stored, and a text's count is the sum over its pre-tokens. Nothing is
shuffled. The trie is emptied when it holds `max_nodes` nodes, which costs time but changes no count.

Defined results: a null or empty text has no tokens; repeated rows each get their own count; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import kept, table, text_udf
from playtrail.llm.pieces import LONG, CountTrie, Pieces, pre_tokens, read_pieces

VOCABULARY = "piece_bpe_32k.model"
MAX_NODES = 700_000


class TerminalCounts(dict):
    """Tokens of each pre-token; one that is missing is inserted in the trie first."""

    def __init__(self, pieces: Pieces, max_nodes: int):
        super().__init__()
        self.trie = CountTrie(pieces)
        self.max_nodes = max_nodes

    def __missing__(self, word: str) -> int:
        if self.trie.size > self.max_nodes:
            self.trie.clear()
            self.clear()
        count = self.trie.tokens(word)
        if len(word) <= LONG:
            self[word] = count
        return count


def counter(pieces: Pieces, max_nodes: int = MAX_NODES):
    key = ("token counts", hash(pieces), max_nodes)
    counts = kept(key, lambda: TerminalCounts(pieces, max_nodes))

    def count(text: bytes | None) -> tuple[int, int]:
        words = pre_tokens(text)
        return len(words), sum(map(counts.__getitem__, words))

    return count


def token_counts(
    docs: DataFrame, text: Column, vocabulary: str | None = None, max_nodes: int = MAX_NODES
) -> Column:
    """Struct of `n_pretokens` and `n_tokens`. The vocabulary, of fixed size, is read on the driver
    and sent to each executor once."""
    pieces = read_pieces(vocabulary or public_tokenizers.path(VOCABULARY))
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    return text_udf(
        lambda: counter(sent.value, max_nodes), "n_pretokens bigint, n_tokens bigint"
    )(text)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", token_counts(docs, F.col("text")).alias("c"))
    return counted.select("doc_id", "c.n_pretokens", "c.n_tokens")

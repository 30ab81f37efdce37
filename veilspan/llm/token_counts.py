"""Token counts: unigram segmentation of distinct pre-tokens, by dynamic programming over a trie.

A pre-token is a whitespace-delimited word with the word-start mark in front. Distinct pre-tokens go into a trie whose
nodes keep the forward score (the best log-probability of any segmentation of the node's prefix) and the token count of
that segmentation. A node's values depend on its prefix alone, so words that share a prefix share its forward scores;
a word's terminal count is kept for every later occurrence.

The vocabulary file is a parameter. It stores merge ranks, not probabilities, so a piece's log-probability is taken from
its rank by Zipf's law: -log(rank + 3). A character that is no piece costs its UTF-8 bytes, one token and
``BYTE_SCORE`` each. Of equal scores the one with fewer tokens wins.

Defined cases: null and blank texts have 0 words and 0 tokens; whitespace only separates; repeated rows get equal rows.
"""

from __future__ import annotations

import math

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import bounded_batches, kept_by_worker

MARK, BYTE_SCORE = "▁", -14.0
#: A worker's trie starts anew beyond so many nodes; longer words are counted without entering it.
MOST_NODES, LONGEST_STORED = 1_200_000, 48
_SHIFT = 21  # code points fit in 21 bits


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with their log-probabilities; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(rank + 3) for rank, i in enumerate(ids)}


class UnigramTrie:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.terminal: dict[str, tuple[int, int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens, self.spelled = [0.0], [0], [0]

    def _forward(self, word: str, end: int, path: list[int]) -> tuple[float, int, int]:
        """Score, tokens and tokens spelled in bytes for the prefix up to ``end``, from its shorter prefixes' values."""
        pieces, score, tokens, spelled = self.pieces, self.score, self.tokens, self.spelled
        best = None
        for start in range(max(0, end - self.longest), end):
            piece = pieces.get(word[start:end])
            if piece is not None:
                node = path[start]
                found = (score[node] + piece, -tokens[node] - 1, spelled[node])
                if best is None or found[:2] > best[:2]:
                    best = found
        if word[end - 1] not in pieces:
            node, n = path[end - 1], len(word[end - 1].encode("utf-8", "surrogatepass"))
            found = (score[node] + n * BYTE_SCORE, -tokens[node] - n, spelled[node] + n)
            if best is None or found[:2] > best[:2]:
                best = found
        return best[0], -best[1], best[2]

    def insert(self, word: str) -> tuple[int, int]:
        """Adds the pre-token's missing nodes; its tokens, and how many of them are bytes."""
        node, path = 0, [0]
        for end, char in enumerate(word, 1):
            key = node << _SHIFT | ord(char)
            node = self.child.get(key, -1)
            if node < 0:
                values = self._forward(word, end, path)
                node = self.child[key] = len(self.score)
                for column, value in zip((self.score, self.tokens, self.spelled), values, strict=True):
                    column.append(value)
            path.append(node)
        return self.tokens[node], self.spelled[node]

    def add(self, words) -> None:
        """Terminal counts of all these words, in sorted order so that shared prefixes are met together."""
        for word in sorted(words):
            if len(word) > LONGEST_STORED:
                kept = self.child, self.score, self.tokens, self.spelled
                self._clear()
                self.terminal[word] = self.insert(MARK + word)
                self.child, self.score, self.tokens, self.spelled = kept
            else:
                self.terminal[word] = self.insert(MARK + word)

    def counts(self, texts) -> list[tuple[int, int, int]]:
        """Words, tokens and byte tokens of each text."""
        if len(self.score) > MOST_NODES:
            self._clear()
            self.terminal.clear()
        split = [(text or "").split() for text in texts]
        missing = set().union(*split).difference(self.terminal)
        self.add(missing)
        terminal = self.terminal
        out = []
        for words in split:
            values = [terminal[w] for w in words]
            out.append((len(words), sum([v[0] for v in values]), sum([v[1] for v in values])))
        for word in [w for w in missing if len(w) > LONGEST_STORED]:
            del terminal[word]
        return out


COUNTS = T.StructType().add("n_words", T.LongType()).add("n_tokens", T.LongType()).add("byte_tokens", T.LongType())


def token_counts(df: DataFrame, text: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """``df`` with n_words, n_tokens and byte_tokens (columns of those names are replaced). No shuffle: each worker keeps a
    bounded trie over the batches that it meets."""
    bounded_batches(df.sparkSession)
    path = vocabulary_path or public_tokenizers.path("piece_bpe_32k.model")

    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(kept_by_worker(("token counts", path), lambda: UnigramTrie(vocabulary(path))).counts(texts), columns=COUNTS.names)

    others = [F.col(f"`{c}`") for c in df.columns if c not in COUNTS.names]
    return df.select(*others, F.pandas_udf(counted, COUNTS)(F.col(text)).alias("_veil_counts")).select(*others, "_veil_counts.*")

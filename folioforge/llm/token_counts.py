"""Token counts by dynamic programming over a trie that all pre-tokens share.

A pre-token is a run without white space, with the word mark in front. The pieces of a vocabulary file are scored as a
unigram model, and a pre-token counts as many tokens as its best-scoring cut has pieces. The forward score of a prefix,
the best score of any cut of it, does not depend on what follows; so distinct pre-tokens are inserted in a trie, the score
is computed once for each node, and a pre-token's count is stored where it ends. Repeated words cost one look-up.

The file's pieces are in rank order. A rank's log probability is Zipf's, -log(rank + 1) less the log of the sum over
all; a character outside the vocabulary falls back to its UTF-8 bytes at the least score less 10.

Trie and stored counts are bounded per worker and emptied when full; counts do not depend on that. Pre-tokens over
``LONG`` characters run the same recurrence without nodes.

Defined results: null, empty and blank texts have no tokens; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.common import documents, map_arrow, raw_texts

MARK = "▁"
LONG = 64


def zipf_scores(n: int) -> list[float]:
    norm = math.log(sum(1 / (r + 1) for r in range(n)))
    return [-math.log(r + 1) - norm for r in range(n)]


@lru_cache(maxsize=2)
def unigram_pieces(path: str) -> dict[str, float]:
    """piece -> log probability, for the pieces of a sentencepiece file that text can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return dict(zip(text, zipf_scores(len(text))))


class TrieCounter(dict):
    """pre-token (UTF-8, without its mark) -> number of tokens."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = 400_000, max_words: int = 300_000):
        super().__init__()
        self.pieces, self.max_nodes, self.max_words = pieces, max_nodes, max_words
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def __missing__(self, word: bytes) -> int:
        text = MARK + word.decode()
        n = self._walk(text) if len(text) <= LONG else self._straight(text)
        if len(text) <= LONG:
            if len(self) >= self.max_words:
                self.clear()
            self[word] = n
        return n

    def _best(self, text: str, end: int, score: list[float], count: list[int], at: int) -> tuple[float, int]:
        """Forward score and count of ``text[:end]``; ``score[at + i]`` is that of ``text[:i]``."""
        c = text[end - 1]
        best, n = score[at + end - 1] + self.unknown, count[at + end - 1] + len(c.encode())
        get = self.pieces.get
        for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
            p = get(text[start:end])
            if p is not None and score[at + start] + p > best:
                best, n = score[at + start] + p, count[at + start] + 1
        return best, n

    def _walk(self, text: str) -> int:
        if len(self.score) + len(text) > self.max_nodes:
            self.reset()
        child, node, score, count = self.child, 0, [0.0], [0]
        for end, c in enumerate(text, 1):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                s, n = self._best(text, end, score, count, 0)
                node = child[key] = len(self.score)
                self.score.append(s)
                self.count.append(n)
            score.append(self.score[node])
            count.append(self.count[node])
        return count[-1]

    def _straight(self, text: str) -> int:
        keep = self.longest + 1
        score, count, at = [0.0], [0], 0
        for end in range(1, len(text) + 1):
            s, n = self._best(text, end, score, count, at)
            score.append(s)
            count.append(n)
            if len(score) > 4096:
                at -= len(score) - keep
                score, count = score[-keep:], count[-keep:]
        return count[-1]


@lru_cache(maxsize=2)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(unigram_pieces(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """[doc_id, n_words, n_tokens] of every whole text; one pass, no shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = _counter(path).__getitem__
        for b in parts:
            words = [t.split() for t in raw_texts(b)]
            counts = [sum(map(tokens_of, w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return map_arrow(documents(docs), run, "doc_id long, n_words long, n_tokens long")

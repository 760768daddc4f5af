import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from folioforge.llm import common, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return token_counts.unigram_pieces(PATH)


@pytest.fixture(scope="module")
def library(pieces):
    """The same pieces and scores in an independent unigram implementation."""
    low = min(pieces.values())
    extra = [("<unk>", low)] + [(f"<0x{b:02X}>", low) for b in range(256)]
    return Tokenizer(models.Unigram([*extra, *pieces.items()], unk_id=0, byte_fallback=True))


def brute(text, library):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(words), sum(len(library.encode("▁" + w).ids) for w in words)


def all_cuts(text, pieces):
    """(score, count) of the best cut, by trying every cut."""
    if not text:
        return 0.0, 0
    low = min(pieces.values()) - 10
    tries = []
    for i in range(1, len(text) + 1):
        p = pieces.get(text[:i])
        if p is None and i > 1:
            continue
        s, n = all_cuts(text[i:], pieces)
        if p is not None:
            tries.append((p + s, n + 1))
        if i == 1:
            tries.append((low + s, n + len(text[0].encode())))
    return max(tries)


def test_every_cut_of_short_words(pieces):
    rng = random.Random(3)
    t = token_counts.TrieCounter(pieces, max_nodes=40)
    for _ in range(300):
        w = "".join(rng.choice("theraniong龥é") for _ in range(rng.randint(1, 9)))
        assert t[w.encode()] == all_cuts("▁" + w, pieces)[1], w


def test_whole_table(spark, sf, library):
    docs = common.table(spark, sf, "documents")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()}
    assert got == {r.doc_id: brute(r.text, library) for r in docs.collect()}


def test_edge_rows(spark, library, pieces):
    long = "".join(random.Random(1).choice("abcdeï龥") for _ in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a\x1cb c d"), (None, "the end"), (5, long), (5, long), (6, "😀" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as n_tokens")
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts.count_tokens(df, PATH).collect())
    assert got == sorted(((d or 0), *brute(t, library)) for d, t in rows)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0

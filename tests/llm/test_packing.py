import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folioforge.llm import common, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, ids_of, window=1024):
    """Every id once, CRCs right, sequences gapless, and the padding they need."""
    library = defaultdict(list)
    by_seq = defaultdict(list)
    for r in rows:
        library[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(library) == set(ids_of)
    for d, pieces in library.items():
        want, at = ids_of[d], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            data = np.array(want[at : at + r.length], "<u4").tobytes()
            assert zlib.crc32(data) == r.ids_crc32
            if "ids" in r:
                assert bytes(r.ids) == data
            at += r.length
        assert at == len(want)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(by_seq)


def test_whole_table(spark, sf):
    lib = Tokenizer.from_file(PATH)
    docs = common.table(spark, sf, "documents")
    ids_of = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    padding, n = check_pieces(packing.pack_documents(docs, PATH).collect(), ids_of)
    assert padding == 0 and n <= sum(map(len, ids_of.values())) / 1024 + 40


def test_small_blocks_and_edge_rows(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, None), (2, ""), (3, " a b" * 3000), (4, "x"), (None, "null id"), (5, "é" * 90000)] + [(i, "w " * (i % 37)) for i in range(10, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as start")
    ids_of = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    for window in (1024, 64, 1):
        got = packing.pack_documents(df, PATH, window=window, block_docs=50).collect()
        assert check_pieces(got, ids_of, window)[0] == 0
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(7, "same text")] * 2, "doc_id long, text string")
    assert packing.pack_documents(twice, PATH, with_ids=False).count() >= 2


def test_very_long_white_space(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, "x" + " " * 3_000_000 + "y"), (2, "x" + "\n" * 1_100_000 + "y"), (3, "plain")]
    ids_of = {d: [*lib.encode(t, add_special_tokens=False).ids, 0] for d, t in rows}
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert check_pieces(got, ids_of)[0] == 0


def test_least_squares_fills_windows_exactly():
    lengths = [700] * 10 + [324] * 10 + [300] * 9 + [124] * 3
    got = packing.pack_block(lengths, 1024)
    by_seq = defaultdict(list)
    for d, start, n, s, o in got:
        by_seq[s].append(n)
    assert sum(sum(v) == 1024 for v in by_seq.values()) >= 13
    assert sum(map(sum, by_seq.values())) == sum(lengths)
    combos = packing.combinations_filling(1024)
    assert set(combos.sum(axis=1)) == {1024}
    h = np.zeros(1025)
    h[[700, 324, 300, 124]] = 10, 10, 9, 3
    x = packing.solve_counts(h, combos)
    assert (x >= 0).all()
    fit = np.zeros(1025)
    for c, n in zip(combos, x):
        for k in c[c > 0]:
            fit[k] += n
    assert np.abs(fit[[700, 324, 300, 124]] - [10, 10, 9, 3]).max() < 0.2

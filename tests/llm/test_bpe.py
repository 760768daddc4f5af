import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm import bpe, byte_bpe, common

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a b\n", "x\u00a0 y", "x \u00a0y", "don't  we'll 'S", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext| >", "\x1c a \x1f b", "a\u0085 b \u2028 c", "日本語 テキスト 😀 👩‍👩‍👧", "a" * 70 + " " + "ab" * 500, "1234567 12 ½ ²", "\t\tif x:\r\n  y", "!!!!! ?? ...  --", "e\u0301 \u200b x", "\u180e a", "<|endoftext|> <|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text, **how):
    data = byte_bpe.encode_bytes(PATH, text, **how)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def texts():
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "a", "the", "'s", "Straße", "é", "9", "%", "\u00a0", "\x1d", "<|endoftext|>", "😀", "\u0085", "ß", "中"]
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(400)]


@pytest.mark.parametrize("by_library", [False, True])
def test_same_ids_as_the_library(library, by_library):
    for t in texts():
        assert ids_of(t, by_library=by_library) == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("by_library", [False, True])
@pytest.mark.parametrize("text", ["x" + " " * 3_000_000 + "y", "x" + "\n" * 1_100_000 + "y", "a \t" * 100_000, "中文" * 50_000 + " \n" * 9000])
def test_very_long_white_space(library, text, by_library):
    assert ids_of(text, by_library=by_library) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("by_library", [False, True])
def test_every_code_point_is_classed_alike(library, by_library):
    pts = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c % 3 == 0 or c < 0x3000 and not 0xD800 <= c < 0xE000]
    for i in range(0, len(pts), 400):
        t = "".join(f"a{chr(c)}1{chr(c)} b" for c in pts[i : i + 400])
        assert ids_of(t, by_library=by_library) == library.encode(t, add_special_tokens=False).ids, hex(pts[i])


def test_heap_and_scan_agree():
    b = byte_bpe.ByteBPE(PATH)
    rng = random.Random(2)
    for _ in range(200):
        part = [b.byte_id[x] for x in "".join(rng.choice("aehinorst ") for _ in range(rng.randint(2, 120))).encode()]
        assert b._scan(part[:]) == b._heap(part[:])


def test_table_that_overflows(library):
    b = byte_bpe.ByteBPE(PATH)
    small = byte_bpe.ChunkTable(b.encode_plain, limit=3)
    t = "one two three four five one two six seven one"
    got = small.plain(t)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == library.encode(t).ids
    assert len(small) <= 3


def test_whole_table_and_edge_rows(spark, sf, library):
    docs = common.table(spark, sf, "documents")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, " a "), (-3, "x" * 300000), (-3, "x" * 300000)], "doc_id long, text string")
    both = common.documents(docs).unionByName(extra).selectExpr("*", "0 as n_tokens", "array(1) as ids")
    got = sorted(map(tuple, bpe.round_trip_digests(both, PATH).collect()), key=repr)
    want = []
    for r in both.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    again = bpe.decode_documents(bpe.encode_documents(both, PATH), PATH)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in both.collect()), key=repr)
    assert bpe.round_trip_digests(both.limit(0), PATH).count() == 0

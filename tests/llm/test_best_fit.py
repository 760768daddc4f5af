import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folioforge.llm import best_fit, common, queries, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Rooms left by the same rules, piece after piece: large ones matched, the rest into the tightest gap."""
    large = sorted(n for n in lengths if 3 * n > capacity)
    rooms = []
    while large:
        a = large.pop()
        fit = [n for n in large if n <= capacity - a]
        if fit:
            large.remove(fit[-1])
        rooms.append(capacity - a - (fit[-1] if fit else 0))
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - s)
    return sorted(rooms)


def unrolled(plan):
    out = defaultdict(list)
    seen = Counter()
    for length, number, each, bins, first, offset in plan:
        assert number == seen[length]
        seen[length] += each * bins
        for b in range(bins):
            out[first + b] += [(offset + k * length, length) for k in range(each)]
    return out, seen


def test_classes_pack_as_piece_after_piece():
    rnd = random.Random(5)
    for capacity in (1, 2, 3, 7, 30, 100, 1000):
        for _ in range(60):
            top = rnd.choice([capacity, max(1, capacity // 3), max(1, capacity // 8)])
            lengths = [rnd.randint(1, top) for _ in range(rnd.randint(0, 120))]
            plan, bins = best_fit.solve(Counter(lengths), capacity)
            seqs, seen = unrolled(plan)
            assert seen == Counter(lengths) and set(seqs) == set(range(bins))
            rooms = []
            for parts in seqs.values():
                at = 0
                for offset, n in sorted(parts):
                    assert offset == at
                    at += n
                assert at <= capacity
                rooms.append(capacity - at)
            assert sorted(rooms) == one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_counts():
    few, _ = best_fit.solve({n: 3 for n in range(1, 4097)}, 4096)
    many, bins = best_fit.solve({n: 3_000_000_000 for n in range(1, 4097)}, 4096)
    assert len(many) <= 2 * len(few) + 4096 and bins >= sum(range(4097)) * 3_000_000_000 // 4096


def check(rows, ids_of, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            data = np.array(ids_of[d][at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(data)) and (r.length == capacity or k == len(pieces) - 1)
            if "ids" in r:
                assert bytes(r.ids) == data
            at += r.length
        assert at == len(ids_of[d])
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_seq)


def test_whole_table(spark, sf):
    lib = Tokenizer.from_file(PATH)
    ids_of = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in common.table(spark, sf, "documents").collect()}
    n = check(queries.op13_best_fit(spark, sf).collect(), ids_of, 4096)
    lengths = [min(4096, len(i) - s) for i in ids_of.values() for s in range(0, len(i), 4096)]
    assert n == len(one_by_one(lengths, 4096)) and n <= sum(lengths) / 4096 + 3


def test_edge_rows(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b" * 40000), (None, "null id"), (5, "日本 <|endoftext|> İstanbul é é 😀 x y"), (6, "x" + " " * 2_000_000 + "y")]
    rows += [(i, "Word's 12, " * (i % 37)) for i in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as task", "2 as length", "3 as ids").repartition(7)
    ids_of = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    for capacity in (4096, 50, 1):
        check(best_fit.pack_best_fit(df, PATH, capacity).collect(), ids_of, capacity)
    assert best_fit.pack_best_fit(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(7, "same text")] * 5000, "doc_id long, text string").repartition(5)
    got = best_fit.pack_best_fit(twice, PATH, with_ids=False).collect()
    assert len(got) == 5000 and len({(r.sequence_id, r.offset) for r in got}) == 5000


def test_ids_are_the_librarys():
    lib, own = Tokenizer.from_file(PATH), word_bpe.loaded(PATH)
    ids = lambda s: np.frombuffer(own.encode(s), "<u4").tolist()
    rnd = random.Random(3)
    kinds = ["abcdefghijklmnopqrstuvwxyz' ", "ABCdéß ÄÖŸ—“.,;:'s'T 09²½", "".join(map(chr, range(1, 0x250))), "漢字かなカナー 한국 हिन्दी", "éö  　😀\x1c x"]
    for _ in range(4000):
        s = "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 50)))
        assert ids(s) == lib.encode(s, add_special_tokens=False).ids, s
    for s in list(lib.get_vocab())[::7]:
        assert ids(s) == lib.encode(s, add_special_tokens=False).ids, s

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    vals = [row[0], row[1], row[2], row[3], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def tree(hexes):
    """All levels, bottom up."""
    levels = [hexes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 8 * 8
        out.append((nodes[lo:i], nodes[i + 1 : lo + 8]))
        i //= 8
    return out


def brute(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        trees[lang] = tree([x[2] for x in by_lang[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, own, r) in enumerate(by_lang[lang]):
            path = proof(trees[lang], i) + proof(top, k)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf(r, text)
            for a, b in path:
                now = h("".join(a) + now + "".join(b))
            out.append((r[0], own, trees[lang][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in path)), now, now == top[-1][0]))
    return out


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "pos": F.lit(2), "digest": F.lit("x"), "_p": F.lit(3)})
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = F.when(touched, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.prove(merkle.build_manifest(docs, changed), **kw)


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [{"en": 5200, None: 9, "": 1, "é": 513, "fr": 512}, {"en": 1}, {None: 8}, {f"l{i:03d}": 1 + i % 3 for i in range(600)}])
def test_equals_brute_force(spark, sizes):
    rnd = random.Random(4)
    rows = [(n, rnd.choice(["web", None]), lang, rnd.choice([7, None]), rnd.choice(["Some Text", "lower", None, "", "ÄÖ X" * 40])) for lang, k in sizes.items() for n in rnd.sample(range(-50, 9000), k)]
    rnd.shuffle(rows)
    got = [tuple(r) for r in run(spark, rows, with_paths=False).select(COLS).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert len({r[3] for r in got}) == 1


def test_edge_rows(spark):
    rows = [(1, "s", "en", 1, "A"), (1, "s", "en", 1, "A"), (1, "s", "en", 1, "B"), (None, None, None, None, None), (None, "s", "en", 2, "Q"), (9, "s", "en", 5_000_000, "Long " * 1_000_000)]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in run(spark, rows).select(COLS).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.prove(merkle.build_manifest(docs)).count() == 0


def test_paths_fold_up_and_little_is_stored(spark):
    rows = [(i, "s", "en" if i % 3 else "fr", i, f"text {i}") for i in range(3000)]
    manifest = merkle.build_manifest(spark.createDataFrame(rows, SCHEMA))
    for r in merkle.prove(manifest).collect():
        assert merkle.refold(r.leaf, [(p.before, p.after) for p in r.path]) == r.root and r.verified
    assert [level.count() for level in manifest.levels] == [4 + 2, 1 + 1]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select {', '.join(COLS)} from ({queries.oracle_sql()['op12_merkle_manifest']})").fetchall()
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, sf).select(COLS).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(not r[-1] for r in got) < len(got)

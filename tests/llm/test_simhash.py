import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import common, simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{row: smallest row index reachable} by all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_whole_table_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = docs.orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, brute_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_planted_links_whatever_the_plan(spark):
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(60):
        f = int(rng.integers(0, 2**63))
        fps.append(f)
        for _ in range(int(rng.integers(0, 12))):
            f = int(fps[-1])
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps)
    for limit in (64, 2):  # the second sends nearly all the long way
        comps = {r.node: r.root for r in simhash.connected_components(simhash.links(table, 2, limit)).collect()}
        got = [comps.get(x, x) for x in signed]
        groups = lambda labels: {frozenset(i for i, y in enumerate(labels) if y == x) for x in set(labels)}
        assert groups(got) == groups(want)


def test_thresholds_obey_the_pigeonhole_sum():
    half = np.full((64, 64), 0.25)
    np.fill_diagonal(half, 0.5)
    for n in (100, 10**6, 10**10):
        plan = simhash.plan_parts(n, half * n, 2)
        assert sum(t + 1 for t, _ in plan) == 3
        bits = [b for _, own in plan for b in own]
        assert len(bits) == len(set(bits))


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (None, "", "q"), (4, "One two", "q"), (4, "oNe\ttwo", "q"), (5, "é " * 70000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    zero = "0" * 16
    assert got[:4] == [(0, zero, 1), (1, zero, 1), (2, zero, 1), (3, zero, 1)]
    assert got[4] == got[5] and got[4][2] == 4
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.keep_one_of_each(df).collect()) == [0, 1, 4, 5]
    assert simhash.keep_one_of_each(df).columns == df.columns
    assert df.filter(F.col("doc_id") == 4).count() == 2


def test_rows_that_share_an_id_are_judged_apart(spark):
    rows = [(1, "one two three", "a"), (2, "ONE two  three", "b"), (2, "quite another text of its own", "c"), (3, "one Two three", "d"), (2, "quite another text of its  own", "e"), (1, "a third text with its words", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "1 as row")
    got = simhash.keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.key) for r in got.collect()) == [(1, "a"), (1, "f"), (2, "e")]

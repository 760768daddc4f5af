import math
import random

import duckdb
import pytest

from folioforge.llm import hard_negatives, queries

COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>"
TOP = (1 << 63) - 1


def brute(rows, k=5):
    usable = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in usable:
        if a is None or a % 100:
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(q, v)), -TOP - 1), TOP), i is None, i or 0, lab) for i, lab, v in usable]
        near = sorted(x[:3] for x in scored if x[3] == label and (x[1] or x[2] != a))[:k]
        for s, null, i in near:
            far = sorted(x[:3] for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, None if null else i, n + 1, None if x[1] else x[2], -s, -x[0]) for n, x in enumerate(far)]
    return sorted(out, key=repr)


def mined(df, **kw):
    return sorted((tuple(r) for r in hard_negatives.mine(df, **kw).select(COLS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as block", "'x' as q").repartition(3)


@pytest.mark.parametrize("kind", ["random", "ties", "near"])
def test_equals_brute_force(spark, kind):
    rnd = random.Random(kind)
    base = [[rnd.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    vec = {
        "random": lambda: [rnd.gauss(0, 0.2) for _ in range(20)],
        "ties": lambda: [rnd.choice([0.0, 0.01, -0.01, 1.0]) for _ in range(5)],
        "near": lambda: [x + rnd.gauss(0, 0.05) for x in rnd.choice(base)],
    }[kind]
    rows = [(i, rnd.randint(0, 3), vec()) for i in range(0, 2000, 5)]
    want = brute(rows)
    assert want and mined(frame(spark, rows), block_rows=64) == want
    assert mined(frame(spark, rows)) == want


def test_joined_without_broadcast(spark):
    rnd = random.Random(8)
    rows = [(i, i % 3, [rnd.gauss(0, 1) for _ in range(9)]) for i in range(0, 1500, 4)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert mined(frame(spark, rows), block_rows=50) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, 1, [1.0, 2.0]), (100, 1, [1.0, 2.0]), (200, 1, [1.0]), (300, 2, []), (400, None, [1.0]), (500, 1, None), (600, 1, [None, 1.0]), (700, 1, [nan]), (800, 1, [inf, 1.0])]
    rows += [(None, 1, [1.0, 1.0]), (None, 2, [1.0, 0.9]), (1, 2, [1.0, 0.9]), (1, 2, [1.0, 0.9]), (2, 2, [0.5]), (3, 1, [-1.0, -1.0]), (4, 3, []), (5, 2, [0.0, 0.0, 7.0]), (-300, 1, [0.9, 1.9])]
    assert mined(frame(spark, rows)) == brute(rows) != []
    rows += [(900, 4, [1e30, 1.0]), (6, 4, [1e30]), (7, 4, [1e300]), (8, 5, [1e300, 2.0]), (9, 5, [-1e30]), (1000, 5, [40000.5, -3e9, 2e7]), (10, 5, [40000.5, -3e9, 2e7]), (11, 6, [40000.25, -3e9, 2e7])]
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, rows).limit(0)) == []
    assert mined(frame(spark, [(i, 1, [1.0]) for i in range(0, 900, 50)])) == []


def test_bounds_shrink_the_candidates():
    import numpy as np

    rnd = np.random.default_rng(1)
    cells = rnd.integers(-40, 40, (32, 3000)) * np.linspace(4, 0.2, 32)[:, None].astype(int)
    block = hard_negatives.Columns(cells, 200.0)
    q = np.arange(32, 0, -1) * 5.0
    score = q.astype(int) @ cells
    for a, z in ((score.max() // 2, score.max()), (-100, 100)):
        rows, got = hard_negatives.scan(block, q, np.arange(3000), [(int(a), int(z))])
        want = np.flatnonzero((score >= a) & (score <= z))
        assert rows.tolist() == want.tolist() and got.tolist() == score[want].tolist()
    rows, got = hard_negatives.scan(block, q, np.arange(3000), [(hard_negatives.LEAST, hard_negatives.MOST)], 5)
    assert len(rows) < 50 and set(np.argsort(-score)[:5]) <= set(rows.tolist())


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"select {', '.join(COLS)} from ({queries.oracle_sql()['op11_hard_negatives']})").fetchall(), key=repr)
    got = sorted((tuple(r) for r in queries.op11_hard_negatives(spark, sf).select(COLS).collect()), key=repr)
    assert got == want and got

from collections import Counter

from folioforge.llm import exact_dedup


def test_misra_gries_keeps_what_is_frequent():
    stream = [b"a"] * 400 + [bytes([i % 250, i // 250]) for i in range(600)] + [b"a"] * 100
    held = Counter()
    for i in range(0, len(stream), 50):
        held.update(stream[i : i + 50])
        held = exact_dedup.misra_gries(held, 9)
    assert len(held) <= 9
    assert 500 - 1100 / 10 <= held[b"a"] <= 500


def test_small_table_both_ways(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a\n b"), (1, None), (2, " "), (None, ""), (7, "x"), (7, "x"), (8, "é" * 200000)]
    df = spark.createDataFrame(rows * 1, "doc_id long, text string").selectExpr("*", "'z' as digest", "1 as kept")
    for heavy in (1, 2048):  # all by shuffle, and all by broadcast
        got = exact_dedup.exact_dedup(df, heavy).collect()
        assert len(got) == 9
        by = {(r.doc_id, r.kept): (r.keep_id, r.group_size) for r in got}
        assert by[(9, True)] == (9, 3) and by[(5, False)] == (9, 3) and by[(3, False)] == (9, 3)
        assert by[(2, True)] == (2, 3) and by[(1, False)] == (2, 3) and by[(None, False)] == (2, 3)
        assert by[(7, True)] == (7, 2) and by[(7, False)] == (7, 2)
        assert by[(8, True)] == (8, 1)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    kept = exact_dedup.keep_first_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 8, 9]


def test_rows_that_share_an_id_are_judged_apart(spark):
    rows = [(1, "a b c", "x"), (2, "own text", "x"), (2, "abc", "x"), (2, "own  text", "y"), (3, "abc", "x"), (4, None, "x"), (4, "", "y"), (4, "z", "z"), (None, "z", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "1 as row", "'k' as n")
    got = exact_dedup.keep_first_copies(df)
    assert got.columns == df.columns
    left = sorted(((r.doc_id or 0, r.text or "") for r in got.collect()))
    assert left == [(0, "z"), (1, "a b c"), (2, "own  text"), (4, ""), (4, "z")]

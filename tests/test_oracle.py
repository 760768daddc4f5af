"""Every query of the library proper against its DuckDB twin."""

import os

import duckdb
import pytest

from folioforge.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(cols).collect()]
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["c1_section_chunks", "p2_item_windows", "x2_numbered_blocks", "k15_dedupe_normalized"])
def test_rows_do_not_depend_on_partitions(spark, sf, name):
    seen = set()
    for n in ("1", "16"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.add(repr(sorted(map(repr, QUERIES[name](spark, sf).collect()))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1

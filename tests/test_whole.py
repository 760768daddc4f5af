"""Queries over all of their tables: what a constant set of ids would leave out."""

import difflib
import random

import duckdb
from pyspark.sql import functions as F

from folioforge import session
from folioforge.operators import blocks, catalog, citations, lines, packing, retrieval
from folioforge.plans import registry
from folioforge.sources import io


def test_queries_grow_with_the_table_and_fill_several_blocks(spark, sf, monkeypatch):
    sf = sf.replace("0.001", "0.1")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    got = {tuple(r) for r in registry.queries()["r1_cosine_topk"](spark, sf).select("query_id", "rank", "id").collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = set(con.execute(f"select query_id, rank, id from ({registry.oracle_sql()['r1_cosine_topk']})").fetchall())
    asked = con.execute("select count(*) from embeddings where vec_id % 100 = 0").fetchone()[0]
    assert got == want and len({q for q, _, _ in got}) == asked > 2 * 7


def test_components_of_the_whole_table(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = registry.queries()["k16_group_components"](spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    assert {tuple(r) for r in got} == set(con.execute(registry.oracle_sql()["k16_group_components"]).fetchall())
    assert sum(len(r.members.split(",")) for r in got) == con.execute("select count(*) from benchmark").fetchone()[0] > 60


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as id")
    got = catalog.number_rows(rows, "n", F.desc("id"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, 1000 - i) for i in range(1000)]
    assert catalog.number_rows(rows.limit(0), "n", "id").count() == 0


def test_lines_give_every_documents_overview(spark, sf):
    rows = registry.queries()["k13_kb_lines"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    by_id, kbs = {r.doc_id: r for r in rows}, {}
    for r in sorted((r for r in rows if r.place), key=lambda r: r.place):
        kbs.setdefault(r.kb_id, []).append(r)
    for r in registry.queries()["k13_kb_overview"](spark, sf).collect():
        own = by_id[r.doc_id]
        assert r.overview == "\n".join([*(x.line for x in kbs.get(own.kb_id, []) if x.doc_id != r.doc_id), own.own_line])


def test_windows_do_not_depend_on_the_cut_into_stretches():
    rng = random.Random(5)
    for _ in range(2000):
        cap, joiner = rng.randint(1, 30), rng.choice([0, 0, 2])
        w = [rng.choice([0, 1, 3, 7, rng.randint(0, 40)]) for _ in range(rng.randint(1, 40))]
        cuts = sorted(rng.sample(range(1, len(w)), min(len(w) - 1, rng.randint(0, 5))))
        parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        tables = [dict(zip(("need", "windows", "used", "total"), packing._table(x, cap, joiner)), p=i) for i, x in enumerate(parts)]
        starts = packing._entries(tables, cap)
        got = [k for x, e in zip(parts, starts) for k in packing._from(x, e["window"], e["used"], cap, joiner)]
        assert got == packing._greedy(w, cap, joiner)
        assert all(len(t["need"]) <= cap + 2 for t in tables)


def test_exchanges_by_document_grow_with_the_files(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = lambda: lines.explode_lines(docs).select(F.spark_partition_id()).distinct().count()
    few = parts()
    monkeypatch.setattr(session, "PART_BYTES", 5000)
    assert few <= spark.sparkContext.defaultParallelism and parts() > 30
    assert lines.explode_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).count() == 2


def test_top_k_does_not_depend_on_how_much_a_task_holds(spark, sf, monkeypatch):
    run = lambda: {tuple(r) for r in registry.queries()["r1_cosine_topk"](spark, sf).collect()}
    want = run()
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(retrieval, "KEPT_ROWS", 50)
    assert run() == want and want


def test_overviews_are_dealt_out_by_their_bytes(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id", "case when id % 10 = 9 then null else 'k' end as kb_id", "concat('n', id) as name", "cast(null as string) as title", "'' as digest", "id % 3 <> 0 as enabled", "'p' as preset_id", "id % 2 = 0 as organized", "cast(id div 2 as string) as created_at")
    asked = docs.selectExpr("id as doc_id")
    line = lambda r, own="": f"- 《{r.name}》 ｜ doc_id={r.id}{own}"
    held = [r for r in docs.collect() if r.kb_id]
    shown = sorted((r for r in held if r.enabled and r.organized), key=lambda r: (r.created_at, r.id))
    want = {r.id: "\n".join([*(line(x) for x in shown if x.id != r.id), line(r, "（本文档）")]) for r in held}
    monkeypatch.setattr(catalog, "OVERVIEW_BYTES", 100_000)
    for n, most in ((256, 1 << 20), (7, 0), (1, 0)):
        monkeypatch.setattr(catalog, "OVERVIEW_LINES", n)
        monkeypatch.setattr(catalog, "BROADCAST_BYTES", most)
        got = catalog.kb_overview(docs, asked)
        assert {r.doc_id: r.overview for r in got.collect()} == want
        if most:
            assert got.select(F.spark_partition_id()).distinct().count() > 20


def test_line_ends_of_files_stay_apart(spark, tmp_path):
    texts = [(0, "a\nb"), (3, "aa\n\nea\n"), (2, "a\n"), (5, "xe\n"), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in registry.queries()["s1_decode_markdown"](spark, str(tmp_path)).collect()}
    assert got == {i: t and t.replace("e", "\n").replace("a", "\n") for i, t in texts}


def test_a_large_group_lies_in_no_single_row(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).selectExpr("case when id % 3 = 0 then null else 'hot' end as source", "id as doc_id", "id * 37 % 90 as tokens")
        got = packing.pack_windows(rows, "source", "doc_id", F.col("tokens"), 200)
        found = {}
        for r in got.orderBy("doc_id").collect():
            found.setdefault(r.source, []).append((r.tokens, r.window_id))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert {k: len(v) for k, v in found.items()} == {None: 1000, "hot": 2000}
    for v in found.values():
        assert [n for _, n in v] == packing._greedy([t for t, _ in v], 200, 0)


def test_windows_over_ranges_and_over_whole_keys_agree(spark):
    rows = spark.range(5000).selectExpr("case when id % 5 = 0 then null else id % 3 end as source", "id as doc_id", "id * 37 % 90 as tokens").repartition(6)
    small, large = ({tuple(r) for r in packing.pack_windows(rows, "source", "doc_id", F.col("tokens"), 200, whole=n).collect()} for n in (50_000, 100))
    assert small == large and len(small) == 5000


def test_similar_names_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé图") for _ in range(rng.randint(0, 9)))
    names = sorted({(d, word()) for _ in range(400) for d in "xy"})
    asked = [(rng.choice("xyz"), word()) for _ in range(300)] + [("x", None), (None, "ab"), ("x", "aéaéaéaé!"), ("x", "aéaéaéaé!")]
    want = []
    for d, n in asked:
        own = [b for a, b in names if a == d]
        close = [n] if n in own else difflib.get_close_matches(n, own, n=1, cutoff=0.6) if n is not None else []
        want.append((d, n, close[0] if close else None))
    refs, manifest = spark.createDataFrame(asked, "dir string, name string"), spark.createDataFrame(names, "dir string, name string")
    for size in (512, 3):
        got = [tuple(r) for r in citations.resolve_images(refs, manifest, 0.6, size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_few_pairs_are_scored_and_sorted(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HEAD", 6)
    vec = lambda n, seed: "array(" + ", ".join(f"randn({seed + i})" for i in range(n)) + ")"
    rows = spark.range(6000).selectExpr("id", "concat('k', id % 3) as kb_id", "id as doc_id", f"case when id % 1000 = 7 then array(1e-80D, 2e-80D) when id % 3 = 2 then {vec(8, 0)} else {vec(5, 200)} end as embedding")
    q = rows.filter("id % 300 in (0, 2, 7)").selectExpr("id as query_id", "embedding as vec", "case when id % 2 = 0 then array(kb_id) else array() end as kb_ids")
    rows, q = session.materialize(rows), session.materialize(q)
    pairs = retrieval._sql_pairs(q, rows, 3).filter("size(vec) = 5")
    assert pairs.count() < q.filter("size(vec) = 5").count() * 4000 / 4
    found = [{tuple(r) for r in retrieval.cosine_topk(q, rows, 3, method=m).collect()} for m in ("sql", "arrow")]
    assert found[0] == found[1] and len(found[0]) == 3 * q.count()


def test_similar_names_with_digits(spark):
    rng = random.Random(5)
    kinds = ("img_in_chart_box_{}_{}.jpg", "img_in_image_box_{}_{}.jpg", "p{}_{}", "{}{}", "😀{}é{}.png", "scan {} of {}", "{}_{}_a_b_c_d_e_f_g_h")
    word = lambda: rng.choice(kinds).format(rng.randrange(10 ** rng.randint(1, 12)), rng.randrange(30))
    names = sorted({(d, word()) for _ in range(300) for d in "xy"})
    near = lambda n: "".join(rng.choice("0123456789") if c.isdigit() and rng.random() < 0.1 else c for c in n).replace("chart", "image")
    asked = sorted({(rng.choice("xy"), near(n) if i % 3 else word()) for i, (_, n) in enumerate(names)}) + [("x", ""), ("x", None)]
    refs, manifest = spark.createDataFrame(asked, "dir string, name string"), spark.createDataFrame([*names, ("x", None), (None, "1")], "dir string, name string")
    for cutoff, size in ((0.85, 512), (0.85, 7), (0.6, 512)):
        want = []
        for d, n in asked:
            own = [b for a, b in names if a == d]
            close = [n] if n in own else difflib.get_close_matches(n, own, n=1, cutoff=cutoff) if n is not None else []
            want.append((d, n, close[0] if close else None))
        assert sum(w[2] not in (None, w[1]) for w in want) > 50
        assert sorted(map(tuple, citations.resolve_images(refs, manifest, cutoff, size).collect()), key=repr) == sorted(want, key=repr)


def test_like_names_meet_by_their_digits(spark):
    rows = spark.range(100_000, 104_000).selectExpr("id % 2 as dir", "concat('_box_', id, '_', id * 7 % 100, '.jpg') as name")
    refs, manifest = (rows.selectExpr("dir", f"concat('img_in_{kind}', name) as name") for kind in ("image", "chart"))
    assert citations.near_candidates(refs, manifest, 0.85).count() < 4 * 4000


def test_titles_without_text_are_those_of_the_sql(spark, tmp_path):
    texts = ["", " \n ", None, "A.", "a\n  b\n", " " * 45 + "late", "\n" * 41 + "z", "b\n@@end\n@@title\nc", "@@@-@\n" * 9]
    rows = [(5 * i + k, lang, source, t) for i, t in enumerate(texts) for k, lang, source in ((0, "en", "s"), (1, "en", "s"), (2, None, "s"), (3, "", None))]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["d14_harvest_title_digest"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(registry.oracle_sql()["d14_harvest_title_digest"]).fetchall()) and len(got) == len(rows)


def test_blocks_without_text_count_where_asked(spark):
    parts = spark.createDataFrame([(1, 1, "@@title\n \n@@end\n@@TITLE\nT\n@@end\nx"), (2, 1, "@@title\n@@end\n@@digest\nD")], "doc_id long, part int, text string")
    for empty, want in ((False, {(1, "T", None), (2, None, None)}), (True, {(1, "", None), (2, "", None)})):
        cleaned, info = blocks.harvest_title_digest(parts, empty)
        assert {tuple(r) for r in info.collect()} == want
        assert {tuple(r) for r in cleaned.collect()} == {(1, 1, "x"), (2, 1, "")}


def test_names_of_pages_do_not_wait_for_their_text(spark, tmp_path):
    pages = ["<title>A.</title><p>short</p>", None, "", "<title> x &amp; y </title>", "<p>" + "w " * 100, "<title>big</title>" + "w" * io.MAX_BYTES, "<title>" + "n" * 130 + "</title>"]
    spark.createDataFrame([(i, f"https://www.h{i}.org/x", h) for i, h in enumerate(pages * 3)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in registry.queries()["s5_page_names"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == set(con.execute(f"select url, name, title, error from ({registry.oracle_sql()['s5_page_names']})").fetchall()) and len(got) == 21
    errors = {r.url: r.error for r in registry.queries()["s5_ingest_pages"](spark, str(tmp_path)).collect()}
    assert errors["https://www.h7.org/x"] == "未能抽取到正文" and errors["https://www.h5.org/x"].startswith("网页过大")

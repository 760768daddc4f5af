"""Hand-made cases with known answers."""

import json
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as t
from folioforge.operators import blocks, catalog, chunks, citations, conversations, lines, packing, retrieval
from folioforge.sources import io


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_tokens(spark):
    cases = {"": 0, "abcdefg": 2, "abc": 0, "中文": 1, "中文，好": 3, "中a": 1}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", t.estimate_tokens(F.col("s")).alias("n"))
    assert {r.s: r.n for r in df.collect()} == cases


def test_tail(spark):
    long = "a" * 1500 + "\n" + "b" * 2000
    df = one(spark, long).select(t.tail_by_tokens(F.col("text"), 300).alias("x"), t.tail_by_tokens(F.col("text"), 10).alias("y"), t.tail_by_tokens(F.col("text"), 10**6).alias("z"))
    r = df.first()
    assert r.x == "b" * 1000 and r.y == "b" * 1000 and r.z == long
    near = "c" * 3000 + "\n" + "d" * 990
    assert one(spark, near).select(t.tail_by_tokens(F.col("text"), 300).alias("x")).first().x == "d" * 990


def test_numbering_is_as_given_and_idempotent(spark):
    text = "### Early\n## A\n#### Deep\n### 7.3 B\n## 2024 Report\n```\n## X\n```\n#No\n##NoSpace\n##### five"
    want = "### 0.1 Early\n## 1 A\n#### 1.0.1 Deep\n### 1.1 B\n## 2 Report\n```\n## X\n```\n#No\n##NoSpace\n##### five"
    got, _ = lines.number_headings(one(spark, text))
    assert got.first().text == want
    assert lines.number_headings(got)[0].first().text == want


def test_page_blocks(spark):
    got = lines.page_blocks(one(spark, "pre\n<!-- page:1 -->\na\n<!-- page:3 -->\nb")).orderBy("ord").collect()
    assert [(r.page_no, r.text) for r in got] == [(None, "pre"), (1, "<!-- page:1 -->\na"), (3, "<!-- page:3 -->\nb")]
    assert [(r.page_no, r.text) for r in lines.page_blocks(one(spark, "x")).collect()] == [(None, "x")]
    assert lines.page_blocks(one(spark, " ")).count() == 0


def test_strip_markers(spark):
    r = lines.strip_page_markers(one(spark, "a\n\n<!-- page:2 -->\n\nb <!-- page:3 -->")).first()
    assert (r.text, r.n_stripped) == ("a\n\nb", 2)


def test_packing(spark):
    df = spark.createDataFrame([([40, 50, 20, 120, 10],)], "w array<int>")
    assert df.select(packing.pack(F.col("w"), 100).alias("x")).first().x == [0, 0, 1, 2, 3]


def test_blocks(spark):
    b, residue = blocks.parse_blocks(one(spark, "x\n@@end\n@@summary 1\nA\n@@tip 2\nB\n@@END\ny\n@@tip 3\nC"))
    assert [(r.type, r.target, r.content) for r in b.collect()] == [("summary", "1", "A\n@@tip 2\nB")]
    assert tuple(residue.first())[1:] == ("x\ny\n@@tip 3\nC", True)


@pytest.mark.parametrize("text, want", [
    ("@@summary\nA\n@@end\nB", "@@summary\nA\n@@end"),
    ("@@summary\nA\n@@tip\nB\n@@end", None),
    ("@@tip\nA\n@@summary\nB\n@@end", "@@tip\nA\n@@summary\nB\n@@end"),
])
def test_last_complete_block(spark, text, want):
    assert blocks.cut_after_last_block(one(spark, text), "summary").first().text == want


def test_coverage(spark):
    items = spark.createDataFrame([(1, n) for n in ("2.1.1", "3", "3.1.2", "3.2", "20", None)], "doc_id long, num string")
    done = spark.createDataFrame([(1, "2"), (1, "3.1")], "doc_id long, num string")
    assert {r.num for r in catalog.remaining_items(items, done).collect()} == {"3", "3.2", "20", None}


def test_long_split(spark):
    p1, p2, p3, big = "a" * 2100, "b" * 2100, "c" * 1050, "d" * 5250
    cut = lambda s: [r.text for r in packing.split_long(one(spark, s)).orderBy("ord").collect()]
    assert cut(f"{p1}\n\n{p2}\n\n{p3}") == [p1, f"{p2}\n\n\n\n{p3}"]
    assert cut(f"{p1}\n\n{p2}") == [p1, f"{p2}\n\n"]
    assert cut(big) == [big]


def test_breadcrumbs(spark):
    h = [(2, "1", "A"), (3, "1.1", "B"), (3, "1.2", "C"), (2, "2", "D"), (3, "2.1", "E"), (2, "3", "F")]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(h)], "doc_id long, ord int, level int, num string, title string")
    ref = {r.num: r.breadcrumb for r in lines.breadcrumbs(df).collect()}
    anc = {r.num: r.breadcrumb for r in lines.breadcrumbs(df, "ancestors").collect()}
    assert ref["2.1"] == "1.2 C > 2 D > 2.1 E" and ref["3"] == "1 A > 2 D > 3 F"
    assert anc["2.1"] == "2 D > 2.1 E" and anc["3"] == "3 F"


def test_citation_numbers(spark):
    b = spark.createDataFrame([(1, 0, 0, "1", "a[[c:2]]b[[c:1]]c[[c:9]]d[[c:3]]")], "doc_id long, part int, ord int, target string, content string")
    r = spark.createDataFrame([(1, 0, "1", n, 7, a, f"N{a}", "", "kb") for n, a in ((1, "x"), (2, "y"), (3, "y"))], "doc_id long, part int, target string, n int, ref_doc long, anchor string, doc_name string, breadcrumb string, kind string")
    texts, entries = citations.number_citations(b, r)
    assert texts.first().content == "a①b②cd①"
    assert [r.line for r in entries.orderBy("idx").collect()] == ["① 《Ny》", "② 《Nx》"]


def test_fragment_numbers(spark):
    rows = [("organized:1", 1), ("organized:1", 2), ("", 1), ("", 1), ("organized:2", 1)]
    df = spark.createDataFrame([(1, i, d, a) for i, (a, d) in enumerate(rows)], "session_id long, seq int, doc_id long, anchor string")
    n = lambda key: [r.n for r in retrieval.number_fragments(df, key).orderBy("seq").collect()]
    assert n("anchor") == [1, 1, 2, 3, 4] and n("doc_anchor") == [1, 2, 3, 4, 5]


def test_history(spark):
    rows = [(1, i, "system" if i == 5 else "user", "" if i == 7 else f"m{i}") for i in range(1, 16)]
    df = spark.createDataFrame(rows, "session_id long, seq int, role string, content string")
    assert [r.seq for r in conversations.history(df).orderBy("seq").collect()] == [i for i in range(3, 15) if i not in (5, 7)]


def test_summary_attribution(spark):
    h = spark.createDataFrame([(1, i, 2, str(i + 1), x) for i, x in enumerate("ABA")], "doc_id long, ord int, level int, num string, title string")
    s = spark.createDataFrame([(1, i, x, "c") for i, x in enumerate("AAX")], "doc_id long, ord int, h2 string, content string")
    assert [r.num for r in blocks.assign_summaries(s, h).orderBy("ord").collect()] == ["1", "3", "2"]


def test_pass2_items(spark):
    big = "\n\n".join(f"{c}" * 400 for c in "abcd")
    text = f"pre\n## 1 A\nsmall\n## 2 B\nintro\n### 2.1 C\nx\n### 2.2 D\n{big}\n## 3 E\n{big}"
    got = [(r.num, r.content[:6]) for r in packing.pass2_items(one(spark, text), 300).orderBy("key").collect()]
    assert got[:4] == [(None, "pre"), ("1", "## 1 A"), ("2", "## 2 B"), ("2.1", "### 2.")]
    assert [n for n, _ in got[4:]] == ["2.2"] * 2 + ["3"] * 2


def test_short_sections_join_their_parent_or_a_lone_short_one(spark):
    long = "w " * 200
    text = f"## A\n{long}\n### B\nshort b\n#### C\nshort c\n## D\n### E\n{long}\n#### F\ntiny"
    got = {r.section_num: r.text for r in chunks.chunk_sections(one(spark, text)).collect()}
    assert got["1"].endswith("\n\n1.1 B\nshort b\n#### 1.1.1 C\nshort c")
    assert "1.1" not in got and got["1.1.1"] == "1.1.1 C\nshort c"  # its parent was taken in, so it stays alone
    assert got["2.1"].endswith("\n\n2.1.1 F\ntiny")


def test_assembly_order(spark):
    docs = spark.createDataFrame([(1, "T", "K", "S", "## A\nbody\n### B\nmore\n\n## C\nend")], "doc_id long, title string, kb_name string, source_name string, text string")
    s = spark.createDataFrame([(1, "1", "sum")], "doc_id long, num string, content string")
    b = spark.createDataFrame([(1, 0, n, f"c{n}", "> H") for n in ("1", "1.1", "2", "9", "x")], "doc_id long, part int, num string, content string, header string")
    e = spark.createDataFrame([(1, 1, "① 《N》")], "doc_id long, idx int, line string")
    got = citations.assemble(docs, s, b, e, toc=False, generated="now").first().text
    assert got == "> [!info] 知识库：K ｜ 源文件：`S` ｜ 生成：now\n\n# T\n\n## 1 A\n\n> [!note] 本节摘要\n> sum\n\nbody\n### 1.1 B\nmore\n\n> H\n> c1.1\n\n> H\n> c1\n\n## 2 C\nend\n\n> H\n> c2\n\n## 引用来源\n\n① 《N》\n"


def test_image_names_and_similar_names(spark):
    refs = spark.createDataFrame([("d", "a_box_12.jpg"), ("d", "exact.png"), ("d", "zzz"), ("e", "exact.png")], "dir string, name string")
    m = spark.createDataFrame([("d", "a_bax_12.jpg"), ("d", "exact.png")], "dir string, name string")
    assert {(r.dir, r.name): r.resolved for r in citations.resolve_images(refs, m).collect()} == {("d", "a_box_12.jpg"): "a_bax_12.jpg", ("d", "exact.png"): "exact.png", ("d", "zzz"): None, ("e", "exact.png"): None}


def test_encodings_and_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿x\r\ny\rz".encode())
    (tmp_path / "b.md").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.md").write_bytes(b"ok \xff\xff\xff")
    got = {r.path[-4:]: (r.text, r.encoding) for r in io.read_markdown(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("x\ny\nz", "utf-8") and got["b.md"] == ("中文", "gb18030") and got["c.md"][1] == "utf-8-replace"
    (tmp_path / "o.jsonl").write_text('{"result":{"layoutParsingResults":[{"markdown":{"text":"one"}}]}}\nnot json\n\n{"result":{"layoutParsingResults":[{"markdown":{"text":"two","images":{"a":"u","b":""}}}]}}')
    pages = io.read_ocr_jsonl(spark, str(tmp_path / "o.jsonl")).orderBy("page_no").collect()
    assert [(r.page_no, r.text, dict(r.images)) for r in pages] == [(1, "one", {}), (2, "two", {"a": "u"})]


def test_chunk_table_and_exports(spark, tmp_path):
    c = spark.createDataFrame([("1", "k1", 1, "t"), ("2", "k2", 2, "t")], "id string, kb_id string, doc_id long, text string")
    path = str(tmp_path / "chunks")
    io.write_chunks(c, path)
    io.write_chunks(c.filter("kb_id = 'k2'").withColumn("text", F.lit("new")), path)
    assert {(r.id, r.text) for r in spark.read.parquet(path).collect()} == {("1", "t"), ("2", "new")}
    io.write_exports(spark.createDataFrame([("k", "a/b?", "body")], "kb_id string, name string, text string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().name == "a_b_"


def test_web_pages(spark):
    html = "<html><head><title> A &amp; B </title></head><body><nav>menu</nav><h1>Head</h1><p>" + "word " * 20 + "</p><ul><li>item</li></ul><script>x</script></body></html>"
    rows = [("http://www.e.org/x", 200, "text/html", html), ("e.org", 200, "text/html", html), ("https://e.org", 404, "text/html", html), ("https://e.org", 200, "image/png", html), ("https://e.org", 200, "text/html", "<p>short</p>"), (None, None, None, None)]
    got = io.ingest_pages(spark.createDataFrame(rows, "url string, status int, content_type string, html string")).collect()
    assert got[0].name == "A & B" and got[0].markdown.startswith("# Head\n\nword word") and got[0].markdown.endswith("- item") and "menu" not in got[0].markdown
    assert all(r.error for r in got[1:]) and got[2].error.endswith("404")


def test_rerank_and_embedding(spark):
    hits = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (2, 1, 12, 0.7)], "query_id int, rank int, id int, score double")
    s = spark.createDataFrame([(1, 1, 1, 0.55555), (1, 2, 7, 0.9), (2, 1, 9, 0.9)], "query_id int, pos int, idx int, relevance double")
    assert [tuple(r) for r in retrieval.apply_rerank(hits, s).orderBy("query_id", "rank").collect()] == [(1, 1, 11, 0.5556), (2, 1, 12, 0.7)]
    df = spark.createDataFrame([(str(i),) for i in range(20)], "text string")
    assert [r.embedding for r in retrieval.embed(df, "text", lambda x: [[float(v)] for v in x]).collect()] == [[float(i)] for i in range(20)]
    with pytest.raises(Exception, match="vectors"):
        retrieval.embed(df, "text", lambda x: [[0.0]]).collect()


def test_document_chunks_follow_the_config(spark):
    docs = spark.createDataFrame([(d, "k", "p", "## A\nbody ![x](i.png)") for d in (1, 2)], "doc_id long, kb_id string, preset_id string, text string")
    arts = spark.createDataFrame([(d, a, f"@@{a} 1\n{a} text\n@@end") for d in (1, 2) for a in ("summary", "tip", "quiz")], "doc_id long, artifact string, text string")
    config = spark.createDataFrame([(1, True, True, ["tip"]), (2, False, False, [])], "doc_id long, summary boolean, images boolean, plugins array<string>")
    got = {(r.doc_id, r.anchor, r.kind) for r in chunks.chunk_documents(docs, arts, config).collect()}
    assert got == {(1, "organized:1", "section"), (1, "summary:1", "summary"), (1, "tip:1", "plugin"), (1, "image:1:i.png", "image"), (2, "organized:1", "section")}


def test_markers_with_unicode_white_space(spark):
    text = "##　第一章\n### 7.3　小节　\n##   Report x\n##​no\n#　no\n##　"
    assert lines.number_headings(one(spark, text))[0].first().text == "## 1 第一章\n### 1.1 小节\n## 2 Report x\n##​no\n#　no\n##　"
    pages = lines.page_blocks(one(spark, "<!--　page: 7　-->　\na\n<!-- page:8 -->")).orderBy("ord").collect()
    assert [r.page_no for r in pages] == [7, 8]
    b, residue = blocks.parse_blocks(one(spark, "@@summary　1\nA\n　@@ END\nx\n@@tip 2.1　\nB\n@@end"))
    assert [(r.type, r.target, r.content) for r in b.orderBy("ord").collect()] == [("summary", "1", "A"), ("tip", "2.1", "B")]
    assert residue.first().text == "x"
    r = spark.range(1).select(t.num_of(F.lit("1.2　题")).alias("a"), t.num_of(F.lit("1.2")).alias("b"), t.unnumbered(F.lit("2024 Report")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("1.2", None, "Report")


def test_titles_with_entities(spark):
    html = {"<TITLE lang=en>Caf&eacute; &mdash; A&nbsp;\n B &#8211; &#x4E2D;&amp;amp; &nosuch; &lt;b&gt;</title><title>two</title>": "Café — A  B – 中&amp; &nosuch; <b>", "<title>　 plain 　</title>": "plain", "none": "", "<title>&nbsp;</title>": ""}
    df = spark.createDataFrame([(k,) for k in html] + [(None,)], "h string").select("h", t.html_title(F.col("h")).alias("t"))
    assert {r.h: r.t for r in df.collect()} == {**html, None: None}


def test_the_tail_of_a_long_text_is_measured_alone(spark):
    df = one(spark, "é" * 4_000_000).select(t.tail_by_tokens(F.col("text"), 500).alias("x"), t.tail_by_tokens(F.col("text"), 600).alias("y"))
    start = time.monotonic()
    r = df.first()
    assert (len(r.x), len(r.y)) == (1000, 2000) and time.monotonic() - start < 30


def test_unfinished_entities_are_resolved_or_stay(spark):
    df = spark.createDataFrame([("<title>the&amp;&amp;&amp</title>",), ("<title>a&notit; &lt;&#65;&#x42;&#67</title>",)], "h string")
    got = [tuple(r) for r in df.select(t.html_title(F.col("h")), t.html_title(F.col("h"), unfinished=False)).collect()]
    assert got == [("the&&&", "the&&&amp"), ("a¬it; <ABC", "a&notit; <AB&#67")]


def test_names_of_pages_keep_unfinished_entities_where_asked(spark):
    html = "<title>the&amp;&amp</title><p>" + "word " * 20 + "</p>"
    df = spark.createDataFrame([("http://e.org/x", 200, "text/html", html)], "url string, status int, content_type string, html string")
    assert [io.ingest_pages(df, u).first()["name"] for u in (True, False)] == ["the&&", "the&&amp"]


def test_search_ranks_by_the_similarity_itself(spark):
    unit = lambda c: [c, (1 - c * c) ** 0.5]
    q = spark.createDataFrame([(1, [2.0, 0.0], []), (2, [0.0, 0.0], []), (3, None, []), (4, [1.0, 0.0, 0.0], None), (5, [1.0, 0.0], ["k2"]), (6, [float("nan"), 1.0], [])], "query_id long, vec array<double>, kb_ids array<string>")
    rows = [("a", "k1", unit(0.80001)), ("b", "k1", unit(0.80004)), ("c", "k1", [0.0, 0.0]), ("d", "k1", None), ("e", "k1", [0.0, 0.0, 3.0]), ("f", "k2", [1.0, None]), ("g", "k2", [-1.0, 0.0]), ("h", "k1", unit(0.80004)), ("i", None, [float("inf"), 0.0])]
    c = spark.createDataFrame([(i, kb, 1, v) for i, kb, v in rows], "id string, kb_id string, doc_id long, embedding array<double>")
    for method in ("arrow", "sql"):
        got = {}
        for k in (1, 2, 20):
            for r in retrieval.cosine_topk(q, c, k, method=method).orderBy("query_id", "rank").collect():
                got.setdefault((k, r.query_id), []).append((r.id, r.score))
        assert got[1, 1] == [("b", 0.8)] and got[2, 1] == [("b", 0.8), ("h", 0.8)], method
        assert got[20, 1] == [("b", 0.8), ("h", 0.8), ("a", 0.8), ("g", -1.0)], method
        assert got[20, 4] == [("e", 0.0)] and got[20, 5] == [("g", -1.0)], method
        assert {x for _, x in got} == {1, 4, 5}
        assert retrieval.cosine_topk(q.limit(0), c, method=method).count() == retrieval.cosine_topk(q, c.limit(0), method=method).count() == 0


def test_equal_vectors_in_a_large_block_are_ordered_by_id(spark):
    c = spark.range(20000).selectExpr("20000 - id as id", "'k' as kb_id", "id as doc_id", "case when id % 3 = 0 then array(1.0, 0.0, 0.0) else array(rand(7), rand(8), rand(9)) end as embedding")
    q = spark.range(3).selectExpr("id as query_id", "array(1.0, 0.0, 0.0) as vec", "cast(array() as array<string>) as kb_ids")
    got = retrieval.cosine_topk(q, c, 5)
    assert {(r.query_id, r["rank"], r.id) for r in got.collect()} == {(i, k + 1, 3 * k + 2) for i in range(3) for k in range(5)}


def test_empty_kb_list_means_all(spark):
    q = spark.createDataFrame([(1, [], True), (2, ["k"], True), (3, ["none"], True), (4, None, True), (5, [], False)], "query_id long, kb_ids array<string>, strict boolean")
    hits = spark.createDataFrame([(i, 1, "a", 0.9) for i in (1, 2, 3)], "query_id long, rank int, id string, score double")
    c = spark.createDataFrame([("a", "k")], "id string, kb_id string")
    got = {r.query_id: r.refused for r in retrieval.refusal_guard(q, hits, c).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: False}
    assert {r.refused for r in retrieval.refusal_guard(q, hits, c.limit(0)).filter("strict").collect()} == {True}


def test_context_heads_and_citation_fields(spark):
    """Names and heads as the original writes them: breadcrumb, else section number, else nothing after the blank."""
    hits = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7)], "query_id long, rank int, id long, score double")
    chunks = spark.createDataFrame(
        [(10, "k", 1, "organized", "2.1", "A > B", "organized:2.1", "t1"), (11, "k", 2, "summary", "3", "", "summary:3", "x" * 200), (12, None, 3, "organized", None, None, None, None)],
        "id long, kb_id string, doc_id long, artifact string, section_num string, breadcrumb string, anchor string, text string",
    )
    docs = spark.createDataFrame([(1, "Doc"), (2, "Two")], "id long, name string")
    assert retrieval.context_text(hits, chunks, docs).first().context == "[1] 【Doc A > B】\nt1\n\n[2] 【Two 3】\n" + "x" * 200 + "\n\n[3] 【文档 】\n"
    got = sorted(retrieval.citations(hits, chunks, docs).collect(), key=lambda r: r.idx)
    assert [(r.doc_name, r.artifact, r.section_num, r.breadcrumb, r.anchor, len(r.text)) for r in got] == [("Doc", "organized", "2.1", "A > B", "organized:2.1", 2), ("Two", "summary", "3", "", "summary:3", 160), ("3", "organized", "", "", "", 0)]


def test_image_names_are_free(spark):
    rels = ["a/x", "b/x", "x_2", "", "..", "c/", "img", "d\\y?.png", "e/y?.png", "x_2_2", "q/x_2", "longer/x"]
    got = {(r.doc_id, r.rel): r.file for r in citations.image_names(spark.createDataFrame([(d, "S", r) for d in (1, 2) for r in rels], "doc_id long, stem string, rel string")).collect()}
    used, want = set(), {}
    for rel in sorted(rels, key=lambda r: (-len(r), r)):
        name = rel.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1] or "img"
        base = "S_" + name.replace("?", "_")
        file, k = base, 1
        while file in used:
            k, file = k + 1, f"{base}_{k + 1}"
        used.add(file)
        want[rel] = file
    assert got == {(d, r): f for d in (1, 2) for r, f in want.items()}
    assert len(set(want.values())) == len(rels)


def test_references_are_rewritten_as_one_after_the_other(spark):
    """Against the plain reading: every image in turn, every spelling, two patterns each over the whole text."""
    import random
    import re
    from urllib.parse import quote, unquote

    def plain(text, names):
        for rel, local, url in sorted(names, key=lambda n: -len(n[0])):
            for v in sorted({rel, quote(rel), unquote(rel)}, key=len, reverse=True) + [url]:
                if v:
                    text = re.sub(rf"!\[[^\]]*\]\(\s*{re.escape(v)}\s*\)", lambda m: f"![]({local})", text)
                    text = re.sub(rf"""src=["']{re.escape(v)}["']""", lambda m: f'src="{local}"', text)
        return text

    rng = random.Random(6)
    rels = ["imgs/a", "imgs/a.png", "imgs/b c.jpg", "图/一(1).png", "x%20y", "imgs/S_1.png", "p)q"]
    rows, images = [], []
    for d in range(60):
        own = [(r, rng.choice([f"imgs/S_{k}.png", "imgs/a"]), rng.choice(["", f"https://h/{k}?a=(1)"])) for k, r in enumerate(rng.sample(rels, rng.randint(0, 6)))]
        spelled = [*rels, *map(quote, rels), *(u for _, _, u in own if u), "other", "imgs/S_2.png"]
        parts = [rng.choice(['![a]({})', '![]( {}\n)', '<img src="{}">', "<img src='{}'/>", "![q]({} ", "({})", 'src="{}', "![x ![y]({})"]).format(rng.choice(spelled)) for _ in range(12)]
        rows.append((d, " ".join(parts)))
        images += [(d, *n) for n in own]
    rows.append((99, None))
    got = {r.doc_id: r.text for r in citations.rewrite_refs(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(images, "doc_id long, rel string, local string, url string")).collect()}
    assert got == {d: t if t is None else plain(t, [n[1:] for n in images if n[0] == d]) for d, t in rows}


def test_few_names_are_compared(spark):
    names = [("d", f"img_in_chart_box_{i}_{i * 7 % 100}.jpg") for i in range(1200)]
    refs = spark.createDataFrame([("d", f"photo {i}.png") for i in range(200)] + [("d", "img_in_image_box_77_39.jpg")], "dir string, name string")
    pairs = citations.near_candidates(refs, spark.createDataFrame(names, "dir string, name string"), 0.85).filter("name like 'photo%'").count()
    assert pairs < 200 * 1200 / 20


def test_first_blocks_of_the_second_pass(spark):
    rows = [(1, 0, "a", "1", ""), (1, 1, "a", "1", "late"), (1, 2, "z", "1", "x"), (1, 3, "a", "2", "y"), (1, 4, "a", "2", "y2")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, target string, content string")
    allowed = spark.createDataFrame([("a",)], "type string")
    kept = lambda **kw: sorted((r.target, r.ord) for r in blocks.keep_first_blocks(df, ["type", "target"], ["ord"], allowed, **kw).collect())
    assert kept() == [("1", 1), ("2", 3)] and kept(skip_empty=False) == [("1", 0), ("2", 3)]
    assert tuple(blocks.dropped_blocks(df, ["type", "target"], ["ord"], allowed).first()) == (1, 1, 1, 1)
    assert tuple(blocks.dropped_blocks(df, ["type", "target"], ["ord"], allowed, skip_empty=False).first()) == (1, 1, 0, 2)


def test_ocr_file_in_many_tasks(spark, tmp_path):
    page = lambda i: json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": f"p{i} " + "x" * (i % 90), "images": {"a": "u", "b": ""}}}] * (1 + i % 2)}})
    (tmp_path / "big.jsonl").write_text("\n".join("{bad" if i % 11 == 5 else "" if i % 13 == 7 else page(i) for i in range(4000)))
    (tmp_path / "small.jsonl").write_text(page(1) + "\n" + page(2))
    want = [f"p{i} " + "x" * (i % 90) for i in range(4000) if i % 11 != 5 and i % 13 != 7 for _ in range(1 + i % 2)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "big.jsonl")).rdd.getNumPartitions() > 10
        pages = io.read_ocr_jsonl(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = sorted((r.page_no, r.text) for r in pages if r.doc_id.endswith("big.jsonl"))
    assert big == list(enumerate(want, 1)) and all(dict(r.images) == {"a": "u"} for r in pages)
    assert sorted((r.page_no, r.text[:2]) for r in pages if r.doc_id.endswith("small.jsonl")) == [(1, "p1"), (2, "p1"), (3, "p2")]


def test_numbers_and_evictions_without_a_window_over_the_key(spark):
    rows = [("s", i, i % 3, "" if i % 5 == 0 else f"a{i * 7 % 4}") for i in range(60)] + [(None, 1, 0, "x"), (None, 0, 0, None)]
    df = spark.createDataFrame(rows, "session_id string, seq int, doc_id int, anchor string")
    for key in ("anchor", "doc_anchor"):
        names, want = {}, {}
        for s, seq, d, a in sorted(rows, key=lambda r: r[1]):
            k = (s, seq) if not a else (s, a) if key == "anchor" else (s, d, a)
            names.setdefault(s, {}).setdefault(k if a else ("own", *k), len(names[s]) + 1)
            want[s, seq] = names[s][k if a else ("own", *k)]
        assert {(r.session_id, r.seq): r.n for r in retrieval.number_fragments(df, key).collect()} == want
    files = [("d", f"n{i}", t) for i, t in enumerate([5, 5, 9, None, 1, None])] + [("e", "only", 1), (None, "x", 1)]
    got = catalog.evict_exports(spark.createDataFrame(files, "doc_id string, name string, mtime int"), 3).collect()
    assert sorted(r.name for r in got) == ["n3", "n4", "n5"]


def test_chunks_are_replaced_where_they_are_read(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(r, "kb_id string, doc_id int, artifact string, text string")
    held = lambda: sorted((r.kb_id or "", r.doc_id, r.artifact, r.text) for r in io.read_chunks(spark, path).collect())
    assert io.read_chunks(spark, path) is None
    first = rows(("k1", 1, "a", "old"), ("k1", 2, "a", "stays"), ("k2", 3, "a", "x" * 9000), (None, 4, "a", "no kb"))
    assert io.replace_chunks(path, first, first.select("doc_id"))
    assert held()[0] == ("", 4, "a", "no kb") and held()[-1] == ("k2", 3, "a", "x" * 8000)
    before, reader = held(), io.read_chunks(spark, path)
    assert io.replace_chunks(path, rows(("k1", 1, "a", "new"), ("k1", 1, "b", "more")), rows(("k1", 1, "", "")).select("doc_id"))
    assert held() == sorted([x for x in before if x[1] != 1] + [("k1", 1, "a", "new"), ("k1", 1, "b", "more")])
    assert sorted((r.kb_id or "", r.doc_id, r.artifact, r.text) for r in reader.collect()) == before
    files = sorted(str(p) for p in (tmp_path / "chunks").rglob("*"))
    assert not io.replace_chunks(path, rows(("k1", 2, "a", "stays")), rows(("k1", 2, "", "")).select("doc_id"))
    assert files == sorted(str(p) for p in (tmp_path / "chunks").rglob("*"))
    before = held()
    broken = rows(("k1", 2, "a", "lost")).withColumn("text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("halfway"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="halfway"):
        io.replace_chunks(path, broken, broken.select("doc_id"))
    assert held() == before
    assert io.replace_chunks(path, rows(), rows(("k2", 3, "", "")).select("doc_id")) and [r[0] for r in held()] == ["", "k1", "k1", "k1"]


def test_summaries_are_assigned_in_linear_time():
    import random
    import time

    def plain(wanted, offered):
        free, out = list(range(len(offered))), []
        for w in wanted:
            at = next((i for i in free if offered[i] == w), free[0] if free else -1)
            if at >= 0:
                free.remove(at)
            out.append(at)
        return out

    rng = random.Random(1)
    for _ in range(500):
        wanted, offered = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert blocks._assign(wanted, offered) == plain(wanted, offered)
    many = [f"t{i % 1000}" for i in range(100_000)]
    began = time.time()
    assert sorted(blocks._assign(many[::-1], many)) == list(range(100_000)) and time.time() - began < 5

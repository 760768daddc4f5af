"""Queries for retrieval and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import blocks, catalog, lines, retrieval
from folioforge.plans import fixtures as fx
from folioforge.plans.fixtures import table
from folioforge.session import materialize

QUERIES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def chunks_of(spark, sf) -> DataFrame:
    """embeddings as chunks: kb = label, document = vec_id by 7; every 31st without a vector, every 37th a zero one."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id as id", "label as kb_id", "vec_id div 7 as doc_id",
        "case when vec_id % 31 = 30 then null when vec_id % 37 = 36 then transform(embedding, x -> cast(0 as float)) else embedding end as embedding", "concat('text of ', vec_id) as text",
        "'organized' as artifact", "case when vec_id % 3 = 0 then null else cast(vec_id % 9 as string) end as section_num", "case when vec_id % 4 = 0 then concat('A > ', vec_id % 5) else '' end as breadcrumb", "concat('organized:', vec_id % 9) as anchor",
    )


CHUNKS = """chunks as (select vec_id as id, label as kb_id, vec_id // 7 as doc_id, case when vec_id % 31 = 30 then null when vec_id % 37 = 36 then list_transform(embedding, lambda x: 0::float) else embedding end as embedding, 'text of ' || vec_id as text, 'organized' as artifact, case when vec_id % 3 = 0 then null else (vec_id % 9)::varchar end as section_num, case when vec_id % 4 = 0 then 'A > ' || (vec_id % 5) else '' end as breadcrumb, 'organized:' || (vec_id % 9) as anchor from embeddings),
asked as (select vec_id // 100 as query_id, embedding as vec, case when vec_id // 100 % 2 = 0 then [] else [label] end as kb_ids, case when vec_id // 100 % 10 = 9 then ' ' else 'question' end as text, vec_id // 100 % 3 = 0 as strict from embeddings where vec_id % 100 = 0)"""


def asked_of(spark, sf) -> DataFrame:
    """Every hundredth vector asks; ids and variants go by vec_id div 100."""
    q = table(spark, sf, "embeddings").filter("vec_id % 100 = 0").selectExpr("vec_id div 100 as query_id", "embedding as vec", "label")
    return q.selectExpr("query_id", "vec", "case when query_id % 2 = 0 then cast(array() as array<int>) else array(label) end as kb_ids", "case when query_id % 10 = 9 then ' ' else 'question' end as text", "query_id % 3 = 0 as strict")


def _excluded(spark, sf) -> DataFrame:
    return chunks_of(spark, sf).select("doc_id").distinct().filter("doc_id % 5 = 4")


_TOPK = CHUNKS + """, sc as (select query_id, id, round(list_inner_product(vec::double[], embedding::double[]) / sqrt(list_inner_product(vec::double[], vec::double[]) * list_inner_product(embedding::double[], embedding::double[])), 12) as sim
  from asked join chunks on (len(kb_ids) = 0 or list_contains(kb_ids, kb_id)) where embedding is not null and list_inner_product(embedding::double[], embedding::double[]) > 0 and doc_id % 5 <> 4 {0}),
topk as (select query_id, (row_number() over (partition by query_id order by sim desc, id))::int as rank, id, round(sim, 4) as score from sc qualify row_number() over (partition by query_id order by sim desc, id) <= 20)"""


@query("with " + _TOPK.format("") + " select * from topk")
def r1_cosine_topk(spark, sf):
    return retrieval.cosine_topk(asked_of(spark, sf), chunks_of(spark, sf), 20, _excluded(spark, sf))


@query("with " + _TOPK.format("") + " select * from topk")
def r1_cosine_topk_sql(spark, sf):
    return retrieval.cosine_topk(asked_of(spark, sf), chunks_of(spark, sf), 20, _excluded(spark, sf), method="sql")


_HITS = _TOPK.format("and trim(text) <> ''").replace("from asked join chunks", "from asked a join (select id, kb_id, doc_id, embedding from chunks) c") + """, hits as (select query_id, (row_number() over (partition by query_id order by rank))::int as rank, id, score from topk where score >= 0.25 qualify row_number() over (partition by query_id order by rank) <= 6)"""


def hits_of(spark, sf) -> DataFrame:
    return retrieval.retrieve(asked_of(spark, sf), chunks_of(spark, sf), _excluded(spark, sf))


@query("with " + _HITS + " select * from hits")
def r2_retrieve(spark, sf):
    return hits_of(spark, sf)


@query("with " + _HITS + """, s as (select query_id, rank as pos, (7 - rank) + 1 as r, case when query_id % 4 = 0 then 99 else 0 end as off, (rank * 11 % 7) / 10.0::double as rel from hits),
j as (select h.query_id, h.id, h.rank, h.score, s.pos, s.rel, max(s.pos is not null) over (partition by h.query_id) as any_ from hits h left join s on s.query_id = h.query_id and s.r + s.off = h.rank)
select query_id, (row_number() over (partition by query_id order by coalesce(pos, rank)))::int as rank, id, coalesce(round(rel, 4), score) as score from j where not any_ or pos is not null""")
def r3_apply_rerank(spark, sf):
    hits = materialize(hits_of(spark, sf))
    scores = hits.selectExpr("query_id", "rank as pos", "7 - rank + case when query_id % 4 = 0 then 99 else 0 end as idx", "cast((rank * 11 % 7) / 10.0 as double) as relevance")
    return retrieval.apply_rerank(hits, scores)


@query("with " + _HITS + """, n as (select query_id, count(*) as c from hits group by query_id), z as (select a.query_id, strict and (coalesce(c, 0) = 0 or not exists (select 1 from chunks k where len(a.kb_ids) = 0 or list_contains(a.kb_ids, k.kb_id))) as refused from asked a left join n using (query_id))
select query_id, refused, case when refused then '知识库中没有找到与这个问题相关的信息。' end as answer from z""")
def r4_refusal_guard(spark, sf):
    return retrieval.refusal_guard(asked_of(spark, sf), hits_of(spark, sf), chunks_of(spark, sf))


def _names(spark, sf) -> DataFrame:
    return chunks_of(spark, sf).select(F.col("doc_id").alias("id")).distinct().filter("id % 3 <> 0").selectExpr("id", "concat('doc ', id) as name")


_CITE = _HITS + ", cited as (select query_id, rank as idx, doc_id, kb_id, case when doc_id % 3 <> 0 then 'doc ' || doc_id else doc_id::varchar end as doc_name, case when doc_id % 3 <> 0 then 'doc ' || doc_id else '文档' end as shown_name, artifact, coalesce(section_num, '') as section_num, breadcrumb, anchor, left(text, 160) as text, score from hits join chunks using (id))"


@query("with " + _CITE + " select * exclude (shown_name) from cited")
def r5_citations(spark, sf):
    return retrieval.citations(hits_of(spark, sf), chunks_of(spark, sf), _names(spark, sf))


@query("with " + _CITE + " select query_id, string_agg('[' || idx || '] 【' || shown_name || ' ' || case when breadcrumb <> '' then breadcrumb else section_num end || '】' || chr(10) || text, chr(10) || chr(10) order by idx) as context from cited group by query_id")
def r5_context(spark, sf):
    return retrieval.context_text(hits_of(spark, sf), chunks_of(spark, sf), _names(spark, sf))


def _frags(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id as session_id", "event_id as seq", "event_id % 3 as doc_id", "case when event_id % 11 = 0 then '' else concat('organized:', event_id % 13) end as anchor")


def _frag_sql(key: str) -> str:
    return f"""with f as (select user_id as session_id, event_id as seq, event_id % 3 as doc_id, case when event_id % 11 = 0 then '' else 'organized:' || (event_id % 13) end as anchor from events),
g as (select *, min(seq) over (partition by session_id, case when anchor = '' then 's' || seq else {key} end) as first from f)
select session_id, seq, doc_id, anchor, (dense_rank() over (partition by session_id order by first))::int as n from g"""


@query(_frag_sql("'a' || anchor"))
def r6_number_fragments(spark, sf):
    return retrieval.number_fragments(_frags(spark, sf))


@query(_frag_sql("'a' || doc_id || '/' || anchor"))
def r6_number_fragments_by_doc(spark, sf):
    return retrieval.number_fragments(_frags(spark, sf), "doc_anchor")


@query("select doc_id, length(text)::float as chars, (length(text) - length(replace(text, 'e', '')))::float as e, (length(text) - length(replace(text, ' ', '')))::float as blanks from documents")
def r7_embed(spark, sf):
    fn = lambda texts: [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]
    v = retrieval.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", fn)
    return v.select("doc_id", *(F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(("chars", "e", "blanks"))))


# the catalogue over documents and sources

STATUSES = ("pending", "parsing", "fetching", "queued", "generating", "ready", "done", "failed")
_STATUS = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
CATALOGUE = f"""docs as (select doc_id as id, source as kb_id, 'doc' || doc_id as name, case when lang = 'en' then 'doc' else 'web' end as doc_type, {_STATUS}[doc_id % 8 + 1] as status,
  '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || ' 00:00:00' as created_at, (doc_id % 50)::double as sort_order,
  case when doc_id % 3 = 0 then '{{}}' when doc_id % 3 = 1 then null else '{{"presetId":"own"}}' end as gen_config,
  case when doc_id % 4 = 0 then '{{}}' when doc_id % 4 = 1 then '{{"enabled":false,"plugins":["a"]}}' when doc_id % 4 = 2 then '{{"components":{{"summary":true}}}}' else '{{"components":{{"summary":false}},"plugins":[]}}' end as index_config, text from documents),
kbs as (select distinct source as id, source as name, '2024-01-01 00:00:00' as created_at, (substr(source, 4)::int % 5)::double as sort_order, substr(source, 4)::int % 2 = 0 as even from documents union all select 'src_empty', 'none', '2023-01-01 00:00:00', 0.0, false)"""


def docs_of(spark, sf) -> DataFrame:
    names = ", ".join(f"'{s}'" for s in STATUSES)
    return table(spark, sf, "documents").selectExpr(
        "doc_id as id", "source as kb_id", "concat('doc', doc_id) as name", "case when lang = 'en' then 'doc' else 'web' end as doc_type", f"array({names})[cast(doc_id % 8 as int)] as status",
        "concat('2024-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), ' 00:00:00') as created_at", "cast(doc_id % 50 as double) as sort_order",
        """case when doc_id % 3 = 0 then '{}' when doc_id % 3 = 1 then null else '{"presetId":"own"}' end as gen_config""",
        """case when doc_id % 4 = 0 then '{}' when doc_id % 4 = 1 then '{"enabled":false,"plugins":["a"]}' when doc_id % 4 = 2 then '{"components":{"summary":true}}' else '{"components":{"summary":false},"plugins":[]}' end as index_config""",
        "text",
    )


def kbs_of(spark, sf) -> DataFrame:
    own = table(spark, sf, "documents").select(F.col("source").alias("id")).distinct()
    rows = own.selectExpr("id", "id as name", "'2024-01-01 00:00:00' as created_at", "cast(cast(substr(id, 4) as int) % 5 as double) as sort_order", "cast(substr(id, 4) as int) % 2 = 0 as even")
    rows = rows.unionByName(spark.range(1).selectExpr("'src_empty' as id", "'none' as name", "'2023-01-01 00:00:00' as created_at", "cast(0 as double) as sort_order", "false as even"))
    return rows.withColumns({
        "gen_config": F.when(F.col("even"), '{"doc":{"presetId":"kb"},"web":{}}').otherwise("{}"),
        "index_config": F.when(F.col("even"), '{"doc":{"plugins":["p"]},"web":{"enabled":false}}').otherwise("{}"),
    })


def _presets(spark) -> DataFrame:
    return spark.range(3).selectExpr("array('any', 'site', 'paper')[cast(id as int)] as id", "array('x', 'web', null)[cast(id as int)] as `group`", "id as ord")


@query("with " + CATALOGUE + " select k.id, k.name, k.created_at, k.sort_order, count(d.id)::bigint as doc_count from kbs k left join docs d on d.kb_id = k.id group by k.id, k.name, k.created_at, k.sort_order")
def k1_list_kbs(spark, sf):
    return catalog.list_kbs(kbs_of(spark, sf), docs_of(spark, sf)).select("id", "name", "created_at", "sort_order", "doc_count")


@query("with " + CATALOGUE + """ select d.id, case when coalesce(gen_config, '{}') <> '{}' then gen_config when even and doc_type = 'doc' then '{"presetId":"kb"}' when doc_type = 'web' then '{"presetId":"site"}' else '{"presetId":"paper"}' end as config,
  coalesce(gen_config, '{}') = '{}' as inherited from docs d join kbs k on k.id = d.kb_id""")
def k2_effective_config(spark, sf):
    return catalog.effective_config(docs_of(spark, sf), kbs_of(spark, sf), _presets(spark))


@query("with " + CATALOGUE + """ select d.id as doc_id from docs d join kbs k on k.id = d.kb_id where case d.id % 4 when 0 then not (even and doc_type = 'doc') when 1 then true when 2 then false else true end""")
def k2_disabled_docs(spark, sf):
    return catalog.disabled_docs(catalog.effective_config(docs_of(spark, sf), kbs_of(spark, sf), _presets(spark), "index"))


def states(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    sha = "sha2(text, 256)"
    new = d.selectExpr("doc_id", "'p' as preset", "'c' as components", f"{sha} as organized_sha", "map('b', '2', 'c', '4', concat('d', doc_id % 2), '5') as plugins")
    old = d.filter("doc_id % 13 <> 0").selectExpr("doc_id", "case when doc_id % 11 = 0 then 'q' else 'p' end as preset", "case when doc_id % 7 = 0 then null else 'c' end as components", f"case when doc_id % 5 = 0 then sha2(lang, 256) else {sha} end as organized_sha", "map('a', '1', 'b', '2', 'c', '3') as plugins")
    return old, new


@query("""with s as (select doc_id, doc_id % 13 = 0 or doc_id % 11 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0 as full_ from documents)
select doc_id, null::varchar as name, 'FULL' as change from s where full_
union all select doc_id, case when n = 'd' then 'd' || doc_id % 2 else n end, c from s, (values ('a', 'REMOVED'), ('b', 'UNCHANGED'), ('c', 'CHANGED'), ('d', 'ADDED')) v(n, c) where not full_""")
def k3_index_diff(spark, sf):
    return catalog.index_diff(*states(spark, sf))


@query("with " + CATALOGUE + """ select d.id as doc_id, case d.id % 4 when 0 then even and doc_type = 'doc' when 1 then false when 2 then true else false end and d.id % 7 <> 1 as stale from docs d join kbs k on k.id = d.kb_id""")
def k3_index_stale(spark, sf):
    configs = catalog.effective_config(docs_of(spark, sf), kbs_of(spark, sf), _presets(spark), "index")
    fps = docs_of(spark, sf).selectExpr("id", "case when id % 7 = 1 then sha2(text, 256) when id % 7 = 2 then null else 'old' end as index_fp", "sha2(text, 256) as fp")
    return catalog.index_stale(configs, fps)


@query("""select doc_id, s as stage, case when doc_id % 2 = 0 and doc_id % 3 <> 0 and doc_id % 5 <> s.length() then 'skip' else 'rerun' end as decision from documents, (values ('a'), ('bb')) v(s)""".replace("s.length()", "length(s)"))
def k4_stage_decision(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("a"), F.lit("bb"))).alias("stage"))
    params = d.selectExpr("doc_id", "stage", """concat('{"doc":', doc_id, '}') as params""", "doc_id % 2 = 0 as present")
    recorded = d.filter("doc_id % 5 <> length(stage)").selectExpr("doc_id", "stage", """concat('{"doc":', doc_id, '}') as params""", "doc_id % 3 <> 0 as done")
    return catalog.stage_decision(params, recorded)


@query("with " + fx.NUMBERED + """, done as (select doc_id, num from headings where ord % 3 = 1)
select doc_id, ord::int as ord, num from headings h where not exists (select 1 from done d where d.doc_id = h.doc_id and (h.num = d.num or starts_with(h.num, d.num || '.'))) union all select doc_id, -1, null from documents""")
def k5_remaining_items(spark, sf):
    heads = lines.number_headings(fx.fenced(spark, sf))[1].select("doc_id", F.col("ord").cast("int").alias("ord"), "num")
    items = heads.unionByName(table(spark, sf, "documents").selectExpr("doc_id", "-1 as ord", "cast(null as string) as num"))
    return catalog.remaining_items(items, heads.filter("ord % 3 = 1"))


def _moves(spark, sf) -> DataFrame:
    d = docs_of(spark, sf)
    active = d.filter("id % 10 = 6").select(F.col("id").alias("doc_id"))
    moves = d.filter("id % 2 = 0").selectExpr("id as doc_id", "case when id % 18 = 0 then 'nowhere' else 'src1' end as kb_id").unionByName(spark.range(1).selectExpr("cast(-5 as bigint) as doc_id", "'src2' as kb_id"))
    return catalog.check_moves(d, kbs_of(spark, sf), moves, active)


_MOVES = CATALOGUE + """, moves as (select id as doc_id, case when id % 18 = 0 then 'nowhere' else 'src1' end as kb_id from docs where id % 2 = 0 union all select -5, 'src2'),
checked as (select m.doc_id, m.kb_id, case when m.kb_id = 'nowhere' then 'unknown kb' when d.id is null then 'unknown document' when d.status in ('parsing', 'generating', 'fetching') then 'running' when d.id % 10 = 6 then 'active job' end as error from moves m left join docs d on d.id = m.doc_id),
dchunks as (select vec_id as id, vec_id as doc_id, 'src' || label as kb_id, embedding from embeddings)"""


def _dchunks(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr("cast(vec_id as string) as id", "cast(vec_id as string) as doc_id", "concat('src', label) as kb_id", "embedding")


@query("with " + _MOVES + " select * from checked")
def k6_check_moves(spark, sf):
    return _moves(spark, sf)


@query("with " + _MOVES + " select d.id, coalesce(c.kb_id, d.kb_id) as kb_id from docs d left join checked c on c.doc_id = d.id and error is null")
def k6_move_docs(spark, sf):
    return catalog.move_docs(docs_of(spark, sf), _dchunks(spark, sf), _moves(spark, sf))[0].select("id", "kb_id")


@query("with " + _MOVES + " select k.id::varchar as id, coalesce(c.kb_id, k.kb_id) as kb_id from dchunks k left join checked c on c.doc_id = k.doc_id and error is null")
def k6_move_chunks(spark, sf):
    moves = _moves(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    return catalog.move_docs(docs_of(spark, sf).withColumn("id", F.col("id").cast("string")), _dchunks(spark, sf), moves)[1].select("id", "kb_id")


@query("with " + _MOVES + " select sha256(d.id || '|' || c.kb_id) as id, name || '（副本）' as name, c.kb_id, status from docs d join checked c on c.doc_id = d.id and error is null")
def k7_copy_docs(spark, sf):
    return catalog.copy_docs(docs_of(spark, sf), _dchunks(spark, sf), _moves(spark, sf))[0].select("id", "name", "kb_id", "status")


@query("with " + _MOVES + " select sha256(k.id || '|' || c.kb_id) as id, sha256(k.doc_id || '|' || c.kb_id) as doc_id, c.kb_id, embedding[1] as first from dchunks k join checked c on c.doc_id = k.doc_id and error is null")
def k7_copy_chunks(spark, sf):
    moves = _moves(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    c = catalog.copy_docs(docs_of(spark, sf).withColumn("id", F.col("id").cast("string")), _dchunks(spark, sf), moves)[1]
    return c.select("id", "doc_id", "kb_id", F.get("embedding", F.lit(0)).alias("first"))


@query("with " + _MOVES + " select 'kb' as kind, id as id from kbs where id not in ('src3', 'src4') union all select 'doc', id::varchar from docs where kb_id not in ('src3', 'src4') union all select 'chunk', id::varchar from dchunks where kb_id not in ('src3', 'src4')")
def k8_delete_kbs(spark, sf):
    k = kbs_of(spark, sf)
    parts = catalog.delete_kbs(k, docs_of(spark, sf), _dchunks(spark, sf), k.filter("id in ('src3', 'src4')").select("id"))
    out = [p.select(F.lit(n).alias("kind"), F.col("id").cast("string").alias("id")) for n, p in zip(("kb", "doc", "chunk"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("with " + _MOVES + " select 'doc' as kind, id::varchar as id from docs where id % 4 <> 1 union all select 'chunk', id::varchar from dchunks where doc_id % 4 <> 1 or doc_id not in (select id from docs)")
def k8_delete_docs(spark, sf):
    d = docs_of(spark, sf)
    left, c = catalog.delete_docs(d, _dchunks(spark, sf), d.filter("id % 4 = 1").select(F.col("id").cast("string").alias("id")))
    return left.selectExpr("'doc' as kind", "cast(id as string) as id").unionByName(c.selectExpr("'chunk' as kind", "id"))


@query("with " + CATALOGUE + " select k.id as kb_id, coalesce(min(d.sort_order) - 1000, 1000) as sort_order from kbs k left join docs d on d.kb_id = k.id group by k.id")
def k9_place_first(spark, sf):
    return catalog.place_first(docs_of(spark, sf), kbs_of(spark, sf))


@query("with " + CATALOGUE + ", o as (select id, row_number() over (partition by kb_id order by id desc) as p from docs where id % 2 = 1) select d.id, coalesce(1000.0 * p, sort_order)::double as sort_order from docs d left join o using (id)")
def k9_reorder(spark, sf):
    d = docs_of(spark, sf)
    named = catalog.number_within(d.filter("id % 2 = 1").select("kb_id", "id"), "pos", "kb_id", F.desc("id"))
    return catalog.reorder(d, named).select("id", "sort_order")


_GROUP = "case {0}.status when 'parsing' then 0 when 'generating' then 0 when 'pending' then 1 when 'ready' then 2 when 'done' then 3 else 4 end"


@query("with " + CATALOGUE + f""" select a.id, 1000.0 * (1 + (select count(*) from docs b where b.kb_id = a.kb_id and ({_GROUP.format("b")} < {_GROUP.format("a")}
  or (b.status = a.status and (b.created_at > a.created_at or (b.created_at = a.created_at and b.id < a.id))))))::double as sort_order from docs a""")
def k9_backfill_order(spark, sf):
    return catalog.backfill_order(docs_of(spark, sf)).select("id", "sort_order")


@query("with " + CATALOGUE + " select id, (1000 * row_number() over (order by created_at, id))::double as sort_order from kbs")
def k9_backfill_kbs(spark, sf):
    return catalog.backfill_kbs(kbs_of(spark, sf)).select("id", "sort_order")


@query("with " + CATALOGUE + " select id, (row_number() over (order by sort_order, created_at desc, id))::int as place from docs where kb_id = 'src1'")
def k10_list_docs(spark, sf):
    return catalog.list_docs(docs_of(spark, sf), "src1").select("id", "place")


@query("with " + CATALOGUE + " select id, case when status in ('generating', 'queued') then 'ready' when status in ('parsing', 'fetching') then case when id % 3 = 0 then 'ready' else 'failed' end else status end as status from docs")
def k11_recover_status(spark, sf):
    d = docs_of(spark, sf)
    return catalog.recover_status(d, d.filter("id % 3 = 0").select(F.col("id").alias("doc_id"))).select("id", "status")


@query("""select distinct doc_id from (select case when event_id % 2 = 0 then 'd' || user_id end as doc_id from events where event_id % 3 <> 0 union all select unnest(['e' || event_id % 50, 'd' || user_id % 7]) from events where event_id % 3 <> 0 and event_id % 5 = 0) where doc_id is not null""")
def k12_active_docs(spark, sf):
    jobs = table(spark, sf, "events").selectExpr("case when event_id % 2 = 0 then concat('d', user_id) end as doc_id", """case when event_id % 5 = 0 then concat('{"docIds":["e', event_id % 50, '","d', user_id % 7, '"]}') else '{}' end as payload""", "event_id % 3 <> 0 as active")
    return catalog.active_docs(jobs)


_BRIEF = """'- 《' || name || '》' || case when id % 4 = 0 then '（T' || id || '）' else '' end || case when id % 5 = 0 then '：D' else '' end || ' ｜ doc_id=' || id"""


@query("with " + CATALOGUE + f""", c as (select id as cur, kb_id from docs where id % 100 = 0)
select cur as doc_id, string_agg({_BRIEF} || case when id = cur then '（本文档）' else '' end, chr(10) order by id = cur, created_at, id) as overview from c join docs using (kb_id) where id = cur or (id % 3 <> 0 and id % 7 <> 0 and id % 11 <> 0) group by cur""")
def k13_kb_overview(spark, sf):
    """Asked by every hundredth document."""
    d = _overview_docs(spark, sf)
    return catalog.kb_overview(d, d.filter("id % 100 = 0").select(F.col("id").alias("doc_id")))


def _overview_docs(spark, sf) -> DataFrame:
    return docs_of(spark, sf).selectExpr("id", "kb_id", "name", "case when id % 4 = 0 then concat('T', id) when id % 4 = 1 then name end as title", "case when id % 5 = 0 then 'D' else '' end as digest", "case when id % 3 = 0 then false when id % 3 = 1 then true end as enabled", "case when id % 7 <> 0 then 'p' end as preset_id", "id % 11 <> 0 as organized", "created_at")


@query("with " + CATALOGUE + f""", s as (select *, id % 3 <> 0 and id % 7 <> 0 and id % 11 <> 0 as shown from docs)
select kb_id, id as doc_id, case when shown then (row_number() over (partition by kb_id, shown order by created_at, id))::int end as place, {_BRIEF} as line, {_BRIEF} || '（本文档）' as own_line from s""")
def k13_kb_lines(spark, sf):
    return catalog.kb_lines(_overview_docs(spark, sf))


@query("with " + fx.NUMBERED + " select doc_id, left(string_agg(repeat('  ', (level - 2)::int) || '- ' || num || ' ' || title, chr(10) order by ord), 200) as toc from headings where doc_id % 2 = 0 group by doc_id")
def k14_lookup_toc(spark, sf):
    tocs = lines.build_toc(lines.number_headings(fx.fenced(spark, sf))[1])
    return catalog.lookup_toc(tocs, table(spark, sf, "documents").filter("doc_id % 2 = 0").select("doc_id"), 200)


@query("with " + fx.BLOCKS + """ select doc_id, left(string_agg('### ' || case when target in ('1', '2') then 'Title ' || target when target = '' then '（未编号节）' else target end || chr(10) || trim(content), chr(10) || chr(10) order by ord), 300) as summary from blocks where type = 'summary' and content <> '' and doc_id % 2 = 1 group by doc_id""")
def k14_lookup_summary(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    heads = d.select("doc_id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("num")).withColumn("title", F.concat(F.lit("Title "), "num"))
    return catalog.lookup_summary(blocks.parse_blocks(fx.blocks_text(spark, sf))[0], heads, d.filter("doc_id % 2 = 1"), 300)


@query("select source, min(doc_id) as doc_id from documents group by source, sha256(lower(regexp_replace(text, '[\\s\\x{3000}]+', '', 'g')))")
def k15_dedupe_normalized(spark, sf):
    return catalog.dedupe_normalized(table(spark, sf, "documents"), F.col("text"), "source", "doc_id").select("source", "doc_id")


@query("select source, min(doc_id) as doc_id from documents group by source, case when doc_id % 3 = 2 then doc_id % 2 else -1 end, lang")
def k15_dedupe_meta(spark, sf):
    """Texts differ in meta lines that do not count (and, every third, in one that does)."""
    meta = r"concat(case doc_id % 3 when 0 then concat('## meta\nname: ', doc_id, '\n where : x\n\n') when 1 then concat('\r\n## meta\r\nwhere:', doc_id, '\n') else concat('## meta\nrole: ', doc_id % 2, '\nname: y\n') end, '## body\n', lang) as text"
    rows = table(spark, sf, "documents").selectExpr("source", "doc_id", meta)
    return catalog.dedupe_normalized(rows, F.col("text"), "source", "doc_id", ("name", "where")).select("source", "doc_id")


@query("""with c as (select item_id as ord, 'n' || item_id as name, case when item_id % 3 = 0 then 'w' || item_id % 4 end as wid, 'Here  ' || item_id % 5 as wt from benchmark),
k as (select *, case when wid is not null then 'id:' || wid else 'own:here' || item_id_mod end as key from (select *, ord % 5 as item_id_mod from c)), g as (select key, min(ord) as first, string_agg(name, ',' order by ord) as members from k group by key)
select (row_number() over (order by first))::int as grp, key, members from g""")
def k16_group_components(spark, sf):
    return _components(table(spark, sf, "benchmark"))


def _located(items: DataFrame) -> DataFrame:
    return items.selectExpr("item_id as ord", "concat('n', item_id) as name", "case when item_id % 3 = 0 then concat('w', item_id % 4) end as where_id", "concat('Here  ', item_id % 5) as where_text")


def _components(items: DataFrame) -> DataFrame:
    return catalog.group_components(_located(items)).select("grp", "key", F.array_join("members", ",").alias("members"))


@query("""with k as (select event_id as ord, 'n' || event_id as name, case when event_id % 3 = 0 then 'id:w' || event_id % 4 else 'own:here' || event_id % 5 end as key from events),
g as (select key, row_number() over (order by min(ord)) as grp from k group by key) select grp::int as grp, key, ord, name from k join g using (key)""")
def k16_component_rows(spark, sf):
    return catalog.component_rows(_located(table(spark, sf, "events").withColumnRenamed("event_id", "item_id")))


@query("with " + fx.BLOCKS + """, n as (select doc_id, count(*) filter (where type = 'explain') as e from blocks group by doc_id)
select doc_id, concat_ws('; ', case when doc_id % 100 > 50 then 'stray characters: ' || doc_id % 100 end, case when coalesce(e, 0) <> doc_id % 4 then 'explain: ' || coalesce(e, 0) || ' blocks, ' || doc_id % 4 || ' leaf sections' end,
  case when doc_id % 3 = 0 then 'summaries lost: 2' end, case when doc_id % 6 = 0 then 'single second-level heading' end) as warnings from documents left join n using (doc_id)""")
def k17_quality_report(spark, sf):
    d = table(spark, sf, "documents")
    b = blocks.parse_blocks(fx.blocks_text(spark, sf))[0]
    r = catalog.quality_report(
        b, d.selectExpr("doc_id", "doc_id % 4 as n_leaf"), d.selectExpr("doc_id", "doc_id % 100 as stray_chars"),
        d.selectExpr("doc_id", "5 as found", "case when doc_id % 3 = 0 then 3 else 5 end as kept"), d.selectExpr("doc_id", "case when doc_id % 6 = 0 then 1 else 2 end as n_h2", "11 as n_pages"), ["explain"],
    )
    return r.select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


@query("""with f as (select doc_id, sha256('a.md' || chr(10) || n_chars || ':' || doc_id || chr(10) || 'organized.md' || chr(10) || '7:1' || chr(10)) as fp from documents where doc_id % 9 <> 0)
select doc_id from f where doc_id % 5 = 0 or doc_id % 7 = 0 or doc_id % 4 = 0 or doc_id % 6 = 0 or doc_id % 11 = 0""")
def k18_stale_snapshots(spark, sf):
    d = table(spark, sf, "documents")
    m = d.selectExpr("doc_id", "'a.md' as name", "n_chars as size", "doc_id as mtime").unionByName(d.filter("doc_id % 9 <> 0").selectExpr("doc_id", "'organized.md' as name", "cast(7 as bigint) as size", "cast(1 as bigint) as mtime"))
    fps = catalog.artifacts_fp(m)
    configs = d.selectExpr("doc_id", "concat('{', lang, '}') as config")
    snaps = fps.join(configs, "doc_id").filter("doc_id % 11 <> 0").selectExpr("doc_id", "case when doc_id % 5 = 0 then 'x' else fp end as gen_fp", "case when doc_id % 7 = 0 then 'x' else sha2(config, 256) end as cfg_hash", "case when doc_id % 4 = 0 then 1 else 2 end as anchor_gen", "doc_id % 6 <> 0 as has_export")
    return catalog.stale_snapshots(fps, configs, snaps, 2)


@query("select user_id as doc_id, event_id as name from events qualify row_number() over (partition by user_id order by ts desc, event_id) > 3")
def k19_evict_exports(spark, sf):
    return catalog.evict_exports(table(spark, sf, "events").selectExpr("user_id as doc_id", "event_id as name", "ts as mtime")).select("doc_id", "name")

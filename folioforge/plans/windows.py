"""Queries for token-window packing and the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import estimate_tokens
from folioforge.operators import chunks, lines, packing
from folioforge.plans import fixtures as fx
from folioforge.plans.fixtures import table
from folioforge.plans.structure import est

QUERIES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def _walk(items: str, cap: int, joiner: int = 0) -> str:
    """Recursive CTE packed(key, i, win) over items(key, i, w), i from 1."""
    return f"""{items}, packed as (
  select key, i, w as used, 0 as win from items where i = 1
  union all
  select n.key, n.i, case when p.used + n.w > {cap} then n.w else p.used + n.w + {joiner} end, case when p.used + n.w > {cap} then p.win + 1 else p.win end
  from packed p join items n on n.key = p.key and n.i = p.i + 1)"""


_PAGES = fx.MD + r""", pl as (
  select doc_id, generate_subscripts(a, 1) as n, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from md)
), pb as (select *, sum(case when starts_with(line, '<!-- page:') then 1 else 0 end) over (partition by doc_id order by n) as ord from pl
), pages as (select doc_id, ord, string_agg(line, chr(10) order by n) as text from pb group by doc_id, ord)"""


@query(f"with recursive {_PAGES}, {_walk(f'items as (select doc_id as key, row_number() over (partition by doc_id order by ord) as i, ord, {est("text")} as w from pages)', 400)} select key as doc_id, ord::int as ord, win as window_id from packed join items using (key, i)")
def p1_page_windows(spark, sf):
    pages = lines.page_blocks(fx.md_docs(spark, sf))
    return packing.pack_windows(pages.select("doc_id", "ord", estimate_tokens(F.col("text")).alias("tokens")), "doc_id", "ord", F.col("tokens"), 400).select("doc_id", F.col("ord").cast("int").alias("ord"), "window_id")


@query(f"with recursive {_walk(f'items as (select source as key, row_number() over (partition by source order by doc_id) as i, doc_id, {est("text")} as w from documents)', 4000)} select key as source, doc_id, win as window_id from packed join items using (key, i)")
def p2_item_windows(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", estimate_tokens(F.col("text")).alias("tokens"))
    return packing.pack_windows(docs, "source", "doc_id", F.col("tokens"), 4000).select("source", "doc_id", "window_id")


_PARAS = fx.MD + r""", pa as (select doc_id, list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S')) as a from md),
items as (select doc_id as key, generate_subscripts(a, 1) as i, unnest(a) as p, length(unnest(a)) as w from pa)"""


@query(f"with recursive {_walk(_PARAS, 1500, 2)} select key as doc_id, win as ord, string_agg(p, chr(10) || chr(10) order by i) as text from packed join items using (key, i) group by key, win")
def p3_paragraph_windows(spark, sf):
    return packing.para_windows(fx.md_docs(spark, sf), 1500)


_ITEMS = f"with recursive {fx.MD}, fenced as (select doc_id, text from md)" + fx.NUMBERED[len(fx.FENCED):] + f""",
ln as (select doc_id, line_no, line, level, sum(case when level = 2 then 1 else 0 end) over (partition by doc_id order by line_no) as o2 from numbered),
s2 as (select doc_id, o2, string_agg(line, chr(10) order by line_no) as content, arg_min(line, line_no) as head, max(o2) over (partition by doc_id) as m from ln group by doc_id, o2),
s2k as (select *, case when o2 > 0 then regexp_extract(head, '^## (\\d+(?:\\.\\d+)*) ', 1) end as num, {est("content")} as tk from s2 where o2 > 0 or m = 0 or regexp_matches(content, '\\S')),
l3 as (select ln.doc_id, ln.o2, line_no, line, sum(case when level = 3 then 1 else 0 end) over (partition by ln.doc_id, ln.o2 order by line_no) as o3 from ln join s2k using (doc_id, o2) where tk > 300),
s3 as (select doc_id, o2, o3, string_agg(line, chr(10) order by line_no) as content, arg_min(line, line_no) as head, max(o3) over (partition by doc_id, o2) as m from l3 group by doc_id, o2, o3),
s3k as (select *, regexp_extract(head, '^###? (\\d+(?:\\.\\d+)*) ', 1) as num, {est("content")} as tk, count(*) over (partition by doc_id, o2) as n from s3 where m > 0 and (o3 > 0 or regexp_matches(content, '\\S'))),
cut as (select doc_id, o2, o3, nullif(num, '') as num, content from s3k where n > 1 and tk > 300
  union all select doc_id, o2, 0, num, content from s2k s where tk > 300 and not exists (select 1 from s3k t where t.doc_id = s.doc_id and t.o2 = s.o2 and t.n > 1)),
pa as (select doc_id || '/' || o2 || '/' || o3 as key, list_filter(regexp_split_to_array(content, '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\S')) as a from cut),
{_walk("items as (select key, generate_subscripts(a, 1) as i, unnest(a) as p, length(unnest(a)) as w from pa)", 1000, 2)},
wins as (select key, win, string_agg(p, chr(10) || chr(10) order by i) as content from packed join items using (key, i) group by key, win),
every as (select doc_id, o2, 0 as o3, 0 as o4, num, content from s2k where tk <= 300 union all select doc_id, o2, o3, 0, nullif(num, ''), content from s3k where n > 1 and tk <= 300
  union all select c.doc_id, c.o2, c.o3, w.win, c.num, w.content from cut c join wins w on w.key = c.doc_id || '/' || c.o2 || '/' || c.o3)
select doc_id, (row_number() over (partition by doc_id order by o2, o3, o4) - 1)::int as key, num, content from every"""


@query(_ITEMS)
def p4_pass2_items(spark, sf):
    return packing.pass2_items(lines.number_headings(fx.md_docs(spark, sf))[0], 300)


_LONG = fx.MD + f""", pa as (select doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S')) as a from md),
u as (select doc_id as key, generate_subscripts(a, 1) as i, unnest(a) as p from pa), items as (select key, i, p, {est("p")} as w from u)"""


@query(f"""with recursive {_walk(_LONG, 500)}, z as (select key, win, i, p, row_number() over (partition by key, win order by i) as k from packed join items using (key, i))
select key as doc_id, win as ord, string_agg(case when k = 1 and win > 0 then p || chr(10) || chr(10) else p end, chr(10) || chr(10) order by i) as text from z group by key, win""")
def p5_split_long(spark, sf):
    return packing.split_long(fx.md_docs(spark, sf), 500)


def _windows(spark, sf) -> DataFrame:
    """Conversations as a window table: the text is a window's body, its summary and, under a heading, its output."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("window_id"), F.col("text").alias("body"), F.concat(F.lit("## "), F.left("text", F.lit(20)), F.lit("\n"), "text").alias("output"), F.col("text").alias("summary"))


@query(f"""with w as (select conv_id as doc_id, turn::int as window_id, text as body, '## ' || left(text, 20) || chr(10) || text as output, text as summary,
  '## ' || rtrim(regexp_extract(left(text, 20), '^[^\\n]*')) as head from conversations),
s as (select a.doc_id, a.window_id, string_agg('【' || k || '】' || b.summary, chr(10) || chr(10) order by b.window_id) as past from w a join (select *, row_number() over (partition by doc_id order by window_id) as k from w) b on a.doc_id = b.doc_id and b.window_id < a.window_id group by a.doc_id, a.window_id),
h as (select a.doc_id, a.window_id, string_agg(b.head, chr(10) order by b.window_id) as headings from w a join w b on a.doc_id = b.doc_id and b.window_id between a.window_id - 2 and a.window_id - 1 group by a.doc_id, a.window_id)
select w.doc_id, w.window_id, coalesce(past, '') as summary, coalesce(headings, '') as headings, coalesce(lag(output) over (partition by w.doc_id order by w.window_id), '') as tail, body
from w left join s using (doc_id, window_id) left join h using (doc_id, window_id)""")
def p6_window_context(spark, sf):
    return packing.window_context(_windows(spark, sf))


_MD = f"{fx.MD}, fenced as (select doc_id, text from md)"
_SPANS = fx.LINES[len(fx.FENCED):] + r""", m as (
  select *, starts_with(line, '<!-- page:') as whole from lines
), k3 as (select doc_id, line_no as old_no, line, row_number() over (partition by doc_id order by line_no) as r, not regexp_matches(line, '\S') as blank from m where not whole
), k4 as (select *, blank and coalesce(lag(blank) over (partition by doc_id order by r), false) as again from k3
), stripped as (select doc_id, row_number() over (partition by doc_id order by r) - 1 as line_no, line, false as in_fence from k4 where not again)""" + fx.NUMBERED[len(fx.LINES):].replace("from lines\n", "from stripped\n", 1) + f""",
sp as (select a.doc_id, a.ord, a.level, a.num, a.title, a.line_no, coalesce((select min(y.line_no) - 1 from headings y where y.doc_id = a.doc_id and y.line_no > a.line_no and y.level <= a.level), (select max(line_no) from numbered n where n.doc_id = a.doc_id)) as line_end from headings a),
bo as (select sp.doc_id, sp.ord, any_value(sp.level) as level, any_value(sp.num) as num, any_value(sp.title) as title, any_value(sp.line_no) as l0, any_value(line_end) as l1, trim(string_agg(n.line, chr(10) order by n.line_no), chr(10) || ' ') as body
  from sp join numbered n on n.doc_id = sp.doc_id and n.line_no > sp.line_no and n.line_no <= sp.line_end group by sp.doc_id, sp.ord),
be as (select *, {est("body")} as tokens from bo where body <> '')"""
_SECTIONS = f"with recursive {_MD}{_SPANS}"


_CHUNKS = f""",
pp as (select doc_id, ord, list_filter(string_split(body, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S')) as a from be where tokens > 1000),
pu as (select doc_id::varchar || '/' || ord as key, generate_subscripts(a, 1) as i, unnest(a) as p from pp),
{_walk(f'items as (select key, i, p, {est("p")} as w from pu)', 1000)},
pz as (select key, win, i, p, row_number() over (partition by key, win order by i) as k, max(win) over (partition by key) + 1 as n from packed join items using (key, i)),
pieces as (select key, win, any_value(n) as n, string_agg(case when k = 1 and win > 0 then p || chr(10) || chr(10) else p end, chr(10) || chr(10) order by i) as piece from pz group by key, win),
base as (
  select doc_id, ord, 0 as k, num, level, l0, l1, num || ' ' || title || chr(10) || body as text from be where tokens <= 1000 and not (tokens < 50 and level >= 3)
  union all
  select doc_id, ord, win, num, level, l0, l1, num || ' ' || title || case when n > 1 then '（' || (win + 1) || '/' || n || '）' else '' end || chr(10) || piece from be join pieces on key = doc_id::varchar || '/' || ord where tokens > 1000),
short as (select *, regexp_replace(num, '\\.[^.]*$', '') as parent, num || ' ' || title || chr(10) || body as text from be where tokens < 50 and level >= 3),
lone as (select s.* from short s where not exists (select 1 from base b where b.doc_id = s.doc_id and b.num = s.parent)),
own as (select * from lone s where level = 3 or not exists (select 1 from lone o where o.level = 3 and o.doc_id = s.doc_id and o.num = s.parent)),
every as (select doc_id, ord, k, num, l0, l1, text, 0 as late from base union all select doc_id, ord, 0, num, l0, l1, text, 1 from own),
hung as (select s.doc_id, s.parent, string_agg(s.text, chr(10) || chr(10) order by s.ord) as more from short s anti join own o on o.doc_id = s.doc_id and o.ord = s.ord group by s.doc_id, s.parent),
fin as (select *, row_number() over (partition by doc_id, num order by late desc, ord desc, k desc) = 1 as is_last, row_number() over (partition by doc_id order by late, ord, k) - 1 as place from every),
cr as (select a.doc_id, a.num, b.ord as o, b.num || ' ' || b.title as x from headings a join headings b on a.doc_id = b.doc_id and b.ord <= a.ord and b.level <= a.level qualify row_number() over (partition by a.doc_id, a.ord order by b.ord desc) <= 3),
crumb as (select doc_id, num, string_agg(x, ' > ' order by o) as breadcrumb from cr group by doc_id, num),
chunked as (select fin.doc_id, place::int as ord, num as section_num, (l0 + 1)::int as line_start, (l1 + 1)::int as line_end, breadcrumb, case when is_last and more is not null then text || chr(10) || chr(10) || more else text end as text
from fin join crumb using (doc_id, num) left join hung on hung.doc_id = fin.doc_id and hung.parent = fin.num)"""


@query(_SECTIONS + _CHUNKS + " select * from chunked")
def c1_section_chunks(spark, sf):
    return chunks.chunk_sections(fx.md_docs(spark, sf)).select("doc_id", "ord", "section_num", "line_start", "line_end", "breadcrumb", "text")


_OF_BLOCKS = "with " + fx.BLOCKS + """ select doc_id, ord::int as ord, target as section_num, 'explain:' || target as anchor, content as text, 'plugin' as kind from blocks where content <> '' qualify row_number() over (partition by doc_id, target order by ord) = 1"""


@query(_OF_BLOCKS)
def c2_block_chunks(spark, sf):
    return chunks.chunk_blocks(fx.blocks_text(spark, sf), "explain").select("doc_id", "ord", "section_num", "anchor", "text", "kind")


def _pictured(spark, sf) -> DataFrame:
    return fx.md_docs(spark, sf).selectExpr("doc_id", "source", r"""array_join(transform(split(text, '\n'), (l, i) -> case i % 9 when 3 then concat('![', left(l, 5), '](i/', i, '.png) x ![](http://e.org/a.png)') when 7 then concat('<img class="a" src="i/', i, '.jpg" alt="b">') else l end), '\n') as text""")


_PIC = fx.MD + """, fenced as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case (i-1)%9 when 3 then concat('![', left(l, 5), '](i/', i-1, '.png) x ![](http://e.org/a.png)') when 7 then concat('<img class="a" src="i/', i-1, '.jpg" alt="b">') else l end), chr(10)) as text from md)"""


_IMAGES = "with " + _PIC + fx.NUMBERED[len(fx.FENCED):] + r""", at_ as (select *, last_value(num ignore nulls) over (partition by doc_id order by line_no) as sn, last_value(title ignore nulls) over (partition by doc_id order by line_no) as st from numbered),
im as (select doc_id, line_no, coalesce(sn, '') as sn, coalesce(st, '') as st, case when starts_with(line, '![') then trim(regexp_extract(line, '^!\[([^\]]*)\]', 1)) else '' end as alt, case when starts_with(line, '![') then regexp_extract(line, '\]\((i/[^)]*)\)', 1) else regexp_extract(line, 'src="([^"]*)"', 1) end as src from at_ where regexp_matches(line, '^!\[[^\]]*\]\(i/') or starts_with(line, '<img class')),
ic as (select doc_id, (line_no + 1)::int as line_start, sn as section_num, 'image:' || sn || ':' || src as anchor, '[图片] ' || case when alt <> '' then alt else sn || ' ' || st || ' 中的图片' end || '（位于 ' || sn || ' ' || st || '）' as text, trim(sn || ' ' || st) as breadcrumb from im)"""


@query(_IMAGES + " select doc_id, line_start, section_num, anchor, text from ic")
def c3_image_chunks(spark, sf):
    return chunks.chunk_images(_pictured(spark, sf)).select("doc_id", "line_start", "section_num", "anchor", "text")


@query(f"""select x.*, source as kb_id, 'p' as preset_id from (
  select doc_id, ord, 'organized' as artifact, section_num, 'organized:' || section_num as anchor, line_start, line_end, breadcrumb, text, 'section' as kind from (with recursive {_PIC}{_SPANS}{_CHUNKS} select * from chunked)
  union all select doc_id, ord, artifact, section_num, artifact || ':' || section_num, null, null, '', text, a.kind from ({_OF_BLOCKS}) b, (values ('summary', 'summary', 2), ('explain', 'plugin', 5)) a(artifact, kind, k) where doc_id % k = 0
  union all select doc_id, (row_number() over (partition by doc_id order by line_start) - 1)::int, 'image', section_num, anchor, line_start, line_start, breadcrumb, text, 'image' from ({_IMAGES} select * from ic) where doc_id % 3 = 0
) x join documents using (doc_id)""")
def c4_document_chunks(spark, sf):
    docs = _pictured(spark, sf).select("doc_id", F.col("source").alias("kb_id"), F.lit("p").alias("preset_id"), "text")
    texts = fx.blocks_text(spark, sf)
    artifacts = texts.withColumn("artifact", F.lit("summary")).unionByName(texts.withColumn("artifact", F.lit("explain"))).select("doc_id", "artifact", "text")
    config = docs.select("doc_id", (F.col("doc_id") % 2 == 0).alias("summary"), (F.col("doc_id") % 3 == 0).alias("images"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("explain"))).otherwise(F.array().cast("array<string>")).alias("plugins"))
    return chunks.chunk_documents(docs, artifacts, config)


@query(_SECTIONS + ", src as (select doc_id, source from documents) select source, count(*)::bigint as sections, sum(tokens)::bigint as tokens from be join src using (doc_id) group by source")
def w1_chunk_stats(spark, sf):
    """Sections with a body and their estimated tokens per source: read, strip, number, span, measure."""
    docs = fx.md_docs(spark, sf)
    rows = chunks.section_bodies(docs).select("doc_id", "tokens").join(docs.select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.col("tokens").cast("long")).alias("tokens"))

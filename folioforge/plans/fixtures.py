"""Views over the driver tables that have the structure the operators work on, in Spark and in DuckDB.

Markers are followed by wide (U+3000) and no-break (U+00A0) blanks as well as by ordinary ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: White space in the twins' dialect.
W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_W = "[^" + W[1:]


def blanks(sql: str) -> str:
    """Names of characters and classes that are hard to tell apart in a source text."""
    return sql.replace("{wide}", "\u3000").replace("{hard}", "\u00a0").replace("{W}", W).replace("{NOT_W}", NOT_W).replace("{IN_W}", W[1:-1])


def md_docs(spark, sf_dir: str) -> DataFrame:
    """[doc_id, source, lang, text]: documents as page-marked, headed markdown."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "lang",
        blanks(r"""array_join(transform(split(text,'\n'),(l,i)->concat(
          case when i%10=0 then concat('<!-- page:',cast(i div 5+1 as string),' -->\n') when i%10=5 then concat('<!-- page:{wide}',cast(i div 5+1 as string),'{hard}-->\n') else '' end,
          case when i%24=0 then concat('## ',left(l,30)) when i%24=12 then concat('##{wide}',left(l,30),'{wide}') when i%12 in (4,8) then concat('### ',left(l,30))
               when i%12=6 then concat('####{hard}',left(l,30)) else l end)),'\n\n') as text"""),
    )


#: md(doc_id, source, lang, text), one CTE for the twins
MD = blanks(r"""md as (
  select doc_id, source, lang, array_to_string(list_transform(string_split(text,chr(10)), lambda l, i: concat(
    case when (i-1)%10=0 then concat('<!-- page:',cast((i-1)//5+1 as varchar),' -->',chr(10)) when (i-1)%10=5 then concat('<!-- page:{wide}',cast((i-1)//5+1 as varchar),'{hard}-->',chr(10)) else '' end,
    case when (i-1)%24=0 then concat('## ',left(l,30)) when (i-1)%24=12 then concat('##{wide}',left(l,30),'{wide}') when (i-1)%12 in (4,8) then concat('### ',left(l,30))
         when (i-1)%12=6 then concat('####{hard}',left(l,30)) else l end)), concat(chr(10),chr(10))) as text
  from documents)""")


def fenced(spark, sf_dir: str) -> DataFrame:
    """md_docs with a fenced false heading after every line whose number leaves 2 by 12."""
    return md_docs(spark, sf_dir).selectExpr(
        "doc_id",
        r"""array_join(transform(split(text,'\n'),(l,i)->case when i%12=2 then concat('```\n', l, '\n## not a heading\n<!-- page:9 -->\n```') else l end),'\n') as text""",
    )


FENCED = (
    MD
    + r""", fenced as (
  select doc_id, array_to_string(list_transform(string_split(text,chr(10)), lambda l, i:
    case when (i-1)%12=2 then concat('```',chr(10), l, chr(10),'## not a heading',chr(10),'<!-- page:9 -->',chr(10),'```') else l end), chr(10)) as text
  from md)"""
)

#: lines(doc_id, line_no, line, in_fence) of fenced
LINES = (
    FENCED
    + blanks(r""", raw as (
  select doc_id, generate_subscripts(a, 1) - 1 as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from fenced)
), lines as (
  select *, coalesce(sum(case when regexp_matches(line, '^{W}*(```|~~~)') then 1 else 0 end)
    over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as in_fence from raw)""")
)

#: numbered(doc_id, line_no, line, in_fence, level, num, title) of lines
NUMBERED = (
    LINES
    + blanks(r""", h as (
  select *, case when not in_fence and regexp_matches(line, '^#{2,4}{W}+.') then length(regexp_extract(line, '^(#+)', 1)) end as level from lines
), t as (
  select *, case when level is not null then regexp_replace(regexp_extract(line, '^#{2,4}{W}+(.+?){W}*$', 1), '^(\p{Nd}+(?:\.\p{Nd}+)*){W}+(.*)$', '\2') end as title,
    sum(case when level = 2 then 1 else 0 end) over (partition by doc_id order by line_no) as c2 from h
), u as (
  select *, sum(case when level = 3 then 1 else 0 end) over (partition by doc_id, c2 order by line_no) as c3 from t
), v as (
  select *, sum(case when level = 4 then 1 else 0 end) over (partition by doc_id, c2, c3 order by line_no) as c4 from u
), w as (
  select *, case level when 2 then c2::varchar when 3 then concat(c2, '.', c3) when 4 then concat(c2, '.', c3, '.', c4) end as num from v
), numbered as (
  select doc_id, line_no, case when num is null then line else concat(repeat('#', level), ' ', num, ' ', title) end as line, in_fence, level, num, title from w
), headings as (
  select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as ord, line_no, level, num, title from numbered where num is not null)""")
)


def blocks_text(spark, sf_dir: str) -> DataFrame:
    """[doc_id, text]: residue lines and component blocks made of each document's lines; some unclosed, some repeated."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        blanks(r"""array_join(transform(split(text,'\n'),(l,i)->case
          when i%4=0 then concat('@@', case when i%8=0 then 'explain' else 'summary' end, case when doc_id%2=0 then ' ' else '{wide}' end, cast(i div 4 % 5 + 1 as string), '\n', left(l,80), ' [[c:1]] [[c:', cast(i%7 as string), ']]\n@@end')
          when i%4=1 then concat('##{wide}', left(l,20)) when i%9=5 then '@@{hard}END' when doc_id%11=0 and i%10=3 then concat('@@tip\n', left(l,10)) else l end),'\n') as text"""),
    )


BLOCKS = blanks(r"""bt as (
  select doc_id, array_to_string(list_transform(string_split(text,chr(10)), lambda l, k: case
    when (k-1)%4=0 then concat('@@', case when (k-1)%8=0 then 'explain' else 'summary' end, case when doc_id%2=0 then ' ' else '{wide}' end, cast((k-1)//4 % 5 + 1 as varchar), chr(10), left(l,80), ' [[c:1]] [[c:', cast((k-1)%7 as varchar), ']]', chr(10), '@@end')
    when (k-1)%4=1 then concat('##{wide}', left(l,20)) when (k-1)%9=5 then '@@{hard}END' when doc_id%11=0 and (k-1)%10=3 then concat('@@tip', chr(10), left(l,10)) else l end), chr(10)) as text
  from documents
), braw as (
  select doc_id, generate_subscripts(a, 1) - 1 as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from bt)
), bl as (
  select *, regexp_matches(trim(line), '(?i)^@@{W}*end$') as is_end, case when not regexp_matches(trim(line), '(?i)^@@{W}*end$') then nullif(regexp_extract(trim(line), '^@@([^@{IN_W}]+)(?:{W}+({NOT_W}+))?$', 1), '') end as type,
    regexp_extract(trim(line), '^@@([^@{IN_W}]+)(?:{W}+({NOT_W}+))?$', 2) as target from braw
), bs as (
  select *, coalesce(sum(is_end::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as seg from bl
), bx as (
  select *, min(case when type is not null then line_no end) over (partition by doc_id, seg) as start, max(is_end::int) over (partition by doc_id, seg) = 1 as closed from bs
), by_ as (select *, coalesce(line_no >= start, false) as inside from bx), blocks as (
  select doc_id, row_number() over (partition by doc_id order by seg) - 1 as ord, type, target, content from (
    select doc_id, seg, max(case when line_no = start then type end) as type, max(case when line_no = start then target end) as target,
      trim(coalesce(string_agg(line, chr(10) order by line_no) filter (where line_no > start and not is_end), ''), chr(10) || ' ') as content
    from by_ where inside and closed group by doc_id, seg))""")


_HEADS = ["@@title\\n A  b\\n@@end\\n@@digest\\n d{hard}e\\n@@End\\n", "\\n@@title\\nno\\n@@end\\n", "@@end\\n@@Title\\nx\\n@@end\\n@@digest 1\\nD\\n```\\nf\\n```\\n@@end\\n@@title\\nlate\\n@@end\\n"]


def first_pass_text(spark, sf_dir: str) -> DataFrame:
    """[doc_id, text]: title and digest blocks, headings, summaries with fences and page markers inside, other blocks."""
    heads = "[" + ", ".join(f"'{h}'" for h in _HEADS) + "]"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        blanks(r"""concat(array(HEADS)[cast(doc_id % 3 as int)], array_join(transform(split(text,'\n'),(l,i)->case
          when i%7=0 then concat('##', case when i%14=0 then ' ' else '#{wide}' end, left(l,20))
          when i%7=1 then concat('@@summary 9\n', left(l,40), case when i%2=1 then '\n```\n@@end\n## no\n```' else '\n <!-- page:3 --> ' end, '\n@@tip\n', left(l, 5), '\n@@end')
          when i%7=3 then concat('@@tip\n', l, case when i%2=0 then '\n~~~\n~~~' else '' end, '\n@@end') when i%7=5 then '@@{hard}END' else l end),'\n'),
          case when doc_id%4=0 then '\n@@summary\nunclosed' else '' end) as text""".replace("HEADS", heads[1:-1])),
    )


FIRST_PASS = blanks(r"""fp as (
  select doc_id, concat([HEADS][doc_id % 3 + 1], array_to_string(list_transform(string_split(text,chr(10)), lambda l, k: case
    when (k-1)%7=0 then concat('##', case when (k-1)%14=0 then ' ' else '#{wide}' end, left(l,20))
    when (k-1)%7=1 then concat('@@summary 9', chr(10), left(l,40), case when (k-1)%2=1 then E'\n```\n@@end\n## no\n```' else E'\n <!-- page:3 --> ' end, E'\n@@tip\n', left(l, 5), E'\n@@end')
    when (k-1)%7=3 then concat('@@tip', chr(10), l, case when (k-1)%2=0 then E'\n~~~\n~~~' else '' end, E'\n@@end') when (k-1)%7=5 then '@@{hard}END' else l end), chr(10)),
    case when doc_id%4=0 then E'\n@@summary\nunclosed' else '' end) as text from documents
), fl as (
  select doc_id, generate_subscripts(a, 1) as n, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from fp)
), ff as (
  select *, regexp_matches(line, '^{W}*(```|~~~)') as edge, coalesce(sum(regexp_matches(line, '^{W}*(```|~~~)')::int) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as within,
    regexp_replace(line, '^{W}+|{W}+$', '', 'g') as s from fl
), fk as (
  select *, edge or within as fenced, not edge and not within and regexp_matches(s, '^<!--{W}*page:{W}*(\d+){W}*-->{W}*$') as paged from ff
), fm as (
  select *, not fenced and not paged and regexp_matches(s, '(?i)^@@{W}*end$') as is_end, case when not fenced and not paged and not regexp_matches(s, '(?i)^@@{W}*end$') then nullif(regexp_extract(s, '^@@([^@{IN_W}]+)(?:{W}+({NOT_W}+))?$', 1), '') end as type from fk
), fs as (
  select *, coalesce(sum(is_end::int) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as seg from fm
), fx as (
  select *, min(case when type is not null then n end) over (partition by doc_id, seg) as start, bool_or(is_end) over (partition by doc_id, seg) as closed from fs
), fy as (
  select *, arg_min(type, n) filter (where n = start) over (partition by doc_id, seg) as kind, coalesce(n >= start, false) as inside from fx
), fb as (
  select *, coalesce(bool_or(fenced or paged or (not inside and not is_end)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), false) as body,
    case when not inside and not is_end and not fenced and not paged and regexp_matches(line, '^#{2,4}{W}+.') then length(regexp_extract(line, '^(#+)', 1)) end as level from fy
), c2 as (select *, sum((level = 2)::int) over (partition by doc_id order by n) as a from fb
), c3 as (select *, sum((level = 3)::int) over (partition by doc_id, a order by n) as b from c2
), fn as (
  select *, last_value(case level when 2 then coalesce(a, 0)::varchar when 3 then coalesce(a, 0) || '.' || b end ignore nulls) over (partition by doc_id order by n) as num from c3
), first_pass as (
  select doc_id, seg, any_value(kind) as kind, coalesce(any_value(case when n = start then num end), '') as num, bool_or(body) filter (where n = start) as late,
    coalesce(string_agg(case when paged then '<span class="page-anchor" data-page="' || regexp_extract(s, '(\d+)', 1) || '"></span>' else line end, chr(10) order by n) filter (where n > start and not is_end and (kind = 'summary' or not (fenced or paged))), '') as content
  from fn where inside and closed group by doc_id, seg)""".replace("HEADS", ", ".join(f"E'{h}'" for h in _HEADS)))

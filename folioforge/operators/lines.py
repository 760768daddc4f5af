"""Document structure from line tables.

A document is exploded into lines once, after one exchange by document; every window below shares that partitioning and
order, so none of them shuffles again. State machines are running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import SPACE, is_blank, marked, num_of, rstrip, strip, unnumbered
from folioforge.session import spread

# fixed values: patterns of lines
FENCE = rf"^{SPACE}*(```|~~~)"
PAGE = rf"(?d)^<!--{SPACE}*page:{SPACE}*(\d+){SPACE}*-->{SPACE}*$"
PAGE_TAIL = rf"(?d)<!--{SPACE}*page:{SPACE}*(\d+){SPACE}*-->{SPACE}*$"
HEADING = rf"(?d)^(#{{2,4}}){SPACE}+(.+?){SPACE}*$"
LEGACY_PAGE = rf"(?d)[（(]{SPACE}*p\.{SPACE}*(\d+)(?:{SPACE}*[–—－\-~〜～−]{SPACE}*\d+)?{SPACE}*[）)]{SPACE}*$"


def _doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _after():
    return _doc().rowsBetween(1, Window.unboundedFollowing)


def _count(test: Column, w) -> Column:
    return F.coalesce(F.sum(test.cast("int")).over(w), F.lit(0))


def _fenced(lines: DataFrame) -> DataFrame:
    """in_fence: an odd number of earlier lines opens or closes a fence."""
    return lines.withColumn("in_fence", _count(marked(F.col("line"), ("```", "~~~"), FENCE), _before()) % 2 == 1)


def _joined(lines: DataFrame, *keys: str, text: str = "line", name: str = "text") -> DataFrame:
    """Lines put together again, in order, per key."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", F.col(text).alias("x"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r.x), "\n").alias(name))


def explode_lines(df: DataFrame, placed: bool = False) -> DataFrame:
    """[doc_id, line_no, line, in_fence], line numbers from 0 (D1). ``placed``: the documents already lie by doc_id, so
    they are not exchanged first."""
    docs = df.select("doc_id", "text")
    docs = docs if placed else spread(docs, "doc_id")
    return _fenced(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")))


def page_blocks(df: DataFrame) -> DataFrame:
    """[doc_id, ord, page_no, text]: blocks that start at full-line page markers; fences do not matter."""
    lines = spread(df.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("ord", _count(marked(F.col("line"), "<!--", PAGE), _so_far()))
    page = F.when(F.contains("line", F.lit("<!--")), F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    blocks = lines.withColumn("page", page).groupBy("doc_id", "ord").agg(F.max("page").alias("page_no"), F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("text"))
    return blocks.filter((F.col("ord") > 0) | ~is_blank(F.col("text"))).select("doc_id", "ord", "page_no", "text")


def strip_page_markers(df: DataFrame) -> DataFrame:
    """[doc_id, text, n_stripped]: markers outside fences go, then runs of blank lines outside fences shrink to one (D3).

    Markers never open or close a fence, so the fence flags of what is left are those of the lines before.
    """
    whole = ~F.col("in_fence") & F.contains("line", F.lit("<!--")) & strip(F.col("line")).rlike(PAGE)
    tail = ~F.col("in_fence") & ~F.col("whole") & marked(F.col("line"), "<!--", PAGE_TAIL)
    rows = explode_lines(df).withColumn("whole", whole).withColumn("tail", tail)
    rows = rows.withColumn("line", F.when(F.col("tail"), rstrip(F.regexp_replace("line", PAGE_TAIL, ""))).otherwise(F.col("line")))
    rows = rows.withColumn("blank", F.when(~F.col("whole"), ~F.col("in_fence") & is_blank(F.col("line"))))
    again = F.coalesce(F.last("blank", ignorenulls=True).over(_before()), F.lit(False)) & F.col("blank")
    kept = F.when(~F.col("whole") & ~F.col("again"), F.struct("line_no", "line"))
    out = rows.withColumn("again", again).groupBy("doc_id").agg(F.sort_array(F.collect_list(kept)).alias("l"), F.sum((F.col("whole") | F.col("tail")).cast("int")).cast("int").alias("n_stripped"))
    return out.select("doc_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"), "n_stripped")


def heading_lines(lines: DataFrame) -> DataFrame:
    """Adds level (2 to 4, null elsewhere) and title to a line table."""
    is_heading = ~F.col("in_fence") & marked(F.col("line"), "##", HEADING, at_start=True)
    return lines.withColumns({"level": F.when(is_heading, F.length(F.regexp_extract("line", HEADING, 1))), "title": F.when(is_heading, F.regexp_extract("line", HEADING, 2))})


def numbered_lines(df: DataFrame, placed: bool = False) -> DataFrame:
    """[doc_id, line_no, line, in_fence, level, num, title]: headings carry their new number."""
    rows = heading_lines(explode_lines(df, placed)).withColumn("title", unnumbered(F.col("title")))
    at = lambda k: F.coalesce(F.col("level") == k, F.lit(False))
    c2 = rows.withColumn("c2", _count(at(2), _so_far()))
    w3 = Window.partitionBy("doc_id", "c2").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    c3 = c2.withColumn("c3", _count(at(3), w3))
    w4 = Window.partitionBy("doc_id", "c2", "c3").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    num = F.when(at(2), F.col("c2").cast("string")).when(at(3), F.concat_ws(".", "c2", "c3")).when(at(4), F.concat_ws(".", "c2", "c3", _count(at(4), w4)))
    out = c3.withColumn("num", num)
    line = F.when(F.col("num").isNotNull(), F.concat_ws(" ", F.repeat(F.lit("#"), F.col("level")), "num", "title")).otherwise(F.col("line"))
    return out.select("doc_id", "line_no", line.alias("line"), "in_fence", "level", "num", "title")


def headings_of(numbered: DataFrame) -> DataFrame:
    """[doc_id, ord, line_no, level, num, title] of a numbered line table, ord from 0."""
    h = numbered.filter(F.col("num").isNotNull())
    return h.select("doc_id", (F.row_number().over(_doc()) - 1).alias("ord"), "line_no", "level", "num", "title")


def number_headings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts[doc_id, text], headings)."""
    rows = numbered_lines(df)
    return _joined(rows, "doc_id"), headings_of(rows)


def with_line_ends(numbered: DataFrame) -> DataFrame:
    """Adds line_end to a numbered line table: where the section of a heading ends, null on other lines."""
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(_after()) for k in (2, 3, 4)]
    rows = numbered.withColumns({"_last": last, "_n2": nexts[0], "_n3": nexts[1], "_n4": nexts[2]})
    following = F.when(F.col("level") == 2, F.col("_n2")).when(F.col("level") == 3, F.col("_n3")).otherwise(F.col("_n4"))
    end = F.when(F.col("num").isNotNull(), F.coalesce(following - 1, F.col("_last")))
    return rows.withColumn("line_end", end).select(*numbered.columns, "line_end")


def section_spans(numbered: DataFrame) -> DataFrame:
    """Headings with line_start and line_end; a section ends before the next heading of its level or above."""
    rows = with_line_ends(numbered).filter(F.col("num").isNotNull())
    return rows.select("doc_id", (F.row_number().over(_doc()) - 1).alias("ord"), "level", "num", "title", F.col("line_no").alias("line_start"), "line_end")


def build_toc(headings: DataFrame) -> DataFrame:
    """[doc_id, toc]."""
    row = F.concat(F.repeat(F.lit("  "), F.col("level") - 2), F.lit("- "), F.col("num"), F.lit(" "), F.col("title"))
    rows = F.sort_array(F.collect_list(F.struct("ord", row.alias("x"))))
    return headings.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r.x), "\n").alias("toc"))


def recent_headings(df: DataFrame, n: int = 3) -> DataFrame:
    """[doc_id, headings]: the last n headings as they stand."""
    h = heading_lines(explode_lines(df)).filter(F.col("level").isNotNull())
    h = h.withColumn("back", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("line_no")))).filter(F.col("back") <= n)
    shown = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))
    return _joined(h.withColumn("x", shown), "doc_id", text="x", name="headings")


def breadcrumbs(headings: DataFrame, mode: str = "reference", depth: int = 3) -> DataFrame:
    """Adds breadcrumb (D8). ``reference``: the last ``depth`` headings so far of the same or a higher level, earlier
    siblings included. ``ancestors``: the path of enclosing headings. State is the last ``depth`` of each level."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    label = F.concat_ws(" ", "num", "title")
    if mode == "ancestors":
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        above = [F.last(F.when(F.col("level") == k, F.struct("ord", label.alias("x"), F.lit(k).alias("k"))), ignorenulls=True).over(up) for k in (2, 3, 4)]
        rows = headings.withColumn("path", F.filter(F.array(*above), lambda x: x.isNotNull() & (x.k <= F.col("level"))))
        # a deeper heading of an earlier branch is older than its would-be parent
        path = F.filter("path", lambda x, i: ~F.exists(F.slice("path", F.lit(1), F.greatest(i, F.lit(0))), lambda y: y.ord > x.ord))
        return rows.withColumn("breadcrumb", F.array_join(F.transform(F.slice(path, F.greatest(F.size(path) - depth + 1, F.lit(1)), F.lit(depth)), lambda x: x.x), " > ")).drop("path")
    of_level = Window.partitionBy("doc_id", "level").orderBy("ord").rowsBetween(-(depth - 1), 0)
    rows = headings.withColumn("_own", F.collect_list(F.struct("ord", label.alias("x"))).over(of_level))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_l{k}s": F.last(F.when(F.col("level") == k, F.col("_own")), ignorenulls=True).over(up) for k in (2, 3, 4)})
    none = F.array().cast("array<struct<ord: int, x: string>>")
    seen = F.concat(*(F.when(F.col("level") >= k, F.coalesce(F.col(f"_l{k}s"), none)).otherwise(none) for k in (2, 3, 4)))
    last = F.reverse(F.slice(F.reverse(F.sort_array(seen)), 1, depth))
    rows = rows.withColumn("breadcrumb", F.array_join(F.transform(last, lambda x: x.x), " > "))
    return rows.select(*headings.columns, "breadcrumb")


def leaf_sections(headings: DataFrame) -> DataFrame:
    """Headings under which no deeper number stands; deeper ones would follow directly."""
    following = F.lead("num").over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = headings.withColumn("_next", following)
    return rows.filter(F.col("_next").isNull() | ~F.col("_next").startswith(F.concat("num", F.lit(".")))).drop("_next")


def split_sections(df: DataFrame, level: int = 2) -> DataFrame:
    """[doc_id, ord, num, content]: parts that start at headings of ``level`` outside fences.

    Level 2: a non-blank preamble has no number, a text without headings is one part. Level 3: a preamble carries the
    number of the ``##`` it starts with, a text without headings gives nothing.
    """
    lines = heading_lines(explode_lines(df))
    here = F.coalesce(F.col("level") == level, F.lit(False))
    lines = lines.withColumn("ord", _count(here, _so_far())).withColumn("n", F.sum(here.cast("int")).over(Window.partitionBy("doc_id")))
    start = F.first("title").over(Window.partitionBy("doc_id", "ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    first_level = F.first("level").over(Window.partitionBy("doc_id", "ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    own = num_of(F.when((F.col("ord") > 0) | ((first_level == 2) & F.lit(level == 3)), start))
    lines = lines.withColumn("num", own)
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    parts = lines.groupBy("doc_id", "ord").agg(F.max("num").alias("num"), F.max("n").alias("n"), F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("content"))
    keep = (F.col("ord") > 0) | ~is_blank(F.col("content")) & (F.col("n") > 0)
    keep = keep | (F.col("n") == 0) if level == 2 else keep
    return parts.filter(keep).select("doc_id", "ord", "num", "content")


def page_anchors(df: DataFrame) -> DataFrame:
    """[doc_id, line_no, page, section_num, src]: page markers outside fences with the section they fall in; documents
    without any use the page labels at the end of their headings instead (D11)."""
    rows = numbered_lines(df)
    marker = F.when(~F.col("in_fence"), F.nullif(F.regexp_extract("line", PAGE_TAIL, 1), F.lit(""))).cast("int")
    label = F.when(F.col("num").isNotNull(), F.nullif(F.regexp_extract("line", LEGACY_PAGE, 1), F.lit(""))).cast("int")
    rows = rows.withColumns({"marker": marker, "label": label, "section_num": F.last("num", ignorenulls=True).over(_so_far())})
    rows = rows.withColumn("has", F.max(F.col("marker").isNotNull()).over(Window.partitionBy("doc_id")))
    page = F.when(F.col("has"), F.col("marker")).otherwise(F.col("label"))
    src = F.when(F.col("has"), "marker").otherwise("heading")
    return rows.withColumn("page", page).filter(F.col("page").isNotNull()).select("doc_id", "line_no", "page", "section_num", src.alias("src"))

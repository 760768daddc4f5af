"""Component blocks ``@@type [target]`` ... ``@@end`` in texts, by running sums over line tables."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import NO_SPACE, SPACE, strip, unnumbered
from folioforge.operators.lines import HEADING
from folioforge.session import broadcast_if_small, spread

# fixed values: patterns of lines, without the white space around them
END = rf"(?i)^@@{SPACE}*end$"
START = rf"^@@([^@{SPACE[1:-1]}]+)(?:{SPACE}+({NO_SPACE}+))?$"


def _doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _before():
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _lines(df: DataFrame) -> DataFrame:
    rows = spread(df.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s, at = strip(F.col("line")), F.contains("line", F.lit("@@"))
    rows = rows.withColumns({"is_end": at & s.rlike(END), "type": F.when(at, F.nullif(F.regexp_extract(s, START, 1), F.lit(""))), "target": F.when(at, F.regexp_extract(s, START, 2)).otherwise("")})
    return rows.withColumn("type", F.when(~F.col("is_end"), F.col("type")))


def _cut(rows: DataFrame, opens: Column, ends: Column) -> DataFrame:
    """seg: ends so far; start: first opening line of the segment; closed: the segment has its end line."""
    seg = F.coalesce(F.sum(ends.cast("int")).over(_before()), F.lit(0))
    own = Window.partitionBy("doc_id", "seg")
    rows = rows.withColumn("seg", seg)
    start = F.min(F.when(opens, F.col("line_no"))).over(own)
    return rows.withColumns({"start": start, "closed": F.max(ends).over(own), "ends": ends}).withColumn("inside", F.coalesce(F.col("line_no") >= F.col("start"), F.lit(False)))


def _text(*by: str, name: str = "text", value: str | Column = "line"):
    rows = F.sort_array(F.collect_list(F.struct("line_no", (F.col(value) if isinstance(value, str) else value).alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r.x), "\n").alias(name)


def parse_blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks[doc_id, ord, type, target, content], residue[doc_id, text, unclosed]).

    Stray ends are dropped, start lines inside a block are content, an unclosed block goes back to the residue.
    """
    rows = _cut(_lines(df), F.col("type").isNotNull(), F.col("is_end"))
    head = F.when(F.col("line_no") == F.col("start"), F.struct("type", "target"))
    inner = rows.filter(F.col("inside") & F.col("closed"))
    body = F.when((F.col("line_no") > F.col("start")) & ~F.col("is_end"), F.struct("line_no", "line"))
    blocks = inner.groupBy("doc_id", "seg").agg(F.max(head).alias("h"), F.sort_array(F.collect_list(body)).alias("b"))
    blocks = blocks.select("doc_id", "seg", "h.type", "h.target", strip(F.array_join(F.transform("b", lambda r: r.line), "\n")).alias("content"))
    blocks = blocks.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1)
    rest = rows.filter(~F.col("is_end") & ~(F.col("inside") & F.col("closed")))
    shown = F.when(F.col("line_no") == F.col("start"), F.concat(F.lit("@@"), "type", F.when(F.col("target") != "", F.concat(F.lit(" "), "target")).otherwise(""))).otherwise(F.col("line"))
    left = rest.withColumn("line", shown).groupBy("doc_id").agg(_text())
    state = rows.groupBy("doc_id").agg(F.max(F.col("inside") & ~F.col("closed")).alias("unclosed"))
    return blocks.select("doc_id", "ord", "type", "target", "content"), state.join(left, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "unclosed")


def serialize_blocks(blocks: DataFrame) -> DataFrame:
    """[doc_id, text]: blocks in order, one blank line between; the inverse of parsing."""
    tag = F.concat(F.lit("@@"), "type", F.when(F.coalesce("target", F.lit("")) != "", F.concat(F.lit(" "), "target")).otherwise(""))
    rows = F.sort_array(F.collect_list(F.struct("ord", F.concat_ws("\n", tag, "content", F.lit("@@end")).alias("x"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r.x), "\n\n").alias("text"))


def cut_after_last_block(df: DataFrame, block_type: str) -> DataFrame:
    """[doc_id, text]: cut after the last complete block of the type, null without one; here a start inside a block
    switches the type (D13)."""
    rows = _lines(df)
    mark = F.when(F.col("is_end"), "end").when(F.col("type") == block_type, "this").when(F.col("type").isNotNull(), "other")
    rows = rows.withColumn("mark", mark).withColumn("prev", F.last("mark", ignorenulls=True).over(_before()))
    last = F.max(F.when((F.col("mark") == "end") & (F.col("prev") == "this"), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("last", last)
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("line_no") <= F.col("last"), F.struct("line_no", "line")))).alias("r"), F.max("last").alias("last")).select(
        "doc_id", F.when(F.col("last").isNotNull(), F.array_join(F.transform("r", lambda x: x.line), "\n")).alias("text")
    )


def harvest_title_digest(parts: DataFrame, empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parts[doc_id, part, text], info[doc_id, title, digest]) (D14): title and digest blocks leave every part, the first
    complete non-empty one of part 1 counts; an unclosed one is dropped to the end of its part. ``empty``: a complete one
    without text counts too, as an empty title or digest."""
    rows = parts.select(F.struct("doc_id", "part").alias("doc_id"), "text")
    rows = _lines(rows)
    kind = F.lower(F.regexp_extract(strip(F.col("line")), r"(?i)^@@(title|digest)$", 1))
    rows = rows.withColumn("kind", F.nullif(kind, F.lit("")))
    rows = _cut_open(rows)
    cleaned = rows.groupBy("doc_id").agg(_text(value=F.when(~F.col("taken"), F.col("line")))).select("doc_id.doc_id", "doc_id.part", "text")
    inner = rows.filter(F.col("taken") & F.col("closed") & (F.col("doc_id.part") == 1))
    body = F.when((F.col("line_no") > F.col("start")) & ~F.col("is_end"), F.struct("line_no", "line"))
    found = inner.groupBy("doc_id", "seg").agg(F.max(F.when(F.col("line_no") == F.col("start"), F.col("kind"))).alias("kind"), F.sort_array(F.collect_list(body)).alias("b"))
    value = strip(F.regexp_replace(F.array_join(F.transform("b", lambda r: r.line), "\n"), f"{SPACE}+", " "))
    found = found.select(F.col("doc_id.doc_id").alias("doc_id"), "seg", "kind", value.alias("value"))
    found = found if empty else found.filter("value <> ''")
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("seg")))
    info = found.groupBy("doc_id").agg(first("title").alias("title"), first("digest").alias("digest"))
    return cleaned, parts.select("doc_id").distinct().join(info, "doc_id", "left")


def _cut_open(rows: DataFrame) -> DataFrame:
    """Segments for blocks of two kinds only: an end line outside them is ordinary text, so a segment ends at the first
    end after its start, and the next start opens a new one."""
    mark = F.when(F.col("is_end"), F.lit("end")).when(F.col("kind").isNotNull(), F.lit("start"))
    rows = rows.withColumn("mark", mark).withColumn("prev", F.last("mark", ignorenulls=True).over(_before()))
    # a start counts when the marker before it is none or an end; an end counts when the one before is a start
    rows = rows.withColumns({"opens": (F.col("mark") == "start") & (F.coalesce("prev", F.lit("end")) == "end"), "ends": (F.col("mark") == "end") & (F.coalesce("prev", F.lit("end")) == "start")})
    rows = rows.withColumn("opens", F.coalesce("opens", F.lit(False))).withColumn("ends", F.coalesce("ends", F.lit(False)))
    return _cut(rows.drop("type"), F.col("opens"), F.col("ends")).withColumn("taken", F.col("inside"))


def split_raw(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bodies[doc_id, text, stray, unclosed], summaries[doc_id, ord, h2, content]) (D15). All blocks leave the body; an
    unclosed one runs to the end and still counts; the ``##`` line before a summary is its title, fences notwithstanding."""
    rows = _cut(_lines(df), F.col("type").isNotNull(), F.col("is_end"))
    h2 = F.when(~F.col("inside") & ~F.col("is_end") & (F.regexp_extract("line", HEADING, 1) == "##"), strip(F.regexp_extract("line", HEADING, 2)))
    rows = rows.withColumn("h2", F.last(h2, ignorenulls=True).over(_doc().rowsBetween(Window.unboundedPreceding, 0)))
    head = F.when(F.col("line_no") == F.col("start"), F.struct("type", "h2"))
    body = F.when((F.col("line_no") > F.col("start")) & ~F.col("is_end"), F.struct("line_no", "line"))
    inner = rows.filter("inside").groupBy("doc_id", "seg").agg(F.max(head).alias("h"), F.sort_array(F.collect_list(body)).alias("b"))
    inner = inner.select("doc_id", "seg", "h.type", "h.h2", strip(F.array_join(F.transform("b", lambda r: r.line), "\n")).alias("content"))
    is_summary = (F.col("type") == "summary") & (F.col("content") != "")
    summaries = inner.filter(is_summary).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1)
    stray = inner.groupBy("doc_id").agg(F.sum((~is_summary).cast("int")).alias("stray"))
    bodies = rows.filter(~F.col("is_end") & ~F.col("inside")).groupBy("doc_id").agg(_text())
    state = rows.groupBy("doc_id").agg(F.max(F.col("inside") & ~F.col("closed")).alias("unclosed"))
    out = state.join(stray, "doc_id", "left").join(bodies, "doc_id", "left")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("stray", F.lit(0)).cast("int").alias("stray"), "unclosed"), summaries.select("doc_id", "ord", "h2", "content")


def _norm_title(c: Column) -> Column:
    t = unnumbered(F.coalesce(c, F.lit("")))
    return strip(F.regexp_replace(t, rf"(?d)[（(]{SPACE}*p\.[^）)]*[）)]{SPACE}*$", ""))


def assign_summaries(summaries: DataFrame, headings: DataFrame) -> DataFrame:
    """[doc_id, ord, num, content]: each summary goes to the first unused ``##`` with its normalised title, else to the
    first unused one, else nowhere. Greedy, so one small Arrow helper walks the two short lists of a document."""
    s = summaries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", _norm_title(F.col("h2")).alias("t"), "content"))).alias("s"))
    h = headings.filter("level = 2").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "num", _norm_title(F.col("title")).alias("t")))).alias("h"))
    both = s.join(h, "doc_id")
    wanted, offered = F.transform("s", lambda x: x.t), F.transform("h", lambda x: x.t)
    both = both.withColumn("to", _greedy(wanted, offered))
    rows = both.select("doc_id", "h", F.explode(F.arrays_zip("s", "to")).alias("x")).filter(F.col("x.to") >= 0)
    return rows.select("doc_id", "x.s.ord", F.get("h", F.col("x.to"))["num"].alias("num"), "x.s.content")


def _assign(wanted: list[str], offered: list[str]) -> list[int]:
    """A queue of places per title and a pointer to the first free place, so every place is passed once."""
    places: dict[str, deque[int]] = {}
    for i, title in enumerate(offered):
        places.setdefault(title, deque()).append(i)
    used, first, out = [False] * len(offered), 0, []
    for title in wanted:
        own = places.get(title, ())
        while own and used[own[0]]:
            own.popleft()
        while first < len(offered) and used[first]:
            first += 1
        at = own.popleft() if own else first if first < len(offered) else -1
        if at >= 0:
            used[at] = True
        out.append(at)
    return out


def _greedy(wanted: Column, offered: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(w: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([_assign(list(a), list(b)) for a, b in zip(w, o)])

    return run(wanted, offered)


def _judged(blocks: DataFrame, keys: list[str], order: list[str], allowed: DataFrame | None, skip_empty: bool) -> DataFrame:
    """``blocks`` with ``_why`` a block is dropped, null where it stays."""
    rows = blocks.withColumn("_known", F.lit(True))
    if allowed is not None:
        known = broadcast_if_small(allowed.select("type").distinct().withColumn("_known", F.lit(True)), 10_000)
        rows = blocks.join(known, "type", "left").withColumn("_known", F.col("_known").isNotNull())
    rows = rows.withColumn("_out", F.when(~F.col("_known"), "unknown").when(F.lit(skip_empty) & (F.coalesce("content", F.lit("")) == ""), "empty"))
    place = F.row_number().over(Window.partitionBy("doc_id", F.col("_out").isNull(), *keys).orderBy(*order))
    return rows.withColumn("_why", F.coalesce("_out", F.when(place > 1, "repeated")))


def keep_first_blocks(blocks: DataFrame, keys: list[str], order: list[str], allowed: DataFrame | None = None, skip_empty: bool = True) -> DataFrame:
    """The first block of each document and key, of allowed types only (D16); ``allowed`` has a column type. Chunking and
    assembly pass over empty blocks; the second pass keeps the first of a key, empty or not (``skip_empty=False``)."""
    return _judged(blocks, keys, order, allowed, skip_empty).filter("_why is null").select(blocks.columns)


def dropped_blocks(blocks: DataFrame, keys: list[str], order: list[str], allowed: DataFrame | None = None, skip_empty: bool = True) -> DataFrame:
    """[doc_id, unknown, empty, repeated]: how many blocks ``keep_first_blocks`` drops from each document that has any, and why."""
    why = [F.count(F.when(F.col("_why") == w, 1)).alias(w) for w in ("unknown", "empty", "repeated")]
    return _judged(blocks, keys, order, allowed, skip_empty).groupBy("doc_id").agg(*why)

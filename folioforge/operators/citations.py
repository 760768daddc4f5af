"""Citations: references of blocks, global numbers, document assembly, audit, image names."""

from __future__ import annotations

import difflib
import itertools
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import SPACE, cite_numbers, valid_target, wrap_callout
from folioforge.operators.lines import numbered_lines, strip_page_markers, with_line_ends
from folioforge.session import broadcast_if_small, materialize

CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
#: Marks a callout at a section's end until the blank lines before it are settled.
SLOT = "\u0001"
#: Similar names meet by chosen digits where no name has more choices than this.
CHOICES = 64
REF = ["n", "chunk_id", "kb_id", "ref_doc", "doc_name", "anchor", "breadcrumb", "section_num", "text", "kind"]


def cite_mark(idx: Column) -> Column:
    return F.when(idx.between(1, 20), F.lit(CIRCLED).substr(idx.cast("int"), F.lit(1))).otherwise(F.concat(F.lit("["), idx.cast("string"), F.lit("]")))


def block_refs(blocks: DataFrame, fragments: DataFrame) -> DataFrame:
    """[doc_id, type, target, refs] (X1): the distinct numbers of a block that its window's fragments resolve, in order,
    texts cut to 160. Of equal (type, target) the first block with references counts; blocks without are left out."""
    marks = blocks.withColumn("n", F.explode(F.array_distinct(cite_numbers(F.col("content"))))).select("doc_id", "window_id", "ord", "type", "target", "n")
    hit = marks.join(fragments, ["doc_id", "window_id", "n"])
    ref = F.struct(*(F.left("text", F.lit(160)).alias("text") if c == "text" else F.col(c) for c in REF))
    own = hit.groupBy("doc_id", "type", "target", "window_id", "ord").agg(F.sort_array(F.collect_list(ref)).alias("refs"))
    return own.groupBy("doc_id", "type", "target").agg(F.min_by("refs", F.struct("window_id", "ord")).alias("refs"))


def number_citations(blocks: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with marks as numbers, entries[doc_id, idx, line]).

    ``blocks`` [doc_id, part, ord, target, content], ``refs`` [doc_id, part, target, n, ref_doc, anchor, doc_name, breadcrumb, kind].
    Numbers run in order of appearance over parts, blocks and places; equal (document, anchor) share one; marks without
    a reference vanish.
    """
    mark = r"\[\[c:\d+\]\]"
    cut = blocks.withColumns({"pieces": F.split("content", mark), "nums": cite_numbers(F.col("content"))})
    marks = cut.select("doc_id", "part", "ord", "target", F.posexplode("nums").alias("pos", "n"))
    first = refs.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "part", "target", "n").orderBy("ref_doc", "anchor"))).filter("_k = 1").drop("_k")
    hit = marks.join(first, ["doc_id", "part", "target", "n"])
    at = F.struct("part", "ord", "pos")
    key = Window.partitionBy("doc_id", "ref_doc", "anchor")
    hit = hit.withColumn("_at", F.min(at).over(key)).withColumn("idx", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_at")))
    shown = hit.groupBy("doc_id", "part", "ord").agg(F.map_from_entries(F.collect_list(F.struct("pos", cite_mark(F.col("idx")).alias("m")))).alias("shown"))
    rows = cut.join(shown, ["doc_id", "part", "ord"], "left")
    text = F.array_join(F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.try_element_at("shown", i), F.lit("")))), "")
    one = hit.filter(F.col("_at") == at)
    url = F.when((F.col("kind") == "web") | F.col("anchor").rlike("^https?://"), F.concat(F.lit(" ｜ "), "anchor")).otherwise("")
    head = F.when(F.coalesce("doc_name", F.lit("")) != "", F.concat(F.lit("《"), "doc_name", F.lit("》"))).otherwise("（未知文档）")
    crumb = F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.lit(" "), "breadcrumb")).otherwise("")
    return rows.withColumn("content", text).select(blocks.columns), one.select("doc_id", "idx", F.concat(cite_mark(F.col("idx")), F.lit(" "), head, crumb, url).alias("line"))


def assemble(docs: DataFrame, summaries: DataFrame, blocks: DataFrame, entries: DataFrame, toc: bool = True, generated: str = "") -> DataFrame:
    """[doc_id, text] (X3) of docs [doc_id, title, kb_name, source_name, text].

    ``summaries`` [doc_id, num, content] go right after their heading, ``blocks`` [doc_id, part, num, content, header] to the
    end of their section; at one place earlier parts come first and within a part deeper numbers before their ancestors.
    Invalid and missing numbers are left out. ``entries`` is the appendix. Blank lines before a callout at a section's end
    shrink to one. Each input is exchanged once, by document; the rest happens inside a document's row.
    """
    numbered = with_line_ends(numbered_lines(strip_page_markers(docs).select("doc_id", "text"), placed=True))
    lined = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "level", "num", "title", "line_end"))).alias("l"))
    lined = lined.withColumn("h", F.filter("l", lambda x: x.num.isNotNull()))
    s = summaries.filter(valid_target(F.col("num"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("num", "content"))).alias("s"))
    order = F.struct("part", "num", "header", "content")
    by_place = lambda a, b: F.when(a.part != b.part, F.when(a.part < b.part, -1).otherwise(1)).when(a.num > b.num, -1).when(a.num < b.num, 1).otherwise(0)
    b = blocks.filter(valid_target(F.col("num"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(order), by_place).alias("b"))
    notes = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("e")).select("doc_id", F.array_join(F.transform("e", lambda r: r.line), "\n").alias("notes"))
    rows = docs.drop("text").join(lined, "doc_id").join(s, "doc_id", "left").join(b, "doc_id", "left").join(notes, "doc_id", "left")

    # every piece has its line, its rank there and its turn within that; one sort lays them out
    piece = "array<struct<at: int, rank: int, turn: int, x: string>>"
    none = F.array().cast(piece)
    at = lambda c, n: F.try_element_at(c, n)
    rows = rows.withColumns({c: F.map_from_entries(F.transform("h", lambda x: F.struct(x.num, x[f]))) for c, f in (("starts", "line_no"), ("ends", "line_end"))})  # noqa: B023
    placed = lambda p, c, rank, text: F.filter(F.coalesce(F.transform(p, lambda x, i: F.struct(at(c, x.num).alias("at"), F.lit(rank).alias("rank"), i.alias("turn"), text(x).alias("x"))).cast(piece), none), lambda x: x["at"].isNotNull())
    rows = rows.withColumn("b", placed("b", "ends", 2, lambda x: F.concat(F.lit(SLOT), wrap_callout(x.header, x.content))))
    rows = rows.withColumn("s", placed("s", "starts", 1, lambda x: F.concat(F.lit("\n"), wrap_callout(F.lit("> [!note] 本节摘要"), x.content), F.lit("\n"))))
    own = F.transform("l", lambda x: F.struct(x.line_no.alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("turn"), x.line.alias("x"))).cast(piece)
    after = F.transform(F.filter(F.array_distinct(F.transform("b", lambda x: x["at"])), lambda x: x < F.size("l") - 1), lambda x: F.struct(x.alias("at"), F.lit(3).alias("rank"), F.lit(0).alias("turn"), F.lit("").alias("x"))).cast(piece)
    body = F.array_join(F.transform(F.sort_array(F.concat(own, F.col("s"), F.col("b"), after)), lambda x: x.x), "\n")
    body = F.regexp_replace(F.regexp_replace(body, rf"(?:\n{SPACE}*)?\n{SLOT}", "\n\n"), r"^\n+|\n+$", "")
    shown = F.array_join(F.transform("h", lambda x: F.concat(F.repeat(F.lit("  "), x.level - 2), F.lit("- "), x.num, F.lit(" "), x.title)), "\n")
    header = F.concat(F.lit("> [!info] 知识库："), "kb_name", F.lit(" ｜ 源文件：`"), "source_name", F.lit(f"` ｜ 生成：{generated}\n\n# "), "title", F.lit("\n\n"))
    contents = F.concat(F.lit("## 目录\n\n"), shown, F.lit("\n\n")) if toc else F.lit("")
    tail = F.when(F.col("notes").isNotNull(), F.concat(F.lit("\n## 引用来源\n\n"), "notes", F.lit("\n"))).otherwise("")
    return rows.select("doc_id", F.concat(header, contents, body, F.lit("\n"), tail).alias("text"))


def audit_citations(texts: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """[doc_id, block, n, problem] (X4): ``dangling`` marks without a reference, ``unused`` references, and ``stale`` ones whose
    chunk (kb, document, anchor) is gone; web references are not looked up."""
    marks = texts.select("doc_id", "block", F.explode(F.array_distinct(cite_numbers(F.col("text")))).alias("n")).withColumn("m", F.lit(True))
    held = refs.select("doc_id", "block", "n").distinct().withColumn("r", F.lit(True))
    both = marks.join(held, ["doc_id", "block", "n"], "full_outer").filter("m is null or r is null")
    live = chunks.select("kb_id", F.col("doc_id").alias("ref_doc"), "anchor").distinct()
    stale = refs.filter(F.coalesce("kind", F.lit("kb")) != "web").join(live, ["kb_id", "ref_doc", "anchor"], "left_anti")
    return both.select("doc_id", "block", "n", F.when(F.col("r").isNull(), "dangling").otherwise("unused").alias("problem")).unionByName(stale.select("doc_id", "block", "n", F.lit("stale").alias("problem")))


def assembly_warnings(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """[doc_id, num, problem] (X3): pieces [doc_id, num] that ``assemble`` leaves out of docs [doc_id, text], as their number is
    ``invalid`` or ``missing``, one row for each piece."""
    held = numbered_lines(strip_page_markers(docs).select("doc_id", "text")).filter("num is not null").select("doc_id", "num").distinct()
    bad = pieces.filter(~F.coalesce(valid_target(F.col("num")), F.lit(False))).select("doc_id", "num", F.lit("invalid").alias("problem"))
    gone = pieces.filter(valid_target(F.col("num"))).join(held, ["doc_id", "num"], "left_anti").select("doc_id", "num", F.lit("missing").alias("problem"))
    return bad.unionByName(gone)


def _counted(text: Column) -> Column:
    """The characters of a text, equal ones counted, so that two texts share as many of these as they share characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def _rare_first(names: DataFrame, cutoff: float, often: DataFrame) -> DataFrame:
    """[dir, name, size, token, rare]: the rarest characters of each name, as many as leave out no pair, one a row and all of them in
    order. A ratio of ``cutoff`` takes so many common characters (equal ones counted) that two such names must share one among the
    rarest of both."""
    rows = names.select("dir", "name", F.char_length("name").alias("size"), F.explode(_counted(F.col("name"))).alias("token"))
    rows = rows.join(broadcast_if_small(often, 100_000), "token", "left")
    place = F.row_number().over(Window.partitionBy("dir", "name").orderBy(F.coalesce("n", F.lit(0)), "token"))
    shared = F.greatest(F.ceil(F.col("size") * (cutoff / (2 - cutoff)) - 1e-9), F.lit(1))
    rows = rows.withColumn("place", place).filter(F.col("place") <= F.col("size") - shared + 1)
    every = Window.partitionBy("dir", "name").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("dir", "name", "size", "token", F.collect_list("token").over(every).alias("rare"))


def _near_shapes(refs: DataFrame, manifest: DataFrame, cutoff: float) -> DataFrame:
    """[dir, name, other]: distinct pairs among which are all whose ratio can reach ``cutoff``, each made where its first shared rare
    character is, so that they need no exchange here."""
    often = materialize(manifest.select(F.explode(_counted(F.col("name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    asked, held = _rare_first(refs, cutoff, often), _rare_first(manifest, cutoff, often)
    pairs = asked.join(held.select("dir", F.col("name").alias("other"), F.col("size").alias("o"), "token", F.col("rare").alias("own")), ["dir", "token"])
    long = 2 * F.least("size", "o") >= cutoff * (F.col("size") + F.col("o")) - 1e-9
    return pairs.filter(long & (F.get(F.array_intersect("rare", "own"), F.lit(0)) == F.col("token"))).select("dir", "name", "other")


def _near_blocks(refs: DataFrame, manifest: DataFrame, cutoff: float, block_names: int) -> DataFrame:
    """[dir, name, names]: each name with those of its directory, at most ``block_names`` in a row, among which are all whose ratio
    reaches ``cutoff``.

    Names are first compared by shape, in which every digit is a 0. What two shapes can share of other characters tells how many digits
    two names must share, in order; names meet by each choice of so many of their digits, where there are at most ``CHOICES``. Else
    all names of both shapes meet, block by block. Pairs of shapes are written and exchanged, which for names without digits are pairs of
    names; else only names and numbers of blocks are.
    """
    shaped = lambda df: materialize(df.select("dir", "name", F.regexp_replace("name", "[0-9]", "0").alias("shape"), F.regexp_replace("name", "[^0-9]", "").alias("digits")).dropna())
    asked, held = shaped(refs), shaped(manifest)
    shapes = lambda df: df.select("dir", F.col("shape").alias("name")).distinct()
    other = lambda c: F.replace(c, F.lit("0"), F.lit(""))
    digits = lambda c: F.char_length(c) - F.char_length(other(c))
    ways = lambda n: F.when(n == F.col("need"), 1).otherwise(F.coalesce(F.factorial(n) / (F.factorial("need") * F.factorial(n - F.col("need"))), F.lit(float("inf"))))
    pairs = _near_shapes(shapes(asked), shapes(held), cutoff).withColumns({"n": digits("name"), "o": digits("other")})
    shared = F.size(F.array_intersect(_counted(other("name")), _counted(other("other"))))
    need = F.ceil((F.char_length("name") + F.char_length("other")) * (cutoff / 2) - 1e-9) - shared
    pairs = pairs.withColumn("need", F.greatest(need, F.lit(0)).cast("int")).filter(F.col("need") <= F.least("n", "o"))
    few = (F.col("need") > 1) & (F.greatest(ways(F.col("n")), ways(F.col("o"))) <= CHOICES)
    pairs = materialize(pairs.select("dir", F.col("name").alias("shape"), F.col("other").alias("held"), F.when(few, F.col("need")).otherwise(0).alias("need")))

    @F.pandas_udf("array<string>")
    def choices(digits: pd.Series, need: pd.Series) -> pd.Series:
        return pd.Series([sorted({"".join(c) for c in itertools.combinations(d, n)}) for d, n in zip(digits, need)], dtype=object)

    key = F.explode(choices("digits", "need")).alias("key")
    asked = asked.join(broadcast_if_small(pairs), ["dir", "shape"]).select("dir", "name", "held", "need", key)
    kinds = pairs.select("dir", "held", "need").distinct()
    held = held.withColumnRenamed("shape", "held").join(broadcast_if_small(kinds), ["dir", "held"]).select("dir", "name", "held", "need", key)
    at = ["dir", "held", "need", "key"]
    block = ((F.row_number().over(Window.partitionBy(*at).orderBy("name")) - 1) / block_names).cast("int")
    blocks = materialize(held.withColumn("block", block).groupBy(*at, "block").agg(F.sort_array(F.collect_list("name")).alias("names")))
    last = blocks.groupBy(*at).agg(F.max("block").alias("last"))
    met = asked.join(last, at).select("name", *at, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"))
    spark = refs.sparkSession  # a stated number of parts is not merged again: a row stands for many comparisons
    met = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *at, "block")
    return met.join(blocks, [*at, "block"]).select("dir", "name", "names")


def near_candidates(refs: DataFrame, manifest: DataFrame, cutoff: float) -> DataFrame:
    """[dir, name, other]: distinct pairs within a directory among which are all whose ratio reaches ``cutoff``."""
    return _near_blocks(refs, manifest, cutoff, 512).select("dir", "name", F.explode("names").alias("other")).distinct()


def resolve_images(refs: DataFrame, manifest: DataFrame, cutoff: float = 0.85, block_names: int = 512) -> DataFrame:
    """[dir, name, resolved] (X5): the exact name, else the most similar one of the same directory (of equals the greatest),
    else null. What has no exact match is compared with the names whose digits and other characters can be alike enough
    (``_near_blocks``), at most ``block_names`` of them in a row. A null dir or name resolves to null."""
    m = manifest.select("dir", "name").distinct()
    exact = refs.join(m, ["dir", "name"], "left_semi").select("dir", "name", F.col("name").alias("resolved"))
    rest = refs.join(m, ["dir", "name"], "left_anti").select("dir", "name")

    @F.pandas_udf("score double, name string")
    def closest(name: pd.Series, names: pd.Series) -> pd.DataFrame:
        found = [difflib.get_close_matches(n, list(c), n=1, cutoff=cutoff) for n, c in zip(name, names)]
        rows = [(difflib.SequenceMatcher(None, f[0], n).ratio(), f[0]) if f else (None, None) for n, f in zip(name, found)]
        return pd.DataFrame({"score": pd.Series([r[0] for r in rows], dtype="float64"), "name": pd.Series([r[1] for r in rows], dtype=object)})

    near = _near_blocks(rest.distinct(), m, cutoff, block_names)
    best = near.select("dir", "name", closest("name", "names").alias("c")).filter("c.name is not null").groupBy("dir", "name").agg(F.max("c").alias("c"))
    return exact.unionByName(rest.join(best, ["dir", "name"], "left").select("dir", "name", F.col("c.name").alias("resolved")))


def _free_names(bases: list[str]) -> list[str]:
    """Each base in turn, or with the first of _2, _3, ... that no name before it has."""
    used, last, out = set(), {}, []
    for base in bases:
        name, k = base, last.get(base, 1)
        while name in used:
            k += 1
            name = f"{base}_{k}"
        last[base] = k
        used.add(name)
        out.append(name)
    return out


def image_names(df: DataFrame) -> DataFrame:
    """[doc_id, rel, file]: local names of images [doc_id, stem, rel], longest reference first; a name that is taken gets _2, _3 and so
    on until it is free. A reference without a name counts as ``img``. Names can only meet where they are equal up to
    numbers at their ends; where such a group holds one base only, as nearly all do, a row number settles it, and the others
    go through a small helper."""
    path = F.regexp_replace(F.replace("rel", F.lit("\\"), F.lit("/")), r"(?:/+\.?)+$", "")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    base = F.regexp_replace(F.concat("stem", F.lit("_"), F.when(name.isin("", "."), "img").otherwise(name)), r'[<>:"/\\|?*\x00-\x1f]', "_")
    rows = df.withColumn("base", base).withColumn("root", F.regexp_replace("base", r"(?:_[0-9]+)+$", ""))
    order = [F.desc(F.char_length("rel")), F.col("rel")]
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "root", "base").orderBy(*order)))
    group = Window.partitionBy("doc_id", "root")
    rows = rows.withColumn("mixed", (F.max("k").over(group) > 1) & (F.min("base").over(group) != F.max("base").over(group)))

    @F.pandas_udf("array<string>")
    def free(bases: pd.Series) -> pd.Series:
        return pd.Series([_free_names(list(b)) for b in bases], dtype=object)

    numbered = F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""))
    plain = rows.filter("not mixed").select("doc_id", "rel", numbered.alias("file"))
    item = F.struct((-F.char_length("rel")).alias("n"), "rel", "base")
    met = rows.filter("mixed").groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(item)).alias("x"))
    met = met.withColumn("files", free(F.transform("x", lambda r: r.base)))
    both = met.select("doc_id", F.explode(F.arrays_zip("x", "files")).alias("z")).select("doc_id", F.col("z.x.rel").alias("rel"), F.col("z.files").alias("file"))
    return plain.unionByName(both)


IMAGE = re.compile(r"!\[[^\]]*\]\(\s*|src=[\"']")


def _targets(names: list[dict]) -> tuple[dict[str, list[int]], list[str]]:
    """Every spelling of every reference, with its turns; what each turn writes. Longer references come first, a reference's own
    spellings before its address."""
    turns: dict[str, list[int]] = {}
    local = []
    for n in sorted(names, key=lambda n: -len(n["rel"])):
        spellings = {n["rel"], quote(n["rel"]), unquote(n["rel"])}
        for group in (spellings, {n["url"] or ""}):
            for s in group - {""}:
                turns.setdefault(s, []).append(len(local))
            local.append(n["local"])
    return turns, local


def _rewritten(text: str, names: list[dict]) -> str:
    turns, local = _targets(names)
    longest = max(map(len, turns), default=0)

    def settled(target: str) -> str:
        turn = -1
        while (later := next((t for t in turns.get(target, ()) if t > turn), None)) is not None:
            turn, target = later, local[later]
        return target

    out, at = [], 0
    for m in IMAGE.finditer(text):
        if m.start() < at:
            continue
        if m[0].startswith("src"):
            ends = [i for q in "\"'" if (i := text.find(q, m.end(), m.end() + longest + 1)) >= 0]
            found = next(((i, text[m.end() : i]) for i in sorted(ends) if text[m.end() : i] in turns), None)
            if found:
                out += [text[at : m.start()], f'src="{settled(found[1])}"']
                at = found[0] + 1
            continue
        close, best = text.find(")", m.end()), None
        while close >= 0 and len(text[m.end() : close].rstrip()) <= longest:
            target = text[m.end() : close].rstrip()
            if target in turns and (best is None or turns[target][0] < turns[best[1]][0]):
                best = close, target
            close = text.find(")", close + 1)
        if best:
            out += [text[at : m.start()], f"![]({settled(best[1])})"]
            at = best[0] + 1
    return "".join([*out, text[at:]])


def rewrite_refs(docs: DataFrame, names: DataFrame) -> DataFrame:
    """[doc_id, text] of docs [doc_id, text] (X5): image references, markdown or HTML, that name one of the document's images
    [doc_id, rel, local, url] become its local name. An image goes by its reference as it stands, percent-quoted or unquoted, and by its
    address; where several images could be meant the longest reference comes first, as one name may be the start of another; what
    one of them has written a later one may write again. A text is read once, however many images it has."""
    own = names.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rel", "local", "url"))).alias("names"))

    @F.pandas_udf("string")
    def run(text: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _rewritten(t, list(n)) for t, n in zip(text, held)], dtype=object)

    rows = docs.select("doc_id", "text").join(own, "doc_id", "left")
    touched = F.col("names").isNotNull() & (F.contains("text", F.lit("![")) | F.contains("text", F.lit("src=")))
    return rows.select("doc_id", F.coalesce(run(F.when(touched, F.col("text")), "names"), F.col("text")).alias("text"))

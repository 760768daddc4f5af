"""The chunk table: sections, component blocks and images of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import SPACE, estimate_tokens, is_blank, strip
from folioforge.operators.blocks import parse_blocks
from folioforge.operators.lines import breadcrumbs, numbered_lines, section_spans, strip_page_markers
from folioforge.operators.packing import pack, split_long_pieces

MAX_SECTION_TOKENS = 1000
MIN_SECTION_TOKENS = 50
COLUMNS = ["doc_id", "ord", "artifact", "section_num", "anchor", "line_start", "line_end", "breadcrumb", "text", "kind"]


def section_bodies(df: DataFrame) -> DataFrame:
    """Sections with a non-empty body, which is the whole span: parents contain their children. One exchange, by document; a
    document is one row of lines and sections until its bodies are cut out of it."""
    numbered = numbered_lines(strip_page_markers(df).select("doc_id", "text"), placed=True)
    spans = breadcrumbs(section_spans(numbered))
    cols = ["ord", "level", "num", "title", "line_start", "line_end", "breadcrumb"]
    heads = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("h"))
    held = numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l")).select("doc_id", F.transform("l", lambda x: x.line).alias("l"))
    body = lambda x: F.array_join(F.slice("l", x.line_start + 2, x.line_end - x.line_start), "\n")
    found = F.transform("h", lambda x: F.struct(*(x[c].alias(c) for c in cols), body(x).alias("body")))
    rows = heads.join(held, "doc_id").select("doc_id", F.inline(found)).withColumn("body", strip(F.col("body"))).filter("body <> ''")
    return rows.withColumn("tokens", estimate_tokens(F.col("body")))


def chunk_sections(df: DataFrame) -> DataFrame:
    """One chunk per section (C1): over 1000 tokens in pieces, under 50 and below ``##`` appended to the last chunk of the
    parent number, or kept at the end when there is none; such an orphan can take in a later short one.

    A section's parent, if it is there, is the last section one level up, so windows look back one row per level.
    """
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = section_bodies(df).withColumn("short", (F.col("tokens") < MIN_SECTION_TOKENS) & (F.col("level") >= 3))
    long = ~F.col("short") & (F.col("tokens") > MAX_SECTION_TOKENS)
    rows = rows.withColumn("p", F.when(long, F.filter(F.split("body", "\n\n"), lambda p: ~is_blank(p))))
    rows = rows.withColumn("w", pack(F.transform("p", estimate_tokens), MAX_SECTION_TOKENS))
    rows = rows.withColumn("pieces", F.when(F.col("p").isNotNull(), split_long_pieces(F.col("p"), F.col("w"))).otherwise(F.array("body"))).drop("p", "w", "body")
    # where a short one goes: the parent's chunk; else, for level 4, a lone short parent; else nowhere
    above = lambda what: F.when(F.col("level") == 4, F.last(F.when(F.col("level") == 3, what), True).over(so_far)).otherwise(F.last(F.when(F.col("level") == 2, what), True).over(so_far))
    rows = rows.withColumn("parent", F.regexp_replace("num", r"\.[^.]*$", "")).withColumn("up", above(F.struct("num", "short")))
    there = F.coalesce(F.col("up.num") == F.col("parent"), F.lit(False))
    rows = rows.withColumn("lone", F.col("short") & ~(there & ~F.coalesce("up.short", F.lit(True)))).withColumn("up_lone", above(F.struct("num", "lone")))
    taken = (F.col("level") == 4) & F.coalesce((F.col("up_lone.num") == F.col("parent")) & F.col("up_lone.lone"), F.lit(False))
    rows = rows.withColumn("hung", F.col("short") & (~F.col("lone") | taken))
    rows = rows.withColumns({"late": F.col("short").cast("int"), "home": F.when(F.col("hung"), F.col("parent")).otherwise(F.col("num"))}).drop("up", "up_lone")
    # a home is one row: its own section, and the short ones it takes in
    head = lambda part: F.concat("num", F.lit(" "), "title", part, F.lit("\n"))
    n = F.size("pieces")
    own = F.transform("pieces", lambda x, k: F.concat(head(F.when(n > 1, F.concat(F.lit("（"), (k + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("）"))).otherwise("")), x))
    rows = rows.withColumn("texts", own)
    held = F.struct("late", "ord", "num", "line_start", "line_end", "breadcrumb", "texts")
    homes = rows.groupBy("doc_id", "home").agg(F.max(F.when(~F.col("hung"), held)).alias("s"), F.sort_array(F.collect_list(F.when(F.col("hung"), F.struct("ord", F.get("texts", F.lit(0)).alias("x"))))).alias("more"))
    tail = F.array_join(F.concat(F.array(F.lit("")), F.transform("more", lambda m: m.x)), "\n\n")
    texts = F.transform("s.texts", lambda x, k: F.concat(x, F.when(k == F.size("s.texts") - 1, tail).otherwise("")))
    rows = homes.select("doc_id", "s.late", "s.ord", "s.num", "s.line_start", "s.line_end", "s.breadcrumb", F.posexplode(texts).alias("k", "text"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("late", "ord", "k")) - 1
    return rows.select(
        "doc_id", order.alias("ord"), F.lit("organized").alias("artifact"), F.col("num").alias("section_num"), F.concat(F.lit("organized:"), "num").alias("anchor"),
        (F.col("line_start") + 1).alias("line_start"), (F.col("line_end") + 1).alias("line_end"), "breadcrumb", "text", F.lit("section").alias("kind"),
    )


def chunk_blocks(df: DataFrame, artifact: str) -> DataFrame:
    """The first non-empty block of each target of a component text."""
    rows = parse_blocks(df)[0].filter("content <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "target").orderBy("ord"))).filter("_n = 1")
    none = F.lit(None).cast("int")
    return rows.select(
        "doc_id", "ord", F.lit(artifact).alias("artifact"), F.col("target").alias("section_num"), F.concat(F.lit(f"{artifact}:"), "target").alias("anchor"),
        none.alias("line_start"), none.alias("line_end"), F.lit("").alias("breadcrumb"), F.col("content").alias("text"), F.lit("summary" if artifact == "summary" else "plugin").alias("kind"),
    )


IMAGE = rf"""(?i)!\[([^\]]*)\]\(([^){SPACE[1:-1]}]+)\)|<img\b[^>]*?\bsrc=["']([^"']+)["'][^>]*>"""


def chunk_images(df: DataFrame) -> DataFrame:
    """Local image references with the section they stand in (C3); page markers stay and fences are not skipped."""
    rows = numbered_lines(df)
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("num").isNotNull(), F.struct("num", "title")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("at", at).filter(F.col("line").rlike(r"(?i)!\[|<img")).select("doc_id", "line_no", "at", F.posexplode(F.regexp_extract_all("line", F.lit(IMAGE), F.lit(0))).alias("pos", "ref"))
    rows = rows.withColumns({"alt": strip(F.regexp_extract("ref", IMAGE, 1)), "src": F.concat(F.regexp_extract("ref", IMAGE, 2), F.regexp_extract("ref", IMAGE, 3))})
    rows = rows.filter(~F.col("src").rlike("^(http|data:)") & (F.col("src") != ""))
    num, title = F.coalesce("at.num", F.lit("")), F.coalesce("at.title", F.lit(""))
    sec = F.concat(num, F.lit(" "), title)
    context = F.when(F.col("alt") != "", F.col("alt")).otherwise(F.concat(sec, F.lit(" 中的图片")))
    line = F.col("line_no") + 1
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "pos")) - 1
    return rows.select(
        "doc_id", order.alias("ord"), F.lit("image").alias("artifact"), num.alias("section_num"), F.concat(F.lit("image:"), num, F.lit(":"), "src").alias("anchor"),
        line.alias("line_start"), line.alias("line_end"), strip(sec).alias("breadcrumb"), F.concat(F.lit("[图片] "), context, F.lit("（位于 "), sec, F.lit("）")).alias("text"), F.lit("image").alias("kind"),
    )


def chunk_documents(docs: DataFrame, artifacts: DataFrame, config: DataFrame) -> DataFrame:
    """All chunks of documents [doc_id, kb_id, preset_id, text] under their index config (C4).

    ``artifacts`` [doc_id, artifact, text] holds component texts, ``config`` [doc_id, summary, images, plugins] what is
    wanted of them; sections always are.
    """
    texts = artifacts.join(config, "doc_id").filter(F.when(F.col("artifact") == "summary", F.col("summary")).otherwise(F.array_contains("plugins", F.col("artifact"))))
    blocks = chunk_blocks(texts.select(F.struct("doc_id", "artifact").alias("doc_id"), "text"), "plugin")
    name = F.col("doc_id.artifact")
    blocks = blocks.select(F.col("doc_id.doc_id").alias("doc_id"), "ord", name.alias("artifact"), "section_num", F.concat(name, F.lit(":"), "section_num").alias("anchor"), "line_start", "line_end", "breadcrumb", "text", F.when(name == "summary", "summary").otherwise("plugin").alias("kind"))
    images = chunk_images(docs.join(config.filter("images"), "doc_id", "left_semi").select("doc_id", "text"))
    every = chunk_sections(docs.select("doc_id", "text")).select(COLUMNS).unionByName(blocks.select(COLUMNS)).unionByName(images.select(COLUMNS))
    return every.join(docs.select("doc_id", "kb_id", "preset_id"), "doc_id")

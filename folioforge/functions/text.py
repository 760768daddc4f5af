"""Column functions over text: token estimates, tails, images, section numbers, citations, fingerprints.

All but the entities of titles are built-in expressions, so they stay in the JVM and inside code generation. White space
is spelled out, because the engine's own class is ASCII only; ``(?d)`` keeps its patterns from ending lines elsewhere than
at line feeds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html import entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character classes and patterns
SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same as plain characters: trimming and deleting by list is several times faster than by pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NO_SPACE = f"[^{SPACE[1:]}"
CJK = r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)*"
NUMBERED = rf"(?d)^({NUMBER}){SPACE}+(.*)$"
CITE = r"\[\[c:(\d+)\]\]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NO_SPACE)


def marked(c: Column, markers: str | tuple[str, ...], pattern: str, at_start: bool = False) -> Column:
    """Whether a line has a pattern that cannot be without one of the markers: those are looked for first, which is much cheaper."""
    test = F.startswith if at_start else F.contains
    first, *rest = [test(c, F.lit(m)) for m in ((markers,) if isinstance(markers, str) else markers)]
    for other in rest:
        first = first | other
    return first & c.rlike(pattern)


def estimate_tokens(c: Column) -> Column:
    """Tokens of a text: 0.8 for each CJK character, one for 3.5 others, cut to a whole number. Where every character is one byte
    there is no CJK to look for."""
    other = F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(F.length(F.regexp_replace(c, CJK, "")))
    return ((F.length(c) - other) * F.lit(0.8) + other / F.lit(3.5)).cast("int")


def tail_by_tokens(c: Column, max_tokens: int) -> Column:
    """The whole text if it fits, else its longest fitting suffix of a multiple of 1000 characters, at least 1000, from
    the line after the first line end if that comes within 200 characters. A character counts 1/3.5 tokens at least, so nothing
    longer than ``far`` fits, and only the last ``far`` characters are measured."""
    far = max(int((max_tokens + 1) * 3.5) + 1, 1000)
    fits = lambda x: estimate_tokens(x) <= max_tokens

    def last(x: Column) -> Column:
        steps = F.when(x.n > 1000, F.sequence(F.lit(1000), F.least(x.n - 1, F.lit(far)), F.lit(1000))).otherwise(F.array().cast("array<int>"))
        best = F.coalesce(F.array_max(F.filter(steps, lambda k: fits(F.right(x.end, k)))), F.lit(1000))
        return F.when((x.n <= far) & fits(x.end), x.end).otherwise(let(F.right(x.end, best), cut))

    def cut(tail: Column) -> Column:
        at = F.instr(tail, "\n")
        return F.when((at > 1) & (at <= 200), F.substr(tail, at + 1)).otherwise(tail)

    return let(F.when(c.isNotNull(), F.struct(F.length(c).alias("n"), F.right(c, F.lit(far)).alias("end"))), last)


def norm_ws(c: Column) -> Column:
    return F.lower(F.translate(c, SPACES, ""))


def html_title(c: Column, unfinished: bool = True) -> Column:
    """Text of the first title element: white space collapsed, entities and character references resolved, trimmed. Only
    titles with ``&`` go through the standard library's table of entities, in Arrow batches. ``unfinished``: those without
    a semicolon (``&amp``, as where a title was cut) are resolved too, as browsers do; else they stay."""
    pattern = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")

    @F.pandas_udf("string")
    def resolved(s: pd.Series) -> pd.Series:
        one = lambda m: html.unescape(m[0]) if m[0][1] == "#" else entities.html5.get(m[0][1:], m[0])
        return s.map(html.unescape if unfinished else lambda x: pattern.sub(one, x), na_action="ignore")

    t = F.regexp_replace(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), f"{SPACE}+", " ")
    return strip(F.coalesce(resolved(F.when(F.contains(t, F.lit("&")), t)), t))


def is_image_line(c: Column, anywhere: bool = False) -> Column:
    return c.rlike(r"(?i)!\[[^\]]*\]\([^)]*\)|<img") if anywhere else c.rlike(rf"(?i)^{SPACE}*(!\[|<img)")


def drop_image_lines(c: Column, anywhere: bool = False) -> Column:
    """Lines that start with an image (export form), or hold one anywhere (preview form), are dropped."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_image_line(x, anywhere)), "\n")


def rewrite_images(c: Column, base: str) -> Column:
    """Put ``base`` before local image references; addresses, data and bracketed references stay."""
    at = base.replace("\\", "\\\\").replace("$", "\\$")
    md = F.regexp_replace(c, rf"(!\[[^\]]*\]\()(?!<|http|data:|//)([^){SPACE[1:-1]}]+)(\))", f"$1{at}/$2$3")
    return F.regexp_replace(md, rf"(?i)(<img\b[^>]*?\bsrc{SPACE}*={SPACE}*)([\"'])(?!http|data:|//)([^\"']*)([\"'])", f"$1$2{at}/$3$4")


def num_of(title: Column) -> Column:
    """The section number a title starts with, else null."""
    return F.nullif(F.regexp_extract(title, NUMBERED, 1), F.lit(""))


def unnumbered(title: Column) -> Column:
    return F.regexp_replace(title, NUMBERED, "$2")


def valid_target(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"^{NUMBER}$")


def ancestors(num: Column) -> Column:
    """``2.1.3`` -> [2, 2.1]; the number itself is not among them."""
    parts = F.split(num, r"\.")
    return F.filter(
        F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i), ".")),
        lambda x: x != "",
    )


def cite_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(CITE), F.lit(1)), lambda x: x.cast("int"))


def wrap_callout(header: Column, content: Column) -> Column:
    """A header line, then the content as quoted lines."""
    quoted = F.transform(F.split(content, "\n"), lambda x: F.when(is_blank(x), F.lit(">")).otherwise(F.concat(F.lit("> "), x)))
    return F.array_join(F.concat(F.array(header), quoted), "\n")


def _parts(c: Column) -> Column:
    """What follows each line that starts with ``## ``; the text before the first is not among them."""
    return F.slice(F.split(F.concat(F.lit("\n"), c), r"\n## "), 2, 1 << 30)


def prompt_sections(c: Column) -> Column:
    """``## name`` sections as a map; of equal names the last counts."""
    pairs = F.transform(_parts(c), lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("k"), strip(F.when(F.instr(p, "\n") > 0, F.substr(p, F.instr(p, "\n") + 1)).otherwise("")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y.k == x.k))
    return F.map_from_entries(last)


def prompt_meta(c: Column) -> Column:
    """``key: value`` lines of section ``meta`` as a map."""
    lines = F.transform(F.split(F.coalesce(F.try_element_at(prompt_sections(c), F.lit("meta")), F.lit("")), "\n"), strip)
    pairs = F.transform(
        F.filter(lines, lambda x: (F.instr(x, ":") > 0) & ~x.startswith("#")),
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substr(x, F.instr(x, ":") + 1)).alias("v")),
    )
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y.k == x.k))
    return F.map_from_entries(last)


def search_entries(c: Column) -> Column:
    """Entries [title, url, snippet] of a search dump, in order; those without title and address are dropped."""
    def entry(p: Column) -> Column:
        title = F.regexp_extract(p, rf"(?md)^Title:{SPACE}*(.+?){SPACE}*$", 1)
        url = F.regexp_extract(p, rf"(?md)^(?:URL|URL Source):{SPACE}*({NO_SPACE}+){SPACE}*$", 1)
        body = F.when(p.rlike(r"(?md)^Highlights:"), F.regexp_replace(p, rf"(?msd)\A.*?^Highlights:{SPACE}*\n?", "")).otherwise(p)
        return F.struct(F.when(title == "", url).otherwise(title).alias("title"), url.alias("url"), F.left(strip(body), F.lit(1200)).alias("snippet"))

    chunks = F.transform(F.split(c, rf"\n{SPACE}*---+{SPACE}*\n"), strip)
    return F.filter(F.transform(F.filter(chunks, lambda x: x != ""), entry), lambda e: e.title != "")


def reader_entries(c: Column) -> Column:
    """Entries [title, url, snippet] of a result list in line form: an entry starts with a ``Title: `` line; its first ``URL`` line with
    an address counts; the lines after that are the snippet."""
    text = F.regexp_replace(c, r"\r\n|[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n")

    def entry(lines: Column) -> Column:
        is_url = lambda x: x.startswith("URL Source: ") | x.startswith("URL: ")
        url = lambda x: strip(F.substr(x, F.instr(x, ": ") + 2))
        at = F.coalesce(F.array_min(F.transform(lines, lambda x, i: F.when((i > 0) & is_url(x) & (url(x) != ""), i))), F.size(lines))
        rest = F.filter(F.transform(F.slice(lines, at + 2, F.size(lines)), strip), lambda x: x != "")
        snippet = F.array_join(F.transform(rest, lambda x: F.concat(x, F.lit(" "))), "")
        return F.struct(strip(F.get(lines, F.lit(0))).alias("title"), F.coalesce(url(F.get(lines, at)), F.lit("")).alias("url"), F.left(snippet, F.lit(1200)).alias("snippet"))

    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\nTitle: "), 2, 1 << 30)
    return F.transform(parts, lambda p: let(F.split(p, "\n"), entry))


def cut_meta_keys(c: Column, keys: tuple[str, ...]) -> Column:
    """The text without the ``key: value`` lines of section ``meta`` that have one of ``keys``; a section left empty goes as a whole,
    with the blank lines before it."""
    text = F.replace(c, F.lit("\r\n"), F.lit("\n"))

    def named(x: Column) -> Column:
        s = strip(x)
        return (F.instr(s, ":") > 0) & ~s.startswith("#") & strip(F.substring_index(s, ":", 1)).isin(*keys)

    def parted(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda x: strip(x) == "## meta"), True)
        return let(F.struct(lines.alias("lines"), start.cast("int").alias("start"), F.slice(lines, start.cast("int") + 1, F.size(lines)).alias("after")), cut)

    def cut(p: Column) -> Column:
        stop = F.array_position(F.transform(p.after, lambda x: x.startswith("## ")), True).cast("int")
        own = F.when(stop > 0, stop - 1).otherwise(F.size(p.after))
        kept = F.filter(F.slice(p.after, F.lit(1), own), lambda x: ~named(x))
        return let(F.struct(p.alias("p"), kept.alias("kept"), F.slice(p.after, own + 1, F.size(p.after)).alias("rest")), joined)

    def joined(q: Column) -> Column:
        before = F.slice(q.p.lines, F.lit(1), F.greatest(q.p.start - 1, F.lit(0)))
        filled = F.coalesce(F.array_max(F.transform(before, lambda x, i: F.when(~is_blank(x), i + 1))), F.lit(0))
        some = F.exists(q.kept, lambda x: ~is_blank(x))
        lines = F.when(some, F.concat(F.slice(q.p.lines, F.lit(1), q.p.start), q.kept, q.rest)).otherwise(F.concat(F.slice(before, F.lit(1), filled), q.rest))
        out = F.trim(F.array_join(lines, "\n"), F.lit("\n"))
        return F.when(q.p.start == 0, F.array_join(q.p.lines, "\n")).otherwise(F.concat(out, F.when(out == "", "").otherwise("\n")))

    return F.when(F.instr(text, "## meta") > 0, let(F.split(text, "\n"), parted)).otherwise(text)


def sha_text(c: Column) -> Column:
    return F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")), 256)


def sha_json(**cols: Column) -> Column:
    """SHA-256 of the JSON object of the columns, keys in order."""
    return F.sha2(F.to_json(F.struct(*(cols[k].alias(k) for k in sorted(cols)))), 256)


def sha_parts(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *cols), 256)

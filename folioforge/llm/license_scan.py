"""License scans by MinHash bands over overlapping text windows, with exact containment to verify.

All of it is DataFrame functions in one projection, without a shuffle. Words are runs of letters and digits of the
lower-cased text; shingles are five words. For a template of m shingles, windows of m shingles start every m/8. A window
and a template meet if one of ``bands`` bands agrees, and a band agrees if each of its ``rows`` MinHashes does, so a window
with similarity s is retrieved with probability 1 - (1 - s^rows)^bands:

====================  ====  =====  =====================================================
template              rows  bands  probability at s = 0.8, and at s = 0.6
====================  ====  =====  =====================================================
up to 16 shingles        1     12  over 0.999999995, and 0.99998
longer                   2     24  over 0.99999999997, and 0.99997
====================  ====  =====  =====================================================

Notices of fewer than eight shingles (four of the templates have 1, 3, 4 and 7) move shingle by shingle and have few values
to hash: for them retrieval is a plain look-up of their shingles, and containment alone decides.

A copy in which a fifth of the shingles is replaced, as far as possible from a window's start, has s = 0.6; eight or more
windows see it. A MinHash can only agree if the window holds the very shingle that is the template's minimum, so windows
without those of a whole band are passed over, which loses none; they are found by one look-up per shingle, however many
templates there are. What is retrieved is verified: the template's distinct shingles in the window and the stretch of m/8
on both sides, over all it has, at least ``least``. Templates may contain each other; each is reported for itself.

The template table is a literal of the plan: its size does not depend on the corpus.

Defined results: null and short texts match nothing; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored. Templates under five words are refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.license_texts import TEMPLATES

WORDS = 5
#: (longest template, bands, rows): the first that fits a template counts.
BANDS = ((16, 12, 1), (1 << 30, 24, 2))


@dataclass(frozen=True)
class Template:
    name: str
    length: int
    shingles: list[int]  # distinct
    bands: list[list[tuple[int, int, int]]]  # per row: number of the hash, its least value, the shingle that has it

    @property
    def leaders(self) -> list[int]:
        return sorted({leader for band in self.bands for _, _, leader in band})

    def row(self) -> dict:
        bands = [[{"seed": k, "value": v, "leader": x} for k, v, x in band] for band in self.bands]
        return {"name": self.name, "length": self.length, "step": max(1, self.length // 8), "shingles": self.shingles, "leaders": self.leaders, "bands": bands}


_ROW = "array<struct<name: string, length: int, step: int, shingles: array<bigint>, leaders: array<bigint>, bands: array<array<struct<seed: int, value: bigint, leader: bigint>>>>>"


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; none for shorter texts."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def hashes(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ws) - (WORDS - 1))
        return F.when(F.size(ws) >= WORDS, F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, F.lit(WORDS))))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), hashes), F.lit(0))


def _banded(h: Column, seed: Column) -> Column:
    return F.xxhash64(h, seed)


def prepare(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> list[Template]:
    """Signatures of the template table."""
    if not templates:
        return []
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", shingles(F.col("text")).alias("h"))
    seeds = max(b * r for _, b, r in BANDS)
    least = F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda k: F.array_min(F.transform("h", lambda x: F.struct(_banded(x, k).alias("v"), x.alias("x")))))
    found = rows.select("name", F.size("h").alias("n"), F.array_distinct("h").alias("s"), least.alias("m")).collect()
    if any(r.n < 1 for r in found):
        raise ValueError(f"a template needs at least {WORDS} words")

    def bands(r) -> list[list[tuple[int, int, int]]]:
        _, n_bands, n_rows = next(x for x in BANDS if r.n <= x[0])
        return [[(k, r.m[k].v, r.m[k].x) for k in range(b * n_rows, (b + 1) * n_rows)] for b in range(n_bands)]

    return [Template(r.name, r.n, list(r.s), bands(r)) for r in sorted(found, key=lambda r: r.name)]


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def containment(h: Column, hits: Column, t: Column) -> Column:
    """Best verified containment of template ``t`` in the shingles ``h``; null where no window is retrieved. ``hits`` are places and
    values of the shingles that lead some MinHash. Every window that holds one is looked at once, and only its own shingles are, so
    the work grows with the text, however often a notice is repeated in it."""
    def around(own: Column) -> Column:
        starts = lambda y: F.sequence(F.floor(F.greatest(y.i - t.length + 1, F.lit(0)) / t.step).cast("int") * t.step, y.i, t.step)
        return _let(F.array_distinct(F.flatten(F.transform(own, starts))), lambda s: F.array_max(F.transform(F.filter(s, collides), held)))

    def collides(s: Column) -> Column:
        def agrees(window: Column, seen: Column) -> Column:
            led = lambda band: F.forall(band, lambda r: F.array_contains(seen, r.leader))
            least = lambda band: F.forall(band, lambda r: F.array_min(F.transform(window, lambda x: _banded(x, r.seed))) == r.value)
            return F.exists(t.bands, lambda band: F.when(led(band), least(band)).otherwise(F.lit(False)))

        return _let(F.slice(h, s + 1, t.length), lambda window: _let(F.array_intersect(window, t.leaders), lambda seen: agrees(window, seen)))

    def held(s: Column) -> Column:
        first = F.greatest(s - t.step, F.lit(0))
        return F.size(F.array_intersect(F.slice(h, first + 1, s - first + t.length + t.step), t.shingles)) / F.size(t.shingles)

    return _let(F.filter(hits, lambda y: F.array_contains(t.leaders, y.x)), around)


def scan_licenses(docs: DataFrame, templates: list[Template], least: float = 0.8) -> DataFrame:
    """[doc_id, n_licenses, licenses, matches] for every document; matches holds name and containment, in name order."""
    leaders = sorted({x for t in templates for x in t.leaders})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(F.col("text").cast("string")).alias("h"))
    kind = "array<struct<name: string, containment: double>>"
    none = F.array().cast(kind)
    table = F.from_json(F.lit(json.dumps([t.row() for t in sorted(templates, key=lambda t: t.name)])), _ROW)

    def matches(hits: Column) -> Column:
        likely = F.filter(table, lambda t: F.exists(hits, lambda y: F.array_contains(t.leaders, y.x)))
        every = F.transform(likely, lambda t: F.struct(t["name"].alias("name"), F.coalesce(containment(F.col("h"), hits, t), F.lit(0.0)).alias("containment")))
        return F.filter(every, lambda x: x.containment >= least).cast(kind)

    if not templates:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_licenses"), F.lit("").alias("licenses"), none.alias("matches"))
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(leaders), F.struct(i.alias("i"), x.alias("x")))), lambda y: y.isNotNull())
    found = rows.select("doc_id", "h", hits.alias("hits"))
    found = found.select("doc_id", F.when(F.size("hits") > 0, matches(F.col("hits"))).otherwise(none).alias("matches"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(F.transform("matches", lambda x: x["name"]), ",").alias("licenses"), "matches")

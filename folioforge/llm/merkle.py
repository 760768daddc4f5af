"""Merkle manifest of a document table, with stored checkpoints and proofs recomputed between them.

Every row is a leaf; the leaves of a language, in order of their ids, are folded eight at a time up to a subroot, and the
subroots, in order of their languages, likewise up to the root. A manifest stores the leaves and then only every third level
(``STRIDE``), so it is a five-hundredth longer than its leaves. A proof needs the siblings on every level: a stored node's
aligned subtree, at most 8**3 = 512 stored descendants, lies in one row; the missing levels inside it are hashed again from
these, their siblings are given out along with those of the subtree's own stored ancestor, and they are thrown away. So a task
holds one subtree at a time, whatever the number of leaves.

Places within a language come from sorted ranges and the counts of the ranges before, so a language with most of the rows is
spread over all tasks. Texts are hashed where they are read and are not shuffled.

Defined results: a null field is written ``-``; null ids come before all others; rows of one language that share an id are in the
order of their leaves; fully repeated rows are leaves of their own; texts are hashed whole; an empty table has no rows and
no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from folioforge.llm.common import broadcast_if_small, map_arrow, materialize

FAN = 8
STRIDE = 3
SPAN = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree that holds the subroots; trees of languages are named by the language after ``=``, that of null by nothing.
TOP = "top"


def digest(hexes: str) -> str:
    return hashlib.sha256(hexes.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 over the fields, each as its length in bytes, a colon and itself, or ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves`` [tree, pos, width, digest, doc_id, lang, changed]; ``levels`` [k] holds [tree, pos, digest, width] of level
    ``STRIDE * (k + 1)``, ``width`` being the nodes of that tree and level; a node of width 1 is its tree's subroot. ``top_levels``
    has the same for the tree of subroots, from the subroots themselves on."""

    leaves: DataFrame
    levels: list[DataFrame]
    top_levels: list[DataFrame]


def leaf_rows(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """[doc_id, lang, digest, changed]; ``changed`` is the text after tampering, null digests mean untouched rows."""
    own = leaf_of(*(F.col(c) for c in FIELDS))
    other = F.lit(None).cast("string") if changed is None else F.when(~changed.eqNullSafe(F.col("text")), leaf_of(*(F.col(c) for c in FIELDS[:-1]), changed))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), own.alias("digest"), other.alias("changed"))


def _in_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the place of each row within its tree in this task; rows come sorted by tree."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    for b in parts:
        places = []
        for t in b.column("tree").to_pylist():
            last, n = t, n + 1 if t == last else 0
            places.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], [*b.schema.names, "_p", "_k"])


def _placed(rows: DataFrame, tree: Column, *order: str) -> DataFrame:
    """``rows`` with ``tree``, ``pos`` from 0 within it in ``order`` (nulls first), and ``width``, the rows of the tree."""
    ranged = materialize(rows.withColumn("tree", tree)).repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialize(map_arrow(ranged, _in_runs, StructType([*ranged.schema.fields, StructField("_p", IntegerType()), StructField("_k", LongType())]), rows=4096))
    counts = ranged.groupBy("_p", "tree").agg(F.count(F.lit(1)).alias("_n"))
    through = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(through.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = materialize(counts.select("_p", "tree", before.alias("_b"), F.sum("_n").over(through).alias("width")))
    return ranged.join(broadcast_if_small(shifts, 100_000), ["_p", "tree"]).withColumn("pos", F.col("_k") + F.col("_b")).drop("_p", "_k", "_b")


def _subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """[tree, up, width, members], a row per aligned subtree of at most ``SPAN`` stored nodes, members in order of their places."""
    row = F.struct("pos", "digest", *more)
    return nodes.groupBy("tree", F.expr(f"pos div {SPAN}").alias("up")).agg(F.max("width").alias("width"), F.array_sort(F.collect_list(row)).alias("members"))


def fold(hexes: list[str], alone: bool) -> list[list[str]]:
    """Levels of a subtree from its stored nodes up to its root; one that is a whole tree (``alone``) stops at a single node."""
    levels = [hexes]
    for _ in range(STRIDE):
        if alone and len(hexes) == 1:
            break
        hexes = [digest("".join(hexes[i : i + FAN])) for i in range(0, len(hexes), FAN)]
        levels.append(hexes)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(before, after) of node ``i`` on every level below the last."""
    out = []
    for nodes in levels[:-1]:
        at = i // FAN * FAN
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + FAN])))
        i //= FAN
    return out


def refold(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def _next_level(nodes: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            roots = [fold([m["digest"] for m in members], width <= SPAN)[-1][0] for members, width in zip(b.column("members").to_pylist(), b.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("up"), pa.array(roots, pa.string()), b.column("width")], ["tree", "pos", "digest", "width"])

    up = map_arrow(_subtrees(nodes), run, "tree string, pos long, digest string, width long", rows=64)
    return materialize(up.withColumn("width", F.expr(f"(width + {SPAN - 1}) div {SPAN}")))


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """Stored levels above ``nodes``, until every tree has come to one node; trees that are done are not carried further."""
    levels = []
    live = nodes
    while not live.isEmpty():
        levels.append(_next_level(live))
        live = levels[-1].filter("width > 1")
    return levels


def _tree() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def build_manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The stored levels of a table's trees; see ``Manifest``."""
    leaves = materialize(_placed(leaf_rows(docs, changed), _tree(), "doc_id", "digest"))
    levels = _grow(leaves.select("tree", "pos", "digest", "width"))
    ends = [level.filter("width = 1") for level in levels]
    subroots = None
    for end in ends:
        subroots = end if subroots is None else subroots.unionByName(end)
    if subroots is None:
        return Manifest(leaves, [], [])
    tops = materialize(_placed(subroots.select(F.col("tree").alias("name"), "digest"), F.lit(TOP), "name"))
    return Manifest(leaves, levels, [tops, *_grow(tops)])


PATH = "path array<struct<before: string, after: string>>"


def _paths(nodes: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """[tree, pos, ``more``, path, root] of stored nodes; ``above`` [tree, up, path, root] has those of their subtrees' roots."""
    rows = _subtrees(nodes, *more).join(above, ["tree", "up"])
    member = rows.schema["members"].dataType.elementType
    types = [f"{c} {member[c].dataType.simpleString()}" for c in more]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            tree, width, members, path, root = (b.column(c).to_pylist() for c in ("tree", "width", "members", "path", "root"))
            for t, w, held, rest, r in zip(tree, width, members, path, root):
                levels = fold([m["digest"] for m in held], w <= SPAN)
                upper = [(p["before"], p["after"]) for p in rest]
                own = [[{"before": x, "after": y} for x, y in siblings(levels, i) + upper] for i in range(len(held))]
                arrays = [pa.array([t] * len(held)), pa.array([m["pos"] for m in held], pa.int64()), *(pa.array([m[c] for m in held]) for c in more)]
                paths = pa.array(own, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
                yield pa.RecordBatch.from_arrays([*arrays, paths, pa.array([r] * len(held))], ["tree", "pos", *more, "path", "root"])

    return map_arrow(rows, run, ", ".join(["tree string, pos long", *types, PATH, "root string"]), rows=16)


def _above(manifest: Manifest) -> DataFrame:
    """[tree, up, path, subroot, root] of every aligned subtree of leaves."""
    nothing = F.array().cast("array<struct<before: string, after: string>>")
    *inner, last = manifest.top_levels
    over = last.select("tree", F.col("pos").alias("up"), nothing.alias("path"), F.col("digest").alias("root"))
    for level in reversed(inner[1:]):
        over = materialize(_paths(level, over).select("tree", F.col("pos").alias("up"), "path", "root"))
    tops = inner[0]
    roots = materialize(_paths(tops, over, "name").select(F.col("name").alias("tree"), "path", "root"))
    above = None
    for k, level in reversed(list(enumerate(manifest.levels))):
        ends = level.filter("width = 1").join(roots, "tree").select("tree", F.col("pos").alias("up"), "path", "digest", "root")
        ends = ends.withColumn("root", F.concat_ws("|", "digest", "root")).drop("digest")
        if above is not None:
            ends = ends.unionByName(_paths(level.filter("width > 1"), above).select("tree", F.col("pos").alias("up"), "path", "root"))
        above = materialize(ends)
    return above


def prove(manifest: Manifest, with_paths: bool = True) -> DataFrame:
    """[doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified], a row per leaf. ``proof_sha256`` is the digest of all
    siblings; ``folded_root`` is what the leaf as it is now (tampered where it was) and the proof fold up to. ``with_paths`` adds
    the siblings themselves as ``path`` [before, after] by level."""
    schema = "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not manifest.levels:
        return manifest.leaves.sparkSession.createDataFrame([], schema + (f", {PATH}" if with_paths else ""))
    rows = _subtrees(manifest.leaves, "doc_id", "lang", "changed").join(_above(manifest), ["tree", "up"])
    paths = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    fields = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("lang", "leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
    arrow = pa.schema(fields + [("path", paths)] * with_paths)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for w, held, path, both in zip(*(b.column(c).to_pylist() for c in ("width", "members", "path", "root"))):
                subroot, root = both.split("|")
                levels = fold([m["digest"] for m in held], w <= SPAN)
                upper = [(p["before"], p["after"]) for p in path]
                tail = "".join(x + y for x, y in upper)
                out = []
                for i, m in enumerate(held):
                    own = siblings(levels, i)
                    proof = digest("".join(x + y for x, y in own) + tail)
                    folded = refold(m["changed"] or m["digest"], own + upper)
                    row = (m["doc_id"], m["lang"], m["digest"], subroot, root, proof, folded, folded == root)
                    out.append((*row, [{"before": x, "after": y} for x, y in own + upper]) if with_paths else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return map_arrow(rows, run, schema + (f", {PATH}" if with_paths else ""), rows=16)

"""Best-fit packing by large-item matching.

Documents are whole unless longer than the capacity; those are cut into pieces of it. Of the pieces above a third of the
capacity at most two share a sequence, so they are matched greedily: the longest left takes the longest partner that fits
beside it. All smaller pieces then go, longest first, into the tightest gap left, and what fits nowhere opens a sequence.

Pieces of one length are alike, so packing needs only how many there are of each: a histogram of at most ``capacity`` rows,
whatever the input. It is solved at once for whole classes of equal sequences, which gives exactly the packing of piece
after piece, over all documents and not per task. The solution says, for each length, which of its pieces (by number)
lie in which sequence. Pieces are numbered per length inside their tasks and shifted by the counts of the tasks before,
so no length, however common, meets in one task, and no text or id list is shuffled.

Defined results: null text counts as empty and gives the end mark alone; repeated rows are packed as separate documents; a
null id is carried along; an empty table gives no rows; other columns are ignored. Very long texts are cut, never skipped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import broadcast_if_small, documents, map_arrow, materialize, raw_texts
from folioforge.llm.word_bpe import loaded

#: Placement of pieces of one length: those numbered ``number`` to ``number + each * bins - 1`` lie ``each`` to a sequence in
#: the ``bins`` sequences from ``first`` on, side by side from ``offset``.
Placement = tuple[int, int, int, int, int, int]  # length, number, each, bins, first, offset


class _Gaps:
    """Classes of equal sequences (first, how many) by the room they have left."""

    def __init__(self):
        self.sizes: list[int] = []
        self.classes: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            if not self.classes[room]:
                insort(self.sizes, room)
            self.classes[room].append((first, bins))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The tightest class with room for ``least``: (room, first, bins)."""
        i = bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        room = self.sizes[i]
        found = self.classes[room].pop()
        if not self.classes[room]:
            self.sizes.pop(i)
        return (room, *found)


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements of ``histogram[length]`` pieces of each length up to ``capacity``, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c}
    used: Counter[int] = Counter()
    out: list[Placement] = []
    gaps, bins = _Gaps(), 0

    def place(length: int, each: int, n: int, first: int, offset: int) -> None:
        out.append((length, used[length], each, n, first, offset))
        used[length] += each * n
        left[length] -= each * n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i >= 0 and large[i] == a and left[a] == 1:  # no second one of its own length
            i -= 1
        if i < 0:
            n, room = left[a], capacity - a
            place(a, 1, n, bins, 0)
        elif large[i] == a:
            n, room = left[a] // 2, capacity - 2 * a
            place(a, 2, n, bins, 0)
        else:
            b = large[i]
            n, room = min(left[a], left[b]), capacity - a - b
            place(a, 1, n, bins, 0)
            place(b, 1, n, bins, a)
            if not left[b]:
                large.pop(i)
        gaps.put(room, bins, n)
        bins += n
        if not left[a]:
            large.pop()

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            room, first, n = gaps.take(s) or (capacity, bins, -(-left[s] // (capacity // s)))
            bins = max(bins, first + n)
            each, at = room // s, capacity - room
            full = min(n, left[s] // each)
            if full:
                place(s, each, full, first, at)
                gaps.put(room - each * s, first, full)
            if full < n and left[s]:  # fewer than one sequence's worth are left
                some = left[s]
                place(s, some, 1, first + full, at)
                gaps.put(room - some * s, first + full, 1)
                full += 1
            gaps.put(room, first + full, n - full)
    return out, bins


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    mark = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encode = TaskContext.get().partitionId(), Counter(), loaded(path).encode
        for b in parts:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw_texts(b)):
                data = encode(text.decode()) + mark
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    ids = data[at : at + 4 * capacity]
                    n = len(ids) // 4
                    row = (doc_id, piece, at // 4, n, zlib.crc32(ids), task, seen[n])
                    rows.append((*row, ids) if with_ids else row)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids


def _placer(plan: list[Placement]):
    by_length: dict[int, list[Placement]] = defaultdict(list)
    for p in plan:
        by_length[p[0]].append(p)
    table = {n: np.array(sorted(rows)) for n, rows in by_length.items()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = table[n]
                _, start, each, _, first, base = rows[np.searchsorted(rows[:, 1], number[at], "right") - 1].T
                nth = number[at] - start
                sequence[at], offset[at] = first + nth // each, base + nth % each * n
            named = [*b.schema.names[:-1], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], named)

    return run


def pack_best_fit(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """[doc_id, piece, start, length, ids_crc32, (ids), sequence_id, offset], one row per piece; ``ids`` are little-endian
    unsigned 32-bit numbers. Sequence numbers count from 0."""
    spark = docs.sparkSession
    run, schema = _pieces(path, capacity, end_id, with_ids)
    pieces = materialize(map_arrow(documents(docs), run, schema))
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = solve(histogram, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = materialize(per_task.select("task", "length", before.alias("before")))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    numbered = pieces.join(broadcast_if_small(shifts, 200_000), ["task", "length"]).select(*kept, (F.col("nth") + F.col("before")).alias("number"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1])
    return map_arrow(numbered, _placer(plan), out + ", sequence_id long, offset long", rows=16384)

"""Hard-negative mining by a vertical scan that shrinks its candidates as it reads dimensions.

Vectors are floored to whole numbers and kept in columnar blocks: one column per dimension, rows in order of their labels,
with the least and greatest value of every column. An anchor reads the columns in descending order of its own magnitudes, a
few at a time. What the unread columns can add at least and at most bounds every row's score; rows whose bounds cannot meet
what is asked leave the candidate bitmap, and the rest go on until their scores are exact. This runs twice: first for an
anchor's best rows of its own label (asked: the fifth best so far), then for the rows of other labels in the score windows
which those positives set (asked: any window, from the fifth best in it so far up to its end).

Anchors are a stated query set against all rows, in blocks: every pair of blocks is scanned in the task that meets it, the
best per anchor and window are kept over all pairs of a task, and only those are exchanged. Nothing passes through the driver
and no group is collected. Scores are exact: products that leave single precision are made in double, then in whole numbers.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; missing trailing
components count as zero, so vectors of any lengths compare and an empty one scores 0; rows of the anchor's own id are not
its positives; repeated rows each count, repeated anchor rows are each mined; null ids come after all others in ties; scores
beyond 64 bits count as the nearest such number; a negative positive score leaves no window; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import materialize
from folioforge.session import ship_package

SCALE = 256
BLOCK_ROWS = 4096
ANCHOR_ROWS = 1024
BLOCK_VALUES = 1 << 21
#: Windows held by a task before it passes on what it has.
HELD = 200_000
#: Columns read between two looks at the bounds.
STEP = 8
BLOCK = "block long, dim int, ids array<long>, labels array<long>, cells binary, kind string"
ANCHOR = "key long, vec_id long, label long, dim int, q binary"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _row_lists(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floored matrix) of the usable vectors of a batch, by length."""
    v = b.column("vec")
    n = np.asarray(v.value_lengths().fill_null(-1))
    n = np.where(np.asarray(b.column("label").is_null()), -1, n)
    flat = v.flatten().to_numpy(zero_copy_only=False)  # null elements become nan
    full = np.asarray(v.value_lengths().fill_null(0))
    start = np.cumsum(full) - full
    top = np.finfo(np.float64).max
    for dim in np.unique(n[n >= 0]):
        at = np.flatnonzero(n == dim)
        m = flat[start[at, None] + np.arange(dim)].astype(np.float64).reshape(len(at), dim)
        ok = np.isfinite(m).all(axis=1)
        with np.errstate(over="ignore"):
            yield at[ok], np.floor(np.clip(SCALE * m[ok], -top, top)) + 0.0


def _kind(m: np.ndarray) -> str:
    most = np.abs(m).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def _blocks(rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: dict[int, list] = defaultdict(list)
        count: dict[int, int] = defaultdict(int)

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal block
            ids, labels = (pa.concat_arrays([x[i] for x in held[dim]]) for i in (0, 1))
            m = np.concatenate([x[2] for x in held[dim]])
            held.pop(dim), count.pop(dim)
            order = np.argsort(labels.to_numpy(), kind="stable")
            lists = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), a.take(pa.array(order))) for a in (ids, labels)]
            kind = _kind(m)
            cells = np.ascontiguousarray(m[order].T).astype(kind).tobytes()
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([block - 1], pa.int64()), pa.array([dim], pa.int32()), *lists, pa.array([cells], pa.binary()), pa.array([kind])], ["block", "dim", "ids", "labels", "cells", "kind"])

        for b in parts:
            for at, m in _row_lists(b):
                dim = m.shape[1]
                size = max(1, min(rows, BLOCK_VALUES // max(dim, 1)))
                while len(at):
                    n = size - count[dim]
                    take = pa.array(at[:n])
                    held[dim].append((b.column("id").take(take), b.column("label").take(take), m[:n]))
                    count[dim] += len(take)
                    at, m = at[n:], m[n:]
                    if count[dim] >= size:
                        yield flush(dim)
            while sum(max(d, 1) * c for d, c in count.items()) > 4 * BLOCK_VALUES:
                yield flush(max(count, key=lambda d: max(d, 1) * count[d]))
        for dim in list(held):
            yield flush(dim)

    return run


def _cells(b: pa.RecordBatch, i: int) -> np.ndarray:
    dim = b.column("dim")[i].as_py()
    n = len(b.column("ids")[i].values)
    return np.frombuffer(b.column("cells")[i].as_py(), b.column("kind")[i].as_py()).reshape(dim, n)


def _anchors(every: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values
                at = np.flatnonzero(np.asarray(ids.is_valid()) & (np.asarray(ids.fill_null(1)) % every == 0))
                q = _cells(b, i)[:, at].T.astype("<f8")
                take = pa.array(at)
                keys = pa.array((b.column("block")[i].as_py() << 13) + at, pa.int64())
                yield pa.RecordBatch.from_arrays([keys, ids.take(take), b.column("labels")[i].values.take(take), pa.array([q.shape[1]] * len(at), pa.int32()), pa.array([x.tobytes() for x in q], pa.binary())], ["key", "vec_id", "label", "dim", "q"])

    return run


def _gathered(anchors: DataFrame) -> DataFrame:
    """Anchors of equal length in rows of at most ``ANCHOR_ROWS``, gathered inside their tasks."""
    cols = [c for c in anchors.columns if c != "dim"]
    schema = "q_dim int, " + ", ".join(f"q_{c} array<{anchors.schema[c].dataType.simpleString()}>" for c in cols)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                size = max(1, min(ANCHOR_ROWS, BLOCK_VALUES // max(int(dim), 1)))
                for i in range(0, len(at), size):
                    take = pa.array(at[i : i + size])
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(take)], pa.int32()), b.column(c).take(take)) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists], ["q_dim", *(f"q_{c}" for c in cols)])

    return anchors.mapInArrow(run, schema)


class Columns:
    """A block ready to be scanned: its cells in a type in which every score with ``q`` is exact, and the bounds of its columns."""

    def __init__(self, cells: np.ndarray, greatest: float):
        reach = float(np.abs(cells).max(initial=0)) * greatest * max(len(cells), 1)
        self.exact = reach < 1 << 52
        if self.exact:
            self.x = cells.astype(np.float32 if reach < 1 << 23 else np.float64)
        else:
            self.x = np.array([[int(c) for c in column] for column in cells], object).reshape(cells.shape)
        self.lo, self.hi = (f(axis=1) if cells.shape[1] else np.zeros(len(cells)) for f in (self.x.min, self.x.max))

    def whole(self, q: np.ndarray) -> np.ndarray:
        return q.astype(self.x.dtype) if self.exact else np.array([int(c) for c in q], object)


def scan(block: Columns, q: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, exact scores) of all rows among ``alive`` whose scores lie in a window (least, most); with ``k``, rows that are not
    among the best ``k`` may be missing. ``alive`` is what the candidate bitmap starts from."""
    n = min(len(q), len(block.x))
    q = block.whole(q[:n])
    order = np.argsort(-np.abs(q), kind="stable")
    q = q[order]
    if not block.exact:
        score = (q @ block.x[order][:, alive] if n else np.zeros(len(alive), object)).tolist()
        score = np.array([min(max(s, LEAST), MOST) for s in score], object)
        keep = np.array([any(a <= s <= z for a, z in windows) for s in score], bool)
        return alive[keep], score[keep]
    one, other = q * block.lo[order], q * block.hi[order]
    rest_lo, rest_hi = (np.append(np.cumsum(side(one, other)[::-1])[::-1], 0) for side in (np.minimum, np.maximum))
    score = np.zeros(len(alive), block.x.dtype)
    for t in range(0, n, STEP):
        dims, part = order[t : t + STEP], q[t : t + STEP]
        if 2 * len(alive) > block.x.shape[1]:
            score += (part @ block.x[dims])[alive]
        else:
            score += part @ block.x[np.ix_(dims, alive)]
        least, most = score + rest_lo[min(t + STEP, n)], score + rest_hi[min(t + STEP, n)]
        if k and len(alive) > k:
            windows = [(max(windows[0][0], int(np.partition(least, -k)[-k])), windows[0][1])]
        keep = np.zeros(len(alive), bool)
        for a, z in windows:
            keep |= (most >= a) & (least <= z)
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if not len(alive):
            break
    if not n:
        keep = np.array([any(a <= 0 <= z for a, z in windows)] * len(alive), bool)
        alive, score = alive[keep], score[keep]
    return alive, score.astype(np.int64)


Entry = tuple[int, bool, int]  # -score, id is null, id: the order of rows


def _entries(ids: pa.Array, rows: np.ndarray, scores: np.ndarray, k: int) -> list[Entry]:
    """The first ``k`` of some rows of a block."""
    if len(rows) > k and scores.dtype != object:
        keep = scores >= np.partition(scores, -k)[-k]
        rows, scores = rows[keep], scores[keep]
    return sorted((-int(s), i is None, i or 0) for s, i in zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist()))[:k]


def _emit(held: dict[tuple[int, int, int], list[Entry]]) -> Iterator[pa.RecordBatch]:
    rows = [(*key, -s, None if null else i) for key, found in held.items() for s, null, i in found]
    for at in range(0, len(rows), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 65536])], ["key", "anchor_id", "most", "score", "id"])
    held.clear()


FOUND = "key long, anchor_id long, most long, score long, id long"


def _pairs(job: Callable):
    """Runs ``job(block, ids, labels, q, anchor, held)`` over every anchor of every pair of blocks, best rows held over all of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[Entry]] = {}
        for b in parts:
            for i in range(b.num_rows):
                anchors = {c: b.column(f"q_{c}")[i].values for c in ("key", "vec_id", "label", "q")}
                dim = b.column("q_dim")[i].as_py()
                q = np.frombuffer(b"".join(anchors["q"].to_pylist()), "<f8").reshape(len(anchors["q"]), dim)
                block = Columns(_cells(b, i), float(np.abs(q).max(initial=0)))
                ids, labels = b.column("ids")[i].values, b.column("labels")[i].values.to_numpy()
                wanted = b.column("q_ends")[i].values.to_pylist() if "q_ends" in b.schema.names else [None] * len(q)
                for own, key, anchor, label, ends in zip(q, anchors["key"].to_pylist(), anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), wanted):
                    job(block, ids, labels, own, (key, anchor, label, ends), held)
                if len(held) > HELD:
                    yield from _emit(held)
        yield from _emit(held)

    return run


def _hold(held: dict, key: tuple[int, int, int], found: list[Entry], k: int) -> None:
    if found:
        held[key] = sorted(held.get(key, []) + found)[:k]


def _positives(k: int):
    def job(block: Columns, ids: pa.Array, labels: np.ndarray, q: np.ndarray, anchor: tuple, held: dict) -> None:
        key, anchor_id, label, _ = anchor
        lo, hi = np.searchsorted(labels, [label, label + 1])
        alive = np.arange(lo, hi)
        alive = alive[np.asarray(ids.slice(lo, hi - lo).is_null()) | (np.asarray(ids.slice(lo, hi - lo).fill_null(0)) != anchor_id)]
        if not len(alive):
            return
        name = (key, anchor_id, 0)
        best = held.get(name, ())
        rows, scores = scan(block, q, alive, [(-best[-1][0] if len(best) == k else LEAST, MOST)], k)
        _hold(held, name, _entries(ids, rows, scores, k), k)

    return job


def _negatives(k: int, least: Callable[[int], int]):
    def job(block: Columns, ids: pa.Array, labels: np.ndarray, q: np.ndarray, anchor: tuple, held: dict) -> None:
        key, anchor_id, label, ends = anchor
        lo, hi = np.searchsorted(labels, [label, label + 1])
        alive = np.concatenate([np.arange(lo), np.arange(hi, len(labels))])
        if not len(alive):
            return
        windows = []
        for most in ends:
            best = held.get((key, anchor_id, most), ())
            windows.append((max(least(most), -best[-1][0]) if len(best) == k else least(most), most))
        rows, scores = scan(block, q, alive, windows)
        for a, most in windows if len(rows) else ():
            inside = (scores >= a) & (scores <= most)
            _hold(held, (key, anchor_id, most), _entries(ids, rows[inside], scores[inside], k), k)

    return job


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "most").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """[anchor_id, positive_id, rank, negative_id, positive_score, negative_score] of ``rows`` [vec_id, label, embedding]. Anchors are the
    rows whose id ``every`` divides; the window of a positive with score p is percent * p <= 100 * score <= 100 * p."""
    spark = rows.sparkSession
    ship_package(spark)
    table = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    blocks = materialize(table.mapInArrow(_blocks(min(block_rows, 1 << 13)), BLOCK))
    anchors = materialize(blocks.mapInArrow(_anchors(every), ANCHOR))
    tasks = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    dealt = blocks.repartition(tasks)

    def met(asked: DataFrame, job: Callable) -> DataFrame:
        # written once more: the size of the files, not a guess, decides between a broadcast and a grid of partitions
        return dealt.crossJoin(materialize(_gathered(asked))).mapInArrow(_pairs(job), FOUND)

    def least(p: int) -> int:
        return -(-percent * p // 100)

    near = materialize(_first(met(anchors, _positives(positives)), positives))
    ends = near.filter("score >= 0").groupBy("key").agg(F.collect_set("score").alias("ends"))  # at most `positives` of them
    far = materialize(met(anchors.join(ends, "key"), _negatives(negatives, least)))
    pairs = near.select("key", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("most"))
    found = _first(far, negatives).select("key", "most", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(found, ["key", "most"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("most").alias("positive_score"), "negative_score")


def shifted_label() -> Column:
    """The label, with that of every seventh row made wrong on purpose."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))

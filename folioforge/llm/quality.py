"""Quality rules: fixed counts, then hashed word and character n-gram logistic regression.

The counts (symbols, repeated lines, repeated windows) decide first; what passes is scored in Arrow batches by a model
trained on labelled rows. Word 1- and 2-grams and character 3-grams of the whole text are hashed into two blocks of
buckets, damped by log(1 + count) and scaled to unit length. The regression is fitted on at most ``max_labelled``
labelled documents (those with the smallest hash of their id), its margins are calibrated on the quarter held out, and a
document is rejected when its calibrated probability of good quality is under ``threshold``.

Defined results: null or blank text has no words and fails the base rules; of an id labelled twice the row with the
smallest label counts; with fewer than ``least`` labelled rows of either class there is no model and the base rules
decide alone; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import documents, map_arrow, raw_texts

WORD_BUCKETS = CHAR_BUCKETS = 2048
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # word buckets, then character buckets
    slope: float  # calibrated probability = 1 / (1 + exp(-(slope * margin + offset)))
    offset: float
    held_out_accuracy: float


class _WordHashes(dict):
    """word -> XXH64, for words met before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHashes()


def repeated_words(words: list[bytes], hashes: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mix = np.zeros(n, np.uint64)
    for i in range(window):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(mix, kind="stable")
    same = mix[order[1:]] == mix[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    rank, width = ids, 1  # equal rank exactly where the next `width` words are equal; no hash decides
    while width < window:
        pair = rank[:-width] * (len(words) + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], 2 * width
    at = np.flatnonzero(maybe)
    _, inverse, counts = np.unique(rank[at], return_inverse=True, return_counts=True)
    start = at[counts[inverse] > 1]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return len(lines) - len(set(lines))


def features(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """Damped, unit-length bucket counts."""
    out = np.zeros(WORD_BUCKETS + CHAR_BUCKETS, np.float32)
    if len(hashes):
        two = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        shift = np.uint64(64 - 11)
        both = np.concatenate([hashes * np.uint64(0xD6E8FEB86659FD93) >> shift, two * np.uint64(0xD6E8FEB86659FD93) >> shift])
        out[:WORD_BUCKETS] = np.bincount(both.astype(np.int64), minlength=WORD_BUCKETS)
    c = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    if len(c) >= 3:
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        out[WORD_BUCKETS:] = np.bincount((h >> np.uint32(32 - 11)).astype(np.int64), minlength=CHAR_BUCKETS)
    np.log1p(out, out=out)
    norm = float(np.sqrt(out @ out))
    return out / norm if norm else out


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> QualityModel:
    """Ridge logistic regression by accelerated gradient steps on three rows of four, calibrated on the fourth."""
    held = np.arange(len(y)) % 4 == 3
    xs, ys, x = x[~held], y[~held], x[held]
    n_good, n_bad = max(ys.sum(), 1), max((1 - ys).sum(), 1)
    weight = np.where(ys > 0, 0.5 / n_good, 0.5 / n_bad).astype(np.float32)  # both classes weigh the same; calibration restores the odds
    w = np.zeros(xs.shape[1], np.float32)
    ahead, rate = w, 2.0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(xs @ ahead)))
        step = ahead - rate * (xs.T @ ((p - ys) * weight) + ridge * ahead)
        ahead, w = step + k / (k + 3) * (step - w), step
    m, t = x @ w, y[held]
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps of Platt's two parameters; a small ridge keeps them finite where classes separate
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum() + 0.01 * (a - 1), (p - t).sum() + 0.01 * b])
        v = p * (1 - p)
        h = np.array([[(v * m * m).sum() + 0.01, (v * m).sum()], [(v * m).sum(), v.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    right = float(np.mean((a * m + b > 0) == (t > 0))) if held.any() else float("nan")
    return QualityModel(w, a, b, right)


def _feature_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        x = [features(t, _hashes(t.split())).tobytes() for t in raw_texts(b)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, least: int = 20) -> QualityModel | None:
    """Fit on at most ``max_labelled`` documents with a label; their features (16 KB each) are what reaches the driver."""
    one = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality")
    rows = map_arrow(rows, _feature_rows, "doc_id long, quality int, x binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("x")).limit(max_labelled).collect()  # the limit matters only where ids repeat
    y = np.array([r.quality for r in rows], np.float32)
    if min((y > 0).sum(), (y <= 0).sum()) < least:
        return None
    x = [np.stack([np.frombuffer(r.x, np.float32) for r in rows])]
    del rows
    return fit(x.pop(), (y > 0).astype(np.float32))  # no second reference: fit lets the whole matrix go


def judge(raw: bytes, model: QualityModel | None, threshold: float) -> tuple:
    """The five counts, base_failed, kept and the calibrated probability (null where the base rules or no model decide)."""
    words = raw.split()
    h = _hashes(words)
    repeated = repeated_words(words, h)
    failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    p = None
    if not failed and model is not None:
        z = model.slope * float(features(raw, h) @ model.weights) + model.offset
        p = 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(b"".join(words).decode()), symbols, duplicate_lines(raw), repeated, failed, not failed and (p is None or p >= threshold), p


def quality_rules(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """[doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability]."""
    fields = [*((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            cols = list(zip(*(judge(t, model, threshold) for t in raw_texts(b)))) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, (_, k) in zip(cols, fields))], ["doc_id", *(n for n, _ in fields)])
        _HASHES.clear()  # the worker's next tasks may be of another operator

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return map_arrow(documents(docs), run, schema)


def keep_good(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns; each row is judged where it lies."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array([judge(t, model, threshold)[6] for t in raw_texts(b)], pa.bool_())).select(["row"])
        _HASHES.clear()

    return map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")

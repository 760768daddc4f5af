"""Packing token sequences by non-negative least squares.

Every document's ids, end mark included, are cut at multiples of the window; the full pieces are sequences of their own.
The remainders of a block of documents are packed together: shallow combinations of lengths that fill a window exactly
are enumerated, non-negative least squares finds how often to repeat each so that the length histogram is met, the
counts are rounded and used as far as there are documents for them, and the remainders left over are laid end to end
and cut at the window. The last stretch is cut into powers of two, which need no padding.

A block is at most ``block_docs`` documents or ``block_tokens`` ids of one task, so memory is bounded, nothing is
shuffled, and every block is solved from its own whole histogram.

Defined results: null text counts as empty and gives the end mark alone; every id lies in exactly one piece; repeated
rows are packed as separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.byte_bpe import encode_bytes
from folioforge.llm.common import documents, first_ordinal, map_arrow, raw_texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


@lru_cache(maxsize=4)
def combinations_filling(window: int) -> np.ndarray:
    """Rows (a, b, c, d), zeros last, with a + b + c + d = window: all pairs, and triples and fours with one repeated length."""
    rows = {(a, window - a, 0, 0) for a in range(window // 2, window)}
    rows |= {tuple(sorted((a, a, window - 2 * a), reverse=True)) + (0,) for a in range(1, (window + 1) // 2)}
    rows |= {tuple(sorted((a, a, a, window - 3 * a), reverse=True)) for a in range(1, (window + 2) // 3)}
    return np.array(sorted(rows))


def solve_counts(histogram: np.ndarray, combos: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative least squares for how often each combination is used; ``histogram[length]`` is what is there.

    Coordinate descent on ||A x - h||^2 with x >= 0, over the combinations whose lengths all occur.
    """
    x = np.zeros(len(combos))
    left = histogram.astype(float)
    live = []
    for c, row in enumerate(combos):
        need: dict[int, int] = defaultdict(int)
        for length in row[row > 0].tolist():
            need[length] += 1
        if all(histogram[k] for k in need):
            live.append((c, list(need.items()), sum(v * v for v in need.values())))
    for _ in range(rounds):
        moved = 0.0
        for c, need, norm in live:
            step = max(sum(v * left[k] for k, v in need) / norm, -x[c])
            if step:
                x[c] += step
                moved = max(moved, abs(step))
                for k, v in need:
                    left[k] -= v * step
        if moved < 0.01:
            break
    return x


def pack_block(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """[(document, start, length, sequence, offset)] for remainders shorter than the window; sequences count from 0."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for doc, n in enumerate(lengths):
        if n:
            by_length[n].append(doc)
    histogram = np.zeros(window + 1, np.int64)
    for n, docs in by_length.items():
        histogram[n] = len(docs)
    combos = combinations_filling(window)
    counts = solve_counts(histogram, combos)
    out, sequence = [], 0
    for c in np.argsort(-counts, kind="stable"):
        times = round(counts[c])
        row = [int(n) for n in combos[c] if n]
        while times > 0 and all(len(by_length[n]) >= row.count(n) for n in row):
            offset = 0
            for n in row:
                out.append((by_length[n].pop(), 0, n, sequence, offset))
                offset += n
            sequence, times = sequence + 1, times - 1
    rest = [doc for n in sorted(by_length, reverse=True) for doc in by_length[n]]
    total = sum(lengths[d] for d in rest)
    room = _rooms(total, window)
    size, offset = next(room, 0), 0
    for doc in rest:
        start = 0
        while start < lengths[doc]:
            if offset == size:
                size, offset, sequence = next(room), 0, sequence + 1
            n = min(lengths[doc] - start, size - offset)
            out.append((doc, start, n, sequence, offset))
            start, offset = start + n, offset + n
    return out


def _rooms(total: int, window: int) -> Iterator[int]:
    """Full windows, then the powers of two that make up the rest."""
    for _ in range(total // window):
        yield window
    rest = total % window
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            yield 1 << bit


def pack_documents(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, with_ids: bool = True, block_docs: int = 20_000, block_tokens: int = 6_000_000) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its ids' CRC-32 and, if wanted, its ids
    as little-endian unsigned 32-bit numbers. Sequences that are no power of two long are to be padded to ``window``."""
    mark = np.array([end_id], "<u4").tobytes()
    schema = _ARROW.append(pa.field("ids", pa.binary())) if with_ids else _ARROW

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = first_ordinal()
        held: list[tuple] = []  # (doc_id, start of the remainder, its ids, tokens of the document)
        tokens = 0
        rows: list[tuple] = []

        def put(doc_id, start: int, data: bytes, total: int, seq: int, offset: int) -> None:
            row = (doc_id, start, len(data) // 4, zlib.crc32(data), total, seq, offset)
            rows.append((*row, data) if with_ids else row)

        def flush() -> None:
            nonlocal sequence, held, tokens
            used = 0
            for d, start, n, seq, offset in pack_block([len(h[2]) // 4 for h in held], window):
                doc_id, at, data, total = held[d]
                put(doc_id, at + start, data[4 * start : 4 * (start + n)], total, sequence + seq, offset)
                used = max(used, seq + 1)
            sequence, held, tokens = sequence + used, [], 0

        def drain() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 16384):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 16384]), schema)], schema=schema)
            rows.clear()

        for b in parts:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw_texts(b)):
                data = encode_bytes(path, text.decode(), by_library=True) + mark
                total = len(data) // 4
                whole = total // window * window
                for start in range(0, whole, window):
                    put(doc_id, start, data[4 * start : 4 * (start + window)], total, sequence, 0)
                    sequence += 1
                if whole < total:
                    held.append((doc_id, whole, data[4 * whole :], total))
                    tokens += total - whole
                if len(held) >= block_docs or tokens >= block_tokens:
                    flush()
                if len(rows) >= 16384:
                    yield from drain()
        if held:
            flush()
        yield from drain()

    return map_arrow(documents(docs), run, SCHEMA + (", ids binary" if with_ids else ""))

"""Near duplicates by SimHash, linked with the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are cut into parts of correlated bits; each
part gets its own threshold t (or none), with sum(t + 1) = radius + 1, so every link shows in at least one part. A
dynamic programme picks the thresholds, and the number of parts, that give the fewest expected probes and candidates,
from bit counts over all fingerprints. Equal part values meet in a bucket, candidates are verified by bit count.

Equal fingerprints are folded before that, so copies never meet in pairs. A bucket with more than ``pair_limit``
fingerprints is not paired either: its members go the exact long way, in which each fingerprint visits its 65 own
neighbours; for radius 2 two fingerprints are linked exactly if they visit a common place, and a place needs only the edges to
its smallest visitor. No candidate is dropped.

Defined results: null or blank text has fingerprint zero and links like any other; rows with a null id get their
component's id but never name it; repeated rows share their component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import documents, drop_losers, map_arrow, materialize, raw_texts, unsigned_hex
from folioforge.llm.components import connected_components

PAIR_LIMIT = 64


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """SimHash of the n-word shingles, repeats included, as an unsigned number."""
    words = text.lower().split()  # bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(n))) if len(words) >= n else [words]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(s), seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _text_fingerprints(b: pa.RecordBatch) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t) for t in raw_texts(b)), np.uint64, b.num_rows).view(np.int64))


def _fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _text_fingerprints(b)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """[doc_id, fp], written once: 16 bytes a document is all that later steps read."""
    return materialize(map_arrow(documents(docs), _fingerprints, "doc_id long, fp long"))


def _bit_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((64, 64), np.float64)
    for b in parts:
        f = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False))
        bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += bits.T @ bits
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(both[i, j].astype(np.int64))], ["ij", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set; over all rows, 2080 sums reach the driver."""
    both = np.zeros((64, 64))
    for r in map_arrow(fps.select("fp"), _bit_counts, "ij long, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect():
        i, j = divmod(r["ij"], 64)
        both[i, j] = both[j, i] = r["n"]
    return fps.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into equal parts; each takes in the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (corr[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def expected_cost(n: int, p: np.ndarray, bits: list[int], t: int) -> float:
    """Probes sent plus candidate pairs met, if part ``bits`` has threshold ``t``; -1 leaves the part out."""
    if t < 0:
        return 0.0
    differ = np.zeros(t + 1)
    differ[0] = 1.0
    for b in bits:  # distribution of the number of differing bits of two rows, cut at t
        d = 2 * p[b] * (1 - p[b])
        differ = differ * (1 - d) + np.concatenate([[0.0], differ[:-1]]) * d
    return n * sum(comb(len(bits), j) for j in range(t + 1)) + n * n / 2 * differ.sum()


def allocate(n: int, p: np.ndarray, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least expected cost with sum(t + 1) = radius + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, radius - used + 1):
                c = cost + expected_cost(n, p, bits, t)
                if used + t + 1 not in step or c < step[used + t + 1][0]:
                    step[used + t + 1] = (c, [*ts, t])
        best = step
    return best[radius + 1]


def plan_parts(n: int, both: np.ndarray, radius: int) -> list[tuple[int, list[int]]]:
    """[(threshold, bits)] of the cheapest cut into 1 to radius + 2 parts."""
    n = max(n, 1000)  # below that every cut is cheap, and few probes are best
    p = np.diag(both) / n
    cuts = [group_bits(n, both, m) for m in range(1, radius + 3)]
    costs = [allocate(n, p, c, radius) for c in cuts]
    at = min(range(len(cuts)), key=lambda i: costs[i][0])
    return [(t, bits) for t, bits in zip(costs[at][1], cuts[at]) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _visits(fps: DataFrame, plan: list[tuple[int, list[int]]]) -> DataFrame:
    """[fp, part, key, home]: the bucket a fingerprint lives in (home) and those that its part reaches within t bits."""
    def reached(part: int, t: int, bits: list[int]):
        flips = F.lit([_mask(flip) for j in range(t + 1) for flip in combinations(bits, j)])
        return F.transform(flips, lambda m: F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseXOR(m).bitwiseAND(F.lit(_mask(bits))).alias("key"), (m == 0).alias("home")))

    found = F.concat(*(reached(part, t, bits) for part, (t, bits) in enumerate(plan)))
    return fps.select("fp", F.explode(found).alias("x")).select("fp", "x.part", "x.key", "x.home")


def _long_way(fps: DataFrame, radius: int) -> DataFrame:
    """Edges [u, v] that join all of ``fps`` within ``radius`` bits, without pairs: half-way places, each with its smallest visitor."""
    reach = [_mask(flip) for j in range(radius // 2 + 1) for flip in combinations(range(64), j)]
    places = fps.select("fp", F.explode(F.transform(F.lit(reach), lambda m: F.col("fp").bitwiseXOR(m))).alias("place"))
    least = places.groupBy("place").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return places.join(least, "place").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))


def links(fps: DataFrame, radius: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges [u, v] among distinct fingerprints whose components are those of all links within ``radius`` bits (an even number)."""
    if radius % 2:
        raise ValueError("an even radius is needed")
    n, both = bit_statistics(fps)
    visits = _visits(fps, plan_parts(n, both, radius))
    homes = visits.groupBy("part", "key").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("n"))
    met = materialize(visits.join(homes.filter("homes > 0 and n > 1"), ["part", "key"]))
    small = met.filter(F.col("n") <= pair_limit)
    at_home = small.filter("home").select("part", "key", F.col("fp").alias("v"))
    near = small.select("part", "key", F.col("fp").alias("u")).join(at_home, ["part", "key"])
    near = near.filter("u <> v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    crowded = met.filter(F.col("n") > pair_limit).select("fp").distinct()
    return near.unionByName(_long_way(crowded, radius))


def _components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """[doc_id, fp, component_id, root], one row per document; root tells apart components that share a repeated id."""
    rows = fingerprints(docs)
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(links(distinct.select("fp"), radius))
    found = comps.select(F.col("node").alias("fp"), "root").join(distinct, "fp")
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = found.join(named, "root").select("fp", "component_id", "root")
    of_fp = distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(materialize(of_fp), "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """[doc_id, fingerprint, component_id]; component_id is the smallest doc_id reachable over links."""
    return _components(docs, radius).select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns. Rows that share an id but not
    the component are judged apart; where several rows of a component have its smallest id, the least fingerprint stays."""
    found = materialize(_components(docs).select("doc_id", "fp", "root", (F.col("doc_id") == F.col("component_id")).alias("kept")))
    winners = found.filter("kept").groupBy("doc_id", "root").agg(F.min("fp").alias("key"))
    return drop_losers(docs, found.select("doc_id", "kept"), winners.select("doc_id", "key"), _text_fingerprints, "long")

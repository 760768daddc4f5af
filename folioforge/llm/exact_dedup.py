"""Exact duplicates by a heavy-hitter split.

Texts are equal when they agree after white space is deleted. One pass writes a digest row per document. Each task
keeps a Misra-Gries summary of its digests; the summaries add up to a list of at most ``2 * heavy`` candidates that
holds every digest with more than 1/``heavy`` of the rows. Their exact counts and winners are verified over all rows and
broadcast, so copies in such groups are resolved where they lie. Only the remaining digests, none of which has more than
that share, are shuffled.

Defined results: null text counts as empty; a group whose ids are all null has a null ``keep_id``; of repeated rows with
one id and text exactly one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import SPACES, documents, drop_losers, first_ordinal, map_arrow, materialize, raw_texts

HEAVY = 2048


def _text_digests(b: pa.RecordBatch) -> pa.Array:
    return pa.array([hashlib.sha256(t.translate(None, SPACES)).digest() for t in raw_texts(b)], pa.binary())


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = first_ordinal()
    for b in parts:
        chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
        ords = pa.array(range(at, at + b.num_rows), pa.int64())
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _text_digests(b), chars, ords], ["doc_id", "digest", "n_chars", "ord"])


def digest_rows(docs: DataFrame) -> DataFrame:
    """[doc_id, digest, n_chars, ord], one row per document, written once."""
    return materialize(map_arrow(documents(docs), _digests, "doc_id long, digest binary, n_chars long, ord long"))


def misra_gries(counts: Counter, k: int) -> Counter:
    """Shrink a summary to ``k`` counters; each loses at most its share 1/(k+1) of what was counted."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({d: n - cut for d, n in counts.items() if n > cut})


def _summaries(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in parts:
            held.update(b.column("digest").to_pylist())
            held = misra_gries(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_winners(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """[digest, w_id, w_ord, w_size] for every digest with more than 1/heavy of the rows (and at most 2*heavy in all)."""
    total = rows.count()
    parts = map_arrow(rows.select("digest"), _summaries(4 * heavy), "digest binary, n long")
    # counts are low by at most total/(4*heavy), so a heavy digest shows 1/(2*heavy); at most 2*heavy digests can
    likely = parts.groupBy("digest").agg(F.sum("n").alias("n")).filter((F.col("n") > 1) & (F.col("n") >= total / (2 * heavy))).select("digest")
    return materialize(_winners(rows.join(F.broadcast(likely), "digest", "left_semi")))


def _order(prefix: str = ""):
    c = lambda n: F.col(prefix + n)
    return F.struct(-c("n_chars"), c("doc_id").isNull(), c("doc_id"), c("ord"))


def _winners(rows: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("doc_id", "ord"), _order())
    return rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("w_size")).select("digest", F.col("b.doc_id").alias("w_id"), F.col("b.ord").alias("w_ord"), "w_size")


def exact_dedup(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """[doc_id, keep_id, group_size, kept, text_sha256], one row per document, dropped ones too."""
    rows = digest_rows(docs)
    seen = rows.join(F.broadcast(heavy_winners(rows, heavy)), "digest", "left")
    hot = seen.filter(F.col("w_ord").isNotNull())
    w = Window.partitionBy("digest")
    rest = seen.filter(F.col("w_ord").isNull()).select("digest", "doc_id", "n_chars", "ord")
    rest = rest.withColumn("b", F.min(_order()).over(w)).withColumn("w_size", F.count(F.lit(1)).over(w))
    rest = rest.select("digest", "doc_id", "ord", F.col("b.doc_id").alias("w_id"), F.col("b.ord").alias("w_ord"), "w_size")
    both = hot.select(rest.columns).unionByName(rest)
    return both.select(
        "doc_id",
        F.col("w_id").alias("keep_id"),
        F.col("w_size").alias("group_size"),
        (F.col("ord") == F.col("w_ord")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns. Rows that share an id but not the text are judged apart."""
    found = materialize(exact_dedup(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("key")))
    return drop_losers(docs, found, found.filter("kept").select("doc_id", "key"), _text_digests, "binary")

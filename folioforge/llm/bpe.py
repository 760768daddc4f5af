"""BPE encoding and decoding of a document table, one Arrow batch at a time and without a shuffle.

Defined results: null text counts as empty and has no ids; ids decode to the text itself; repeated rows give repeated
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.byte_bpe import _loaded, encode_bytes
from folioforge.llm.common import documents, map_arrow, raw_texts


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """[doc_id, ids array<int>]."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids = [np.frombuffer(encode_bytes(path, t.decode()), "<u4").astype(np.int32) for t in raw_texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(documents(docs), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """[doc_id, text] of [doc_id, ids]; null ids count as none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)[0]
        for b in parts:
            texts = [bpe.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """[doc_id, n_tokens, ids_sha256, decoded_sha256]: both directions in one pass, so ids need not leave the worker."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)[0]
        shown = [str(i) for i in range(bpe.size)]
        for b in parts:
            n, ids_sum, text_sum = [], [], []
            for t in raw_texts(b):
                ids = np.frombuffer(encode_bytes(path, t.decode()), "<u4").tolist()
                n.append(len(ids))
                ids_sum.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                text_sum.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sum), pa.array(text_sum)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(documents(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

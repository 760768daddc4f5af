"""What several operators share: white space, row ordinals, removal of losing rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.session import broadcast_if_small, materialize, ship_package

__all__ = ["SPACES", "broadcast_if_small", "documents", "drop_losers", "first_ordinal", "map_arrow", "materialize", "raw_texts", "table", "unsigned_hex"]

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The white space of all text contracts: blank and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """The two columns the text operators read, whatever else the table holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_arrow(df: DataFrame, fn, schema: str | StructType, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of ``rows`` rows, which bounds the Python objects alive at a time.

    Texts can be very long, so where the session still has Spark's default of 10000 rows a batch, it is set to 1000.
    """
    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_ROWS) == "10000":
        df.sparkSession.conf.set(BATCH_ROWS, "1000")

    def sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(b.slice(i, rows) for b in parts for i in range(0, b.num_rows, rows))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(sliced, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text without decoding; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def first_ordinal() -> int:
    """Start of this task's range of row numbers. They are stable once written to a table."""
    return TaskContext.get().partitionId() << 40


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def unsigned_hex(c: Column) -> Column:
    """A 64-bit number as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def drop_losers(docs: DataFrame, found: DataFrame, winners: DataFrame, keys, key_type: str) -> DataFrame:
    """``docs`` without its losing rows. ``found`` [doc_id, kept] has one row per document; ``winners`` [doc_id, key] names
    the rows that stay by the key that ``keys`` computes from a batch's texts.

    Ids travel, texts do not: an id none of whose rows stays goes by its id, in a broadcast where the counted size allows,
    else by shuffle. Only where rows share an id that stays is each judged by its own key; of those with one id and key
    the longest text stays. Rows with a null id are kept.
    """
    cols = docs.columns
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = materialize(ids.filter("not stays or n > 1").select("doc_id", "stays"))
    kept = docs.join(broadcast_if_small(ids.filter("not stays").select("doc_id")), "doc_id", "left_anti")
    shared = ids.filter("stays").select("doc_id")
    if shared.isEmpty():
        return kept.select(cols)
    shared = broadcast_if_small(shared)
    once = kept.join(shared, "doc_id", "left_anti").select(cols)
    rows = kept.join(shared, "doc_id", "left_semi").select(F.struct(*cols).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), keys(b)], ["row", "doc_id", "key"])

    schema = StructType([rows.schema["row"], rows.schema["doc_id"]]).add("key", key_type)
    own = map_arrow(rows, keyed, schema).join(winners.join(shared, "doc_id", "left_semi"), ["doc_id", "key"], "left_semi")
    best = own.groupBy("doc_id", "key").agg(F.max_by("row", F.coalesce(F.char_length("row.text"), F.lit(0))).alias("row"))
    return once.unionByName(best.select("row.*"))

"""Bounded queues of subscribers: newest events stay, oldest go (T3); as a batch and as a stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import broadcast_if_small, ship_package

#: Ids a task holds before it passes on what it has.
HELD = 1_000_000


def newest_ids(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """[key, order] of the ``n`` greatest of each key: each task keeps that many before anything is exchanged, so a key that has
    all rows costs ``n`` rows a task and not a window over them."""
    rows = df.select(F.col(key), F.col(order).cast("long").alias(order)).filter(F.col(order).isNotNull())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        total = 0

        def passed() -> pa.RecordBatch:
            keys = [k for k, ids in held.items() for _ in ids]
            ids = [i for ids in held.values() for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(ids, pa.int64())], [key, order])

        kind = None
        for b in parts:
            kind = b.schema.field(key).type
            for k, i in zip(b.column(key).to_pylist(), b.column(order).to_pylist()):
                ids = held.setdefault(k, [])
                if len(ids) < n:
                    heapq.heappush(ids, i)
                    total += 1
                elif i > ids[0]:
                    heapq.heapreplace(ids, i)
            if total > HELD:
                yield passed()
                held.clear()
                total = 0
        if held:
            yield passed()

    ship_package(df.sparkSession)
    some = rows.mapInArrow(run, rows.schema)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return some.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def bounded_queue(df: DataFrame, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a burst [subscriber, _id, ..] (T3): the newest ``cap`` of each subscriber stay. Ids are unique to a
    subscriber. Only the id from which a subscriber's events stay is joined to the events."""
    least = newest_ids(df, "subscriber", "_id", cap).groupBy(F.col("subscriber").alias("_s")).agg(F.min("_id").alias("_least"))
    rows = df.join(broadcast_if_small(least), F.col("subscriber").eqNullSafe(F.col("_s")), "left").drop("_s")
    stays = F.coalesce(F.col("_id") >= F.col("_least"), F.lit(False))
    return rows.filter(stays).drop("_least"), rows.filter(~stays).drop("_least")


def bounded_queue_stream(events: DataFrame, cap: int = 2000) -> DataFrame:
    """The events [subscriber, _id, channel] that a full queue pushes out (T3 over a stream). The queue of a subscriber, ids and
    channels of at most ``cap`` events, is its state; an event pushes out the oldest one held, or is itself the oldest. What was
    put out is what the batch form drops, however the events were cut or ordered, and a restart goes on from the state. An id
    that is held already is a repetition and changes nothing."""
    ship_package(events.sparkSession)
    key = events.schema["subscriber"].dataType.simpleString()

    def run(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, channels = state.get if state.exists else ([], [])
        queue = [(i, c or "", c is not None) for i, c in zip(ids, channels)]
        heapq.heapify(queue)
        known, out = {i for i, _, _ in queue}, []
        for part in parts:
            for i, c in zip(part["_id"].tolist(), part["channel"].tolist()):
                if i in known:
                    continue
                item = (int(i), c or "", c is not None)
                known.add(item[0])
                if len(queue) < cap:
                    heapq.heappush(queue, item)
                    continue
                gone = heapq.heappushpop(queue, item)
                known.discard(gone[0])
                out.append(gone)
        state.update(([i for i, _, _ in queue], [c if there else None for _, c, there in queue]))
        yield pd.DataFrame({"subscriber": pd.Series([name[0]] * len(out), dtype=object), "_id": pd.Series([x[0] for x in out], dtype="int64"), "channel": pd.Series([x[1] if x[2] else None for x in out], dtype=object)})

    rows = events.select("subscriber", F.col("_id").cast("long").alias("_id"), F.col("channel").cast("string").alias("channel"))
    return rows.groupBy("subscriber").applyInPandasWithState(run, f"subscriber {key}, _id long, channel string", "ids array<long>, channels array<string>", "append", "NoTimeout")

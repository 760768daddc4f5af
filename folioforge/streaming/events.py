"""The event stream: replay, criticality, bounded queues, render folds, latest status, split-safe block parsing.

Batch functions take a DataFrame of the same rows; the ``*_stream`` ones take a streaming DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import ship_package
from folioforge.streaming.queues import bounded_queue, bounded_queue_stream  # noqa: F401

#: Channels that must be delivered even when a queue is full.
CRITICAL_CHANNELS = ("doc.status", "doc.generated", "doc.paused", "doc.resumed", "doc.error", "doc.parsed", "index.done", "index.error", "export.done", "export.error")
CRITICAL_PREFIXES = ("job.", "session.")


def replay(events: DataFrame, last_id: Column | int, cap: int = 4000, live: DataFrame | None = None) -> DataFrame:
    """Events after ``last_id`` among the newest ``cap`` retained, with the live queue, each ``_id`` once."""
    newest = events.orderBy(F.desc("_id")).limit(cap)
    rows = newest.filter(F.col("_id") > last_id)
    return (rows if live is None else rows.unionByName(live.filter(F.col("_id") > last_id))).dropDuplicates(["_id"])


def replay_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """T1 over a stream: an ``_id`` passes once within ``delay`` of event time, which also bounds the state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["_id"])


def is_critical(channel: Column) -> Column:
    prefix = channel.startswith(CRITICAL_PREFIXES[0]) | channel.startswith(CRITICAL_PREFIXES[1])
    return F.coalesce(channel.isin(*CRITICAL_CHANNELS) | prefix, F.lit(False))


def drop_report(drops: DataFrame, every: str = "60 seconds", delay: str | None = None) -> DataFrame:
    """[subscriber, minute, dropped, critical] (T2), event time; give ``delay`` for a stream."""
    rows = drops if delay is None else drops.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", every).alias("w"), "subscriber").agg(F.count(F.lit(1)).alias("dropped"), F.count(F.when(is_critical(F.col("channel")), 1)).alias("critical"))
    return out.select("subscriber", F.col("w.start").alias("minute"), "dropped", "critical")


# render operations: [doc_id, _id, op, id, type, parent, props (JSON), text, nodes (JSON)]

def _node(ops: DataFrame) -> str:
    return f"doc_id {ops.schema['doc_id'].dataType.simpleString()}, id string, type string, parent string, props string, md string"


def new_tree() -> dict:
    return {}


def apply_op(nodes: dict, op: dict) -> None:
    """Fold one operation into {id: {type, parent, props, md: [pieces]}} (T4). A repeated insert changes nothing; what
    names a missing node is ignored; remove takes the direct children along."""
    kind, i = op["op"], op.get("id")
    if kind == "insert":
        nodes.setdefault(i, {"type": op.get("type"), "parent": op.get("parent") or "root", "props": json.loads(op.get("props") or "{}"), "md": []})
    elif kind == "replace":
        nodes.clear()
        for k, v in json.loads(op.get("nodes") or "{}").items():
            nodes[k] = {"type": v.get("type"), "parent": v.get("parent"), "props": v.get("props") or {}, "md": [v.get("md") or ""]}
    elif i in nodes:
        if kind == "append":
            nodes[i]["md"].append(op.get("text") or "")
        elif kind == "setmd":
            nodes[i]["md"] = [op.get("text") or ""]
        elif kind == "update":
            nodes[i]["props"].update(json.loads(op.get("props") or "{}"))
        elif kind == "remove":
            del nodes[i]
            for c in [k for k, v in nodes.items() if v["parent"] == i]:
                del nodes[c]


def _columns(nodes: dict) -> dict[str, list]:
    shown = {"type": lambda v: v["type"], "parent": lambda v: v["parent"], "props": lambda v: json.dumps(v["props"], sort_keys=True, separators=(",", ":")), "md": lambda v: "".join(v["md"])}
    return {"id": list(nodes)} | {c: [f(v) for v in nodes.values()] for c, f in shown.items()}


def _rows(doc_id, nodes: dict) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": [doc_id] * len(nodes)} | _columns(nodes))


def _records(pdf: pd.DataFrame) -> list[dict]:
    return pdf.sort_values("_id").astype(object).where(pdf.notna(), None).to_dict("records")


def fold_ops(ops: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Nodes of every document after its operations in ``_id`` order, from nothing or from a snapshot (T4, T5). A document's
    operations are gathered and sorted by the engine, which costs nothing for each document in Python but the folding."""
    ship_package(ops.sparkSession)
    cols = ["doc_id", "_id", "op", "id", "type", "parent", "props", "text", "nodes"]
    rows = ops.select(cols)
    if snapshot is not None:
        held = F.struct("type", "parent", F.from_json("props", "map<string,string>").alias("props"), "md")
        start = snapshot.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", held)))).alias("nodes"))
        none = F.lit(None).cast("string")
        rows = rows.unionByName(start.select("doc_id", F.lit(-1).cast("long").alias("_id"), F.lit("replace").alias("op"), *(none.alias(c) for c in ("id", "type", "parent", "props", "text")), "nodes"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "type", "parent", "props", "md"]
        for b in parts:
            at, out = [], []
            for i, held in enumerate(b.column("ops")):
                nodes = new_tree()
                for op in held.as_py():
                    apply_op(nodes, op)
                out.append(_columns(nodes))
                at += [i] * len(nodes)
            cols = [pa.array([v for p in out for v in p[c]], pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *cols], ["doc_id", *names])

    own = F.sort_array(F.collect_list(F.struct(*cols[1:])))
    return rows.groupBy("doc_id").agg(own.alias("ops")).mapInArrow(run, _node(ops))


def fold_text(ops: DataFrame) -> DataFrame:
    """[doc_id, id, md] by built-in functions alone, for streams of insert, append, setmd and remove without children:
    text is the last setmd after the node's last insertion and the appends after that."""
    node = Window.partitionBy("doc_id", "id").orderBy("_id")
    up = node.rowsBetween(Window.unboundedPreceding, -1)
    life = F.coalesce(F.sum(F.when(F.col("op") == "remove", 1).otherwise(0)).over(up), F.lit(0))
    rows = ops.withColumn("life", life)
    own = Window.partitionBy("doc_id", "id", "life")
    rows = rows.withColumn("born", F.min(F.when(F.col("op") == "insert", F.col("_id"))).over(own)).withColumn("dead", F.max(F.col("op") == "remove").over(own))
    rows = rows.withColumn("last", F.max("life").over(Window.partitionBy("doc_id", "id"))).filter("life = last and not dead and born is not null and _id >= born")
    rows = rows.withColumn("set", F.max(F.when(F.col("op") == "setmd", F.col("_id"))).over(own))
    piece = F.when(F.col("op").isin("append", "setmd") & (F.col("set").isNull() | (F.col("_id") >= F.col("set"))), F.struct("_id", "text"))
    out = rows.groupBy("doc_id", "id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return out.select("doc_id", "id", F.array_join(F.transform("p", lambda x: x.text), "").alias("md"))


def fold_ops_stream(ops: DataFrame) -> DataFrame:
    """The nodes of every document a batch touches; what was applied before is state, so a restart goes on from there.
    Operations at or below a document's last ``_id`` are late or repeated and dropped."""
    ship_package(ops.sparkSession)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (-1, "{}")
        nodes = json.loads(held)
        for op in _records(pd.concat(list(parts))):
            if op["_id"] > seen:
                apply_op(nodes, op)
                seen = int(op["_id"])
        state.update((seen, json.dumps(nodes)))
        yield _rows(key[0], nodes)

    return ops.groupBy("doc_id").applyInPandasWithState(run, _node(ops), "seen long, nodes string", "update", "NoTimeout")


def apply_after(snapshot: DataFrame, ops: DataFrame, watermark: int) -> DataFrame:
    """Snapshot at ``watermark``, then the operations after it (T5)."""
    return fold_ops(ops.filter(F.col("_id") > watermark), snapshot)


def latest_status(events: DataFrame) -> DataFrame:
    """[doc_id, status] by the greatest ``_id`` (T6); a stream gives it in update mode."""
    return events.groupBy("doc_id").agg(F.max_by("status", "_id").alias("status"))


def rollback(ops: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Operations up to each document's latest point [doc_id, _id, kind]: a window checkpoint clears the recovery points before
    it, so whichever kind came last counts; documents without any lose all (T8)."""
    p = checkpoints.filter(F.col("kind").isin("recovery", "window")).groupBy("doc_id").agg(F.max("_id").alias("_cut"))
    return ops.join(p, "doc_id").filter(F.col("_id") <= F.col("_cut")).select(ops.columns)

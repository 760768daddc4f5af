"""Render trees of a running stream, a node at a time.

The state of a document is a set of maps: its nodes, the pieces of their texts, the children of each, and an undo log since the
last point to which a rollback would go. An operation reads and writes the entries it names, so what is written in a batch grows
with the operations and not with the tree; an append adds one piece. Only nodes that changed are put out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.session import ship_package

_NODE = "type string, parent string, props string, n int"


class TreeProcessor(StatefulProcessor):
    """Folds [seq, op, id, type, parent, props, text, nodes] in order of ``seq``. Beside the render operations: ``checkpoint`` (a window's
    end) and ``recovery`` (a closed block) set the point that ``rollback`` goes back to; whichever came last counts."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "id long, logged int, pointed boolean")
        self.nodes = handle.getMapState("nodes", "id string", _NODE)
        self.pieces = handle.getMapState("pieces", "id string, k int", "text string")
        self.children = handle.getMapState("children", "parent string, id string", "there boolean")
        self.log = handle.getMapState("log", "k int", "id string, was string")

    def close(self) -> None:
        pass

    def _text(self, i: str, n: int) -> list[str]:
        return [self.pieces.getValue((i, k))[0] for k in range(n)]

    def _note(self, i: str) -> None:
        """Writes down what a node was before it changes, once a point: enough to bring it back. Texts are not copied while they only
        grow: their length in pieces is."""
        if not self.pointed or i in self.noted:
            return
        self.noted.add(i)
        was = None
        if self.nodes.containsKey((i,)):
            kind, parent, props, n = self.nodes.getValue((i,))
            was = json.dumps([kind, parent, props, n, None])
        self.log.updateValue((self.logged,), (i, was))
        self.where[i] = self.logged
        self.logged += 1

    def _keep_text(self, i: str) -> None:
        """Before pieces are overwritten: those of the noted state go into the log."""
        if not self.pointed or i not in self.where:
            return
        k = self.where[i]
        was = self.log.getValue((k,))[1]
        if was is not None:
            kind, parent, props, n, text = json.loads(was)
            if text is None:
                self.log.updateValue((k,), (i, json.dumps([kind, parent, props, n, self._text(i, n)])))

    def _put(self, i: str, kind, parent, props: str, texts: list[str]) -> None:
        self.nodes.updateValue((i,), (kind, parent, props, len(texts)))
        self.children.updateValue((parent or "", i), (True,))
        for k, t in enumerate(texts):
            self.pieces.updateValue((i, k), (t,))

    def _take(self, i: str) -> None:
        _, parent, _, n = self.nodes.getValue((i,))
        for k in range(n):
            self.pieces.removeKey((i, k))
        self.nodes.removeKey((i,))
        self.children.removeKey((parent or "", i))

    def _drop(self, i: str) -> None:
        self._note(i)
        self._keep_text(i)
        self._take(i)
        self.changed.add(i)

    def _point(self) -> None:
        for key in [k for (k,) in self.log.keys()]:
            self.log.removeKey((key,))
        self.logged, self.noted, self.where, self.pointed = 0, set(), {}, True

    def _back(self) -> None:
        if not self.pointed:
            return
        for (_,), (i, was) in list(self.log.iterator()):
            self.changed.add(i)
            kind, parent, props, n, text = json.loads(was) if was is not None else (None,) * 5
            if was is not None and text is None:
                text = self._text(i, n)
            if self.nodes.containsKey((i,)):
                self._take(i)
            if was is not None:
                self._put(i, kind, parent, props, text)
        self._point()

    def _apply(self, op: dict) -> None:
        kind, i = op["op"], op.get("id")
        if kind in ("checkpoint", "recovery"):
            self._point()
        elif kind == "rollback":
            self._back()
        elif kind == "replace":
            for k in [k for (k,) in self.nodes.keys()]:
                self._drop(k)
            for k, v in json.loads(op.get("nodes") or "{}").items():
                self._note(k)
                self._put(k, v.get("type"), v.get("parent"), _json(v.get("props") or {}), [v.get("md") or ""])
                self.changed.add(k)
        elif kind == "insert":
            if not self.nodes.containsKey((i,)):
                self._note(i)
                self._put(i, op.get("type"), op.get("parent") or "root", _json(json.loads(op.get("props") or "{}")), [])
                self.changed.add(i)
        elif i is not None and self.nodes.containsKey((i,)):
            self._note(i)
            self.changed.add(i)
            own, parent, props, n = self.nodes.getValue((i,))
            if kind == "append":
                self.pieces.updateValue((i, n), (op.get("text") or "",))
                self.nodes.updateValue((i,), (own, parent, props, n + 1))
            elif kind == "setmd":
                self._keep_text(i)
                for k in range(1, n):
                    self.pieces.removeKey((i, k))
                self.pieces.updateValue((i, 0), (op.get("text") or "",))
                self.nodes.updateValue((i,), (own, parent, props, 1))
            elif kind == "update":
                merged = json.loads(props) | json.loads(op.get("props") or "{}")
                self.nodes.updateValue((i,), (own, parent, _json(merged), n))
            elif kind == "remove":
                for c in [c for p, c in self.children.keys() if p == i and c != i]:
                    self._drop(c)
                self._drop(i)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        last, self.logged, self.pointed = self.seen.get() if self.seen.exists() else (-1, 0, False)
        self.where = {i: k for (k,), (i, _) in self.log.iterator()} if self.pointed else {}
        self.noted, self.changed = set(self.where), set()
        pdf = pd.concat(frames).sort_values("seq")
        for op in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            if op["seq"] > last:
                last = int(op["seq"])
                self._apply(op)
        self.seen.update((last, self.logged, self.pointed))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out = []
        for i in sorted(self.changed):
            if self.nodes.containsKey((i,)):
                kind, parent, props, n = self.nodes.getValue((i,))
                out.append((key[0], i, kind, parent, props, "".join(self._text(i, n)), False))
            else:
                out.append((key[0], i, None, None, None, None, True))
        yield pd.DataFrame(out, columns=["doc_id", "id", "type", "parent", "props", "md", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A document that was idle leaves no state behind."""
        for state in (self.seen, self.nodes, self.pieces, self.children, self.log):
            state.clear()
        yield pd.DataFrame([], columns=["doc_id", "id", "type", "parent", "props", "md", "gone"])


def _json(props: dict) -> str:
    return json.dumps(props, sort_keys=True, separators=(",", ":"))


def fold_tree_stream(ops: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """[doc_id, id, type, parent, props, md, gone]: the nodes each batch changes, as they are after it; ``gone`` ones are removed. Operations
    at or below a document's last ``_id`` are late or repeated and dropped. ``idle_ms`` (processing time) is how long a document may
    be idle before its state goes. Needs the RocksDB state store provider, as maps in state do."""
    ship_package(ops.sparkSession)
    cols = ["doc_id", "_id", "op", "id", "type", "parent", "props", "text", "nodes"]
    doc = ops.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {doc}, id string, type string, parent string, props string, md string, gone boolean"
    mode = "ProcessingTime" if idle_ms else "None"
    return ops.select(cols).withColumnRenamed("_id", "seq").withColumn("seq", F.col("seq").cast("long")).groupBy("doc_id").transformWithStateInPandas(TreeProcessor(idle_ms), out, "update", mode)

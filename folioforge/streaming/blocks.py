"""Complete blocks from text deltas, wherever the text was cut.

State per (document, stage) is the unfinished tail; a block is emitted when its end line is complete; the tail is flushed
at the end and what is unclosed then is dropped.

``pass2``: fences and text outside blocks do not matter; repeated (type, target) and kinds not enabled are dropped.

``pass1``: fences come first. A line of a fence, the fence lines themselves, and a page marker never start or end a block:
inside a summary they are its content (a marker as an anchor element), anywhere else they are body text. Summaries are
kept, their target is the number of the section they stand in; title and digest are kept, white space collapsed, until
the first line of body text, heading, fence or page marker (an empty line is body text, too); other blocks are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import ship_package

# fixed values: patterns of lines
OPEN, CLOSE, FENCE = re.compile(r"^@@([^\s@]+)(?:\s+(\S+))?\s*$"), re.compile(r"^@@\s*end$", re.I), re.compile(r"^\s*(```|~~~)")
PAGE, HEADING = re.compile(r"^<!--\s*page:\s*(\d+)\s*-->\s*$"), re.compile(r"^(#{2,4})\s+(.+?)\s*$")
ANCHOR = '<span class="page-anchor" data-page="{}"></span>'


class BlockReader:
    """Feed text in any pieces; ``take`` gives the blocks completed since."""

    def __init__(self, mode: str = "pass2", enabled: tuple[str, ...] | None = None, state: str | None = None):
        self.mode, self.enabled = mode, enabled
        s = json.loads(state) if state else {}
        self.tail, self.cur, self.n = s.get("tail", ""), s.get("cur"), s.get("n", 0)
        self.seen = {tuple(x) for x in s.get("seen", [])}
        self.fenced, self.body, self.counts = s.get("fenced", False), s.get("body", False), s.get("counts", [0, 0, 0])
        self.done: list[tuple] = []

    def state(self) -> str:
        return json.dumps({"tail": self.tail, "cur": self.cur, "n": self.n, "seen": sorted(self.seen), "fenced": self.fenced, "body": self.body, "counts": self.counts})

    def feed(self, text: str) -> None:
        *lines, self.tail = (self.tail + text).split("\n")
        for line in lines:
            self._line(line)

    def flush(self) -> None:
        if self.tail:
            self._line(self.tail)
        self.tail = ""

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def _line(self, line: str) -> None:
        s = line.strip()
        if self.mode == "pass1":
            fence = FENCE.match(line) if s.startswith(("```", "~~~")) else None
            page = PAGE.match(s) if s.startswith("<!--") and not self.fenced else None
            if fence or self.fenced or page:
                self.fenced ^= bool(fence)
                self.body = True
                if self.cur and self.cur[0] == "summary":
                    self.cur[2].append(ANCHOR.format(page[1]) if page else line)
                return
        marked = s.startswith("@@")  # looked for before the patterns, which is much cheaper
        if self.cur is not None:
            if marked and CLOSE.match(s):
                (kind, target, lines), self.cur = self.cur, None
                self._emit(kind, target, lines)
            else:
                self.cur[2].append(line)
        elif not (marked and CLOSE.match(s)):
            if m := OPEN.match(s) if marked else None:
                self._open(m[1], m[2] or "")
            else:
                self.body = True
                if self.mode == "pass1" and line.startswith("##") and (h := HEADING.match(line)):
                    k = len(h[1]) - 2
                    self.counts = [*self.counts[:k], self.counts[k] + 1, *[0] * (2 - k)]

    def _open(self, kind: str, target: str) -> None:
        if self.mode == "pass1":
            if kind in ("title", "digest") and not self.body:
                target = ""
            elif kind == "summary":
                shown = max([k for k in range(3) if self.counts[k]], default=-1)
                target = ".".join(map(str, self.counts[: shown + 1]))
            else:
                kind = ""
        self.cur = [kind, target, []]

    def _emit(self, kind: str, target: str, lines: list[str]) -> None:
        content = "\n".join(lines).strip()
        if self.mode == "pass1":
            content = content if kind == "summary" else " ".join(content.split())
            kept = bool(kind)
        else:
            kept = (self.enabled is None or kind in self.enabled) and (kind, target) not in self.seen
        if content and kept:
            if self.mode == "pass2":
                self.seen.add((kind, target))
            self.done.append((self.n, kind, target, content))
            self.n += 1


def _schema(deltas: DataFrame) -> str:
    return f"doc_id {deltas.schema['doc_id'].dataType.simpleString()}, ord int, type string, target string, content string"


def read_blocks(deltas: DataFrame, mode: str = "pass2", enabled: tuple[str, ...] | None = None) -> DataFrame:
    """[doc_id, ord, type, target, content] of deltas [doc_id, seq, delta], all at once. A document's deltas are put together before they
    leave the engine, as the blocks do not depend on the cuts; the reader goes over whole texts."""
    ship_package(deltas.sparkSession)
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("x"))))
    texts = deltas.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p.x), "").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at, rows = [], []
            for i, text in enumerate(b.column("text")):
                r = BlockReader(mode, enabled)
                r.feed(text.as_py())
                r.flush()
                rows += (found := r.take())
                at += [i] * len(found)
            cols = zip(*rows) if rows else [[]] * 4
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, cols, kinds)], ["doc_id", "ord", "type", "target", "content"])

    return texts.mapInArrow(run, _schema(deltas))


def blocks_stream(deltas: DataFrame, mode: str = "pass2", enabled: tuple[str, ...] | None = None) -> DataFrame:
    """The same over a stream [doc_id, seq, delta, last]: a delta marked ``last`` flushes the tail."""
    ship_package(deltas.sparkSession)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, held = state.get if state.exists else (-1, None)
        r = BlockReader(mode, enabled, held)
        for d in pd.concat(list(parts)).sort_values("seq").itertuples():
            if d.seq > seen:
                r.feed(d.delta or "")
                if d.last:
                    r.flush()
                seen = int(d.seq)
        state.update((seen, r.state()))
        yield pd.DataFrame([(key[0], *x) for x in r.take()], columns=["doc_id", "ord", "type", "target", "content"])

    return deltas.groupBy("doc_id").applyInPandasWithState(run, _schema(deltas), "seen long, reader string", "append", "NoTimeout")

"""Chat formatting by incremental black-box rendering.

A template is any object with ``render(turns) -> str``; nothing else about it is assumed. Successive prefixes of a
conversation are rendered and consecutive outputs compared: where the later one continues the earlier one, the added
stretch is the turn's span; where it does not, the template has rewritten history, which is reported and leaves that
conversation without spans. Where in a span the turn's text lies is found by rendering the turn with two probe texts:
they differ first where the text starts.

Every prefix is rendered whole, so a rewriting shows at whatever turn it happens, even if a later turn undoes it. That costs a
conversation's length times its turns; ``ControlTemplate`` keeps what it wrote for each turn, so rendering a prefix again only
joins strings. A template known to look at no more than its last turns may be given a ``window``: a turn is then rendered after
the turns before it in the window, and the stretches, laid end to end, are held against the whole output and some whole
prefixes. Nothing uses that unless asked to.

``ControlTemplate`` marks turns by control strings and escapes every control string inside texts and roles with a
backslash, reversibly. Rows of a conversation are ordered by turn, then role and text.

Defined results: null text and null role count as empty; rows with a null conversation id form one conversation;
repeated rows are repeated turns; an empty table gives an empty result. A conversation is one output string, so it is
held by one task; tasks hold one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batches, map_arrow

#: Turns whose written form a template keeps.
KEPT_TURNS = 100_000
Turn = tuple[str, str]
Span = tuple[int, int]


class ControlTemplate:
    """``open`` role ``\\n`` text ``close``, turn after turn."""

    def __init__(self, open: str = "<|turn|>", close: str = "<|end|>", others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")):
        self.open, self.close = open, close
        controls = sorted({open, close, *others}, key=len, reverse=True)
        self._control = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))
        self._written: dict[Turn, str] = {}
        self._turn = re.compile(rf"{re.escape(open)}((?:\\.|[^\\\n])*)\n(.*?){re.escape(close)}", re.S)

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def _role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\\n")  # no bare line end

    def _write(self, turn: Turn) -> str:
        out = self._written.get(turn)
        if out is None:
            if len(self._written) >= KEPT_TURNS:
                self._written.clear()
            role, text = turn
            out = self._written[turn] = f"{self.open}{self._role(role)}\n{self.escape(text)}{self.close}"
        return out

    def forget(self) -> None:
        """Drops what was kept; called between conversations."""
        self._written.clear()

    def render(self, turns: list[Turn]) -> str:
        return "".join(map(self._write, turns))

    def parse(self, output: str) -> list[Turn]:
        return [(self.unescape(r), self.unescape(t)) for r, t in self._turn.findall(output)]


def turn_spans(render: Callable[[list[Turn]], str], turns: list[Turn], window: int | None = None) -> tuple[str, list[Span] | None, list[int]]:
    """(output, span of each turn, turns at which history was rewritten); spans are None after a rewriting."""
    full = render(turns)
    if window and len(turns) > window:
        added, at, due = [], 0, window
        for k in range(len(turns)):
            past = turns[max(0, k - window + 1) : k]
            before, after = render(past) if past else "", render([*past, turns[k]])
            new = after[len(before) :]
            if not after.startswith(before) or not full.startswith(new, at):
                break
            added.append(len(new))
            at += len(new)
            if k + 1 == due:  # until here each prefix, then each doubled one, is the output so far
                if render(turns[:due]) != full[:at]:
                    break
                due *= 2
        if len(added) == len(turns) and at == len(full):
            return full, _laid_out(added), []
    before, added, rewritten = "", [], []
    for k in range(1, len(turns) + 1):
        after = render(turns[:k])
        if not after.startswith(before):
            rewritten.append(k - 1)
        added.append(len(after) - len(before))
        before = after
    return full, None if rewritten else _laid_out(added), rewritten


def _laid_out(lengths: list[int]) -> list[Span]:
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def text_spans(render: Callable[[list[Turn]], str], turns: list[Turn], spans: list[Span], output: str, roles: frozenset[str]) -> list[Span]:
    """Where the texts of the turns with one of ``roles`` lie in the output."""
    found, frames = [], {}
    for k, ((role, _), (start, end)) in enumerate(zip(turns, spans)):
        if role not in roles:
            continue
        key = (role, turns[k - 1][0] if k else None)
        for fresh in (False, True):  # the frame of an earlier like turn is tried first
            if fresh or key not in frames:
                past = turns[:k]
                base = render(past) if past else ""
                x, y = (render([*past, (role, probe)])[len(base) :] for probe in ("x", "y"))
                head = len(commonprefix([x, y]))
                frames[key] = x[:head], x[head + 1 :]
            head, tail = frames[key]
            if output.startswith(head, start) and output.endswith(tail, start, end) and start + len(head) <= end - len(tail):
                found.append((start + len(head), end - len(tail)))
                break
        else:
            raise ValueError("the template does not show this turn's text in one piece")
    return found


def _conversations(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    rows = (r for b in parts for r in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, [(r or "", t or "") for _, r, t in own]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(rows: DataFrame, template=None, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """[conv_id, formatted, turn_spans, loss_spans, rewritten]: one row per conversation, places in code points."""
    template, roles = template or ControlTemplate(), frozenset(trained_roles)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turn_spans", _SPANS), ("loss_spans", _SPANS), ("rewritten", pa.list_(pa.int32()))])
    forget = getattr(template, "forget", None)
    as_rows = lambda spans: None if spans is None else [{"start": a, "end": b} for a, b in spans]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(conv, turns):
            out, spans, rewritten = turn_spans(template.render, turns)
            loss = None if spans is None else text_spans(template.render, turns, spans, out, roles)
            if forget:
                forget()
            return {"conv_id": conv, "formatted": out, "turn_spans": as_rows(spans), "loss_spans": as_rows(loss), "rewritten": rewritten}

        yield from batches((one(c, t) for c, t in _conversations(parts)), schema, 256)

    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    spans = "array<struct<start: long, end: long>>"
    return map_arrow(turns, run, f"conv_id long, formatted string, turn_spans {spans}, loss_spans {spans}, rewritten array<int>")


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """[conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars], all taken from the formatted text."""
    template = template or ControlTemplate()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for conv, out, spans in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = template.parse(out)
                said = hashlib.sha256()
                for role, text in turns:
                    said.update(f"{role}\n{text}\n".encode())
                loss = "".join([template.unescape(out[s["start"] : s["end"]]) for s in spans or ()])
                rows.append((conv, len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return map_arrow(formatted.select("conv_id", "formatted", "loss_spans"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

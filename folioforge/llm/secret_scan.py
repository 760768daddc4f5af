"""Secret scans with a recursive decoding worklist.

Three patterns are searched in the text itself, and then in everything that can be unwrapped from it: percent and Unicode
escapes, base64 runs (also wrapped over lines, or joined to other words of the same letters), zlib, gzip or bzip2 data
anywhere inside those, raw deflate data at the start of a base64 run, and two-byte text (UTF-16) inside any of them.
Decoded bytes are read as Latin-1, one character a byte, so no byte is lost or rejected; the patterns and encodings are
ASCII, so this finds what UTF-8 would. Each decoded layer keeps, for each of its characters, the stretch of the original
text it came from, so that finds map back to original spans however deep they lie. The worklist is a stack of layers being
opened, so only the layers around the present one are held; one seen before with the same text in the same places is not
scanned again, which also ends cycles: only packed data can grow, and all its characters share one place.

Escapes of both kinds are decoded together: a line has one view a depth, not one for every order of the kinds, and beside
each of these the two views with one kind decoded and the other left are searched. A line is decoded until nothing is left
to decode. Every view is shorter than the one before; where all that changes is that an escaped escape sign loses one more of its
codes, the views between are not built, as their finds follow from the first (``_skipped``).

Unpacked data of any size is scanned in overlapping windows. A window that ends within a base64 run, a line with escapes,
two-byte text or a packed stream is kept from the start of that on and grows until it is whole, so nothing is cut; memory is
bounded by the window and the longest such piece.

Defined results: null text counts as empty and has no spans; overlapping finds are all reported; repeated rows give
repeated rows; broken packed data is read up to the break.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Generator, Iterator, Sequence
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import documents, map_arrow, raw_texts

#: Characters of unpacked data held at a time at least, and what two windows share at least.
WINDOW, OVERLAP = 16 << 20, 1 << 20
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{24}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
UNICODE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
ESCAPE = re.compile(f"{PERCENT.pattern}|{UNICODE.pattern}")
#: An escape sign whose own code is escaped again and again.
CHAIN = re.compile(r"%(?:25)+|\\(?:x5[cC])+|\\(?:u005[cC])+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t>]*+[A-Za-z0-9+/_-]++)+={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
WIDE = re.compile(r"(?:[^\0]\0){8,}|(?:\0[^\0]){8,}")
BLANKS = re.compile(rb" {1024,}")
URL_SAFE = str.maketrans("-_", "+/")
BZIP2 = b"BZh"
BASE64_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: A stream that goes on where its data ends.
OPEN = -1
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
#: Whatever a decoded layer can be opened or searched for; bytes without any of it need no layer.
WORTH = re.compile(rb"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[ux]|[A-Za-z0-9+/_\-\s>]{16}|(?:[^\0]\0){8}|(?:\0[^\0]){8}|" + PACKED.pattern)

Layer = tuple[str, Sequence[int], Sequence[int]]  # text, and where each character starts and ends in the original


class Same(Sequence):
    """``n`` times one place, as all characters of unpacked data have; unpacked data can be long."""

    def __init__(self, place: int, n: int):
        self.place, self.n = place, n

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[int]:
        return repeat(self.place, self.n)

    def __getitem__(self, i):
        return Same(self.place, len(range(*i.indices(self.n)))) if isinstance(i, slice) else self.place


class Spread(Sequence):
    """Places of ``n`` bytes read from base64 letters: byte ``i`` lies in the letters from ``at`` + 8i/6 to ``at`` + (8i + 7)/6."""

    def __init__(self, base: Sequence[int], at: int, n: int, last: bool):
        self.base, self.at, self.n, self.more = base, at, n, 7 if last else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        if isinstance(i, slice):
            return array("q", [self.base[self.at + (k * 8 + self.more) // 6] for k in range(*i.indices(self.n))])
        return self.base[self.at + ((i if i >= 0 else self.n + i) * 8 + self.more) // 6]


class Lines(Sequence):
    """Places of some stretches of a layer, laid end to end."""

    def __init__(self, base: Sequence[int], spans: list[tuple[int, int]]):
        self.base, self.starts = base, array("q", [a for a, _ in spans])
        self.firsts = array("q", accumulate([b - a for a, b in spans], initial=0))

    def __len__(self) -> int:
        return self.firsts[-1]

    def __getitem__(self, i):
        if isinstance(i, slice):
            return array("q", [self[k] for k in range(*i.indices(len(self)))])
        i = i if i >= 0 else len(self) + i
        line = bisect_right(self.firsts, i) - 1
        return self.base[self.starts[line] + i - self.firsts[line]]


def _places_key(p: Sequence[int]):
    if isinstance(p, Same):
        return p.place
    if isinstance(p, Spread):
        return p.at, p.n, p.more, _places_key(p.base)
    if isinstance(p, Lines):
        return hash(p.starts.tobytes()), hash(p.firsts.tobytes()), _places_key(p.base)
    return (p.start, p.stop) if isinstance(p, range) else hash(p.tobytes())


def _key(layer: Layer) -> tuple:
    """Layers equal in text and places have the same finds; the same text elsewhere has others."""
    text, lo, hi = layer
    return len(text), hash(text), _places_key(lo), _places_key(hi)


def _named(raw: bytes) -> bool:
    """Whether one of the names occurs, in either case; long data is lower-cased piece by piece."""
    for i in range(0, len(raw), 1 << 20):
        low = raw[i : i + (1 << 20) + 16].lower()
        if any(n in low for n in NAMES):
            return True
    return False


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns in one text."""
    raw = text.encode("latin-1", "replace") if raw is None else raw
    found = []
    if _named(raw):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(raw):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def _decode(layer: Layer, pattern: re.Pattern) -> Layer:
    """The layer with every escape of a pattern decoded; each character lies where its escape was."""
    text, lo, hi = layer
    out, new_lo, new_hi, at = [], array("q"), array("q"), 0
    for m in pattern.finditer(text):
        a, b = m.span()
        code = int(m[m.lastindex], 16)
        out += [text[at:a], chr(code) if code < 0xD800 or 0xE000 <= code <= 0x10FFFF else "\ufffd"]
        new_lo.extend(lo[at:a])
        new_hi.extend(hi[at:a])
        new_lo.append(lo[a])
        new_hi.append(hi[b - 1])
        at = b
    out.append(text[at:])
    new_lo.extend(lo[at:])
    new_hi.extend(hi[at:])
    return "".join(out), new_lo, new_hi


def _skipped(layer: Layer, found: set[tuple[int, int, int]]) -> Layer | None:
    """The layer some depths on, where every escape in it is a sign whose own code is escaped again and again: until the
    shortest such chain is nearly spent, a depth only takes one code from each. A chain of percent signs stands before hex digits,
    of which every depth shows fewer, so those finds are added; no other pattern has an escape sign in it or minds digits before it."""
    text, lo, hi = layer
    chains = []
    for m in ESCAPE.finditer(text):
        c = CHAIN.match(text, m.start())
        if not c:
            return None
        unit = 2 if text[c.start()] == "%" else 3 if text[c.start() + 1] == "x" else 5
        chains.append((c.start(), unit, (c.end() - c.start() - 1) // unit))
    depths = min((n for _, _, n in chains), default=0) - 2
    if depths < 2:
        return None
    out, new_lo, new_hi, at = [], array("q"), array("q"), 0
    for a, unit, _ in chains:
        if unit == 2:
            end = HEX.match(text, a + 1).end()
            found.update((lo[i], 2, hi[end - 1]) for i in range(a + 3, min(a + 1 + 2 * depths, end - 23), 2))
        out.append(text[at : a + 1])
        new_lo.extend(lo[at : a + 1])
        new_hi.extend(hi[at:a])
        at = a + 1 + depths * unit
        new_hi.append(hi[at - 1])
    out.append(text[at:])
    new_lo.extend(lo[at:])
    new_hi.extend(hi[at:])
    return "".join(out), new_lo, new_hi


def _views(layer: Layer, found: set[tuple[int, int, int]]) -> Iterator[Layer]:
    """Each line that holds escapes, with the escapes decoded once, twice and so on until none is left."""
    text, lo, hi = layer
    done = 0
    while first := ESCAPE.search(text, done):
        start, end = text.rfind("\n", 0, first.start()) + 1, text.find("\n", first.start())
        end = len(text) if end < 0 else end
        done = end
        view = text[start:end], lo[start:end], hi[start:end]
        if "+" in view[0] and PERCENT.search(view[0]):  # the form of submitted fields: a plus is a blank
            yield _decode((view[0].replace("+", " "), view[1], view[2]), ESCAPE)
        while ESCAPE.search(view[0]):
            later = _skipped(view, found)
            if not later and PERCENT.search(view[0]) and UNICODE.search(view[0]):
                yield _decode(view, PERCENT)
                yield _decode(view, UNICODE)
            view = later or _decode(view, ESCAPE)
            yield view


def _inflate(view: memoryview, at: int, kind: int) -> Generator[bytes, None, int]:
    """Pieces of what the stream at ``at`` unpacks to; returns where it ends. ``zlib.error`` where it breaks."""
    opener = zlib.decompressobj(kind)
    for i in range(at, len(view), 1 << 16):
        rest = view[i : i + (1 << 16)]
        fed = len(rest)
        while True:
            out = opener.decompress(rest, 1 << 20)
            if out:
                yield out
            rest = opener.unconsumed_tail
            if opener.eof:
                return i + fed - len(opener.unused_data)
            if not rest and len(out) < 1 << 20:
                break
    return OPEN


def _bunzip(view: memoryview, at: int) -> Generator[bytes, None, int]:
    """The same for bzip2; a break is an ``OSError`` or a ``ValueError``."""
    opener = bz2.BZ2Decompressor()
    for i in range(at, len(view), 1 << 16):
        rest = view[i : i + (1 << 16)]
        fed = len(rest)
        while True:
            out = opener.decompress(rest, 1 << 20)
            if out:
                yield out
            if opener.eof:
                return i + fed - len(opener.unused_data)
            rest = b""
            if opener.needs_input:
                break
    return OPEN


def _members(data: bytes, at: int) -> Generator[bytes, None, tuple[int, int, bool]]:
    """Pieces of the packed members from ``at`` on, which are one text; returns where they end, the place before which nothing
    else is to be looked for (broken data may hold other members inside), and whether ``data`` ends before they do."""
    view = memoryview(data)
    while PACKED.match(data, at):
        try:
            end = yield from _bunzip(view, at) if data.startswith(BZIP2, at) else _inflate(view, at, 47)
        except (zlib.error, OSError, ValueError):
            return len(data), at + 1, False
        if end == OPEN:
            return len(data), len(data), True
        at = end
    return at, at, False


def _ended(pieces: Generator):
    while True:
        try:
            next(pieces)
        except StopIteration as end:
            return end.value


def _letters_from(data: bytes) -> int:
    """Where the base64 letters start that ``data`` ends with, whole lines of them before included."""
    at = end = len(data)
    while end >= 0:
        start = data.rfind(b"\n", 0, end) + 1
        line = data[start:end].rstrip(b" \t\r=")
        own = line.lstrip(b" \t>")
        tail = len(own) - len(own.rstrip(BASE64_LETTERS))
        if tail < len(own):
            return start + len(line) - tail if tail else at
        if not own and end < len(data):
            return at
        at, end = start, start - 1
    return at


def _encoded_from(data: bytes) -> int:
    """Where the encoded piece starts that may go on after the end of ``data``: letters of base64 over any number of lines, a line
    with escapes, two-byte text, or a packed stream; the end where there is none."""
    at = _letters_from(data)
    line = data.rfind(b"\n") + 1
    if b"%" in data[line:] or b"\\" in data[line:]:
        at = min(at, line)
    zero = np.frombuffer(data, np.uint8) == 0
    alike = np.flatnonzero(zero[1:] == zero[:-1])
    wide = int(alike[-1]) + 1 if len(alike) else 0  # from here on every other byte is zero
    at = min(at, wide) if len(data) - wide >= 2 else at
    done = 0
    for m in PACKED.finditer(data):
        if m.start() >= done:
            _, done, goes_on = _ended(_members(data, m.start()))
            if goes_on:
                return min(at, m.start())
    return at


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """Overlapping windows, none of which ends within what the next would need whole. Long runs of blanks are shortened, as no
    pattern minds how long they are."""
    held, fresh, limit = bytearray(), False, WINDOW
    for piece in pieces:
        held += piece
        fresh = True
        if len(held) >= limit:
            held = bytearray(BLANKS.sub(b" " * 1024, held))
            yield held.decode("latin-1")
            del held[: min(_encoded_from(bytes(held)), max(len(held) - OVERLAP, 0))]
            limit = max(WINDOW, 2 * len(held))
            fresh = False
    if fresh:
        yield BLANKS.sub(b" " * 1024, held).decode("latin-1")


def unpacked(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Windows of the contents, start and end of what is packed anywhere in ``data``."""
    done = 0
    for m in PACKED.finditer(data):
        if m.start() >= done:
            end, done, _ = _ended(_members(data, m.start()))
            for plain in _windows(_members(data, m.start())):
                yield plain, m.start(), end


def deflated(data: bytes) -> Iterator[tuple[str, int]]:
    """Windows of the contents, and the end, of raw deflate data that ``data`` starts with."""
    try:
        end = _ended(_inflate(memoryview(data), 0, -15))
    except zlib.error:
        return
    end = len(data) if end == OPEN else end
    for plain in _windows(_inflate(memoryview(data), 0, -15)):
        if WORTH.search(plain.encode("latin-1")):
            yield plain, end


def _packed(layer: Layer) -> Iterator[Layer]:
    text, lo, hi = layer
    for plain, a, b in unpacked(text.encode("latin-1", "replace")):  # no part of packed data stands for one character
        yield plain, Same(lo[a], len(plain)), Same(hi[b - 1], len(plain))


def _opened(run: str, lo: Sequence[int], hi: Sequence[int], at: int, end: int, known: bool) -> Iterator[Layer]:
    """A run, whose first letter is ``at`` in its places, read from each of four letters on, as what precedes the data in a run
    may have any length. ``known``: all but raw deflate data, which is looked for at the start only, has been looked for already."""
    run = run.rstrip("=")
    letters = (run.translate(URL_SAFE) if "-" in run or "_" in run else run).encode() + b"==="
    view = memoryview(letters)
    for a in range(min(4, len(run))):
        data = binascii.a2b_base64(view[a : -4 if (len(run) - a) % 4 == 1 else len(letters)])
        ends = lambda e: end if e == len(data) else hi[at + a + (e * 8 - 1) // 6]  # noqa: B023, E731
        for plain, e in deflated(data):
            yield plain, Same(lo[at + a], len(plain)), Same(ends(e), len(plain))
        if known or not WORTH.search(data):
            continue
        yield data.decode("latin-1"), Spread(lo, at + a, len(data), False), Spread(hi, at + a, len(data), True)
        for plain, s, e in unpacked(data):
            yield plain, Same(lo[at + a + s * 8 // 6], len(plain)), Same(ends(e), len(plain))


def _base64(layer: Layer, opened: dict[int, str]) -> Iterator[Layer]:
    """``opened`` has, by where they end, the runs of the view before: of one that has only become shorter in front, everything
    but its start has been read."""
    text, lo, hi = layer
    for m in BASE64.finditer(text):
        a, b = m.span()
        known = opened.get(hi[b - 1], "").endswith(m[0])
        yield from _opened(m[0], lo, hi, a, hi[b - 1], known)
        opened[hi[b - 1]] = m[0]
    for m in WRAPPED.finditer(text):
        lines = [x.span() for x in LETTERS.finditer(text, m.start(), m.end())]
        if sum(b - a for a, b in lines) >= 16:
            yield from _opened("".join([text[a:b] for a, b in lines]), Lines(lo, lines), Lines(hi, lines), 0, hi[m.end() - 1], False)


def _every_other(text: str) -> bool:
    """Whether eight NULs stand at every other character somewhere."""
    zero = np.frombuffer(text.encode("latin-1", "replace"), np.uint8) == 0
    for step in (2, 4, 8):
        zero = zero[:-step] & zero[step:]
    return bool(zero.any())


def _wide(layer: Layer) -> Iterator[Layer]:
    """Two-byte text: every other character is NUL."""
    text, lo, hi = layer
    if "\0" in text and _every_other(text):
        for m in WIDE.finditer(text):
            a, b = m.span()
            yield text[a + (text[a] == "\0") : b : 2], lo[a:b:2], hi[a + 1 : b : 2]


def _inside(layer: Layer, found: set[tuple[int, int, int]], opened: dict[int, str]) -> Iterator[Layer]:
    """Looks through a layer and gives what one step other than an escape unwraps from it."""
    text, lo, hi = layer
    found.update((lo[a], k, hi[b - 1]) for a, k, b in base_spans(text))
    yield from _base64(layer, opened)
    yield from _wide(layer)
    yield from _packed(layer)


def _steps(layer: Layer, found: set[tuple[int, int, int]]) -> Iterator[Layer]:
    yield from _inside(layer, found, {})
    opened: dict[int, str] = {}
    for view in _views(layer, found):
        yield from _inside(view, found, opened)


def decoded_spans(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) in original places of what shows in the text or after decoding."""
    found: set[tuple[int, int, int]] = set()
    seen: set[tuple] = set()
    work = [_steps((text, range(len(text)), range(1, len(text) + 1)), found)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        elif (key := _key(inner)) not in seen:
            seen.add(key)
            work.append(_steps(inner, found))
    return found


def scan(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each (start, kind, end) in order."""
    text = raw.decode()
    base = base_spans(text, raw)
    return base, sorted({*base, *decoded_spans(text)})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """[doc_id, n_assign, n_access, n_hex, base_sha256, spans]; counts and digest are of the spans in the text itself."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for raw in raw_texts(b):
                base, every = scan(raw)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(documents(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(raw: bytes, mark: str = "[secret]") -> str | None:
    """The text with every secret span replaced, overlapping ones as one; None where there is none."""
    spans = scan(raw)[1]
    if not spans:
        return None
    text, out, at = raw.decode(), [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns, secrets replaced in ``text``; ``n_chars``, where there is one, follows the new text."""
    cols = docs.columns
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*cols).alias("row"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([redacted(t) for t in raw_texts(b)], pa.string()), b.column("row")], ["new", "row"])

    out = map_arrow(rows, run, f"new string, row {rows.schema['row'].dataType.simpleString()}")
    swap = {"text": F.coalesce("new", "row.text")}
    if "n_chars" in cols:
        swap["n_chars"] = F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(swap.get(c, F.col("row")[c]).alias(c) for c in cols))

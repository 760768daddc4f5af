"""Byte-level BPE encoding and decoding by a contiguous rank array.

A text is cut into pre-tokens; a short pre-token is held as two plain arrays, part boundaries and the merge rank of each
neighbouring pair. The least rank is found by a scan, its boundary is deleted and the two ranks beside it are looked up
anew, until no pair can merge. Long pre-tokens use a heap over the same boundaries, so that they stay near-linear.

Texts are split at single blanks between two non-blanks, where no pre-token can reach across, and what each piece
encodes to is kept in a bounded table, as words repeat. A table that is full is emptied; results do not depend on it.
Pre-tokens are independent of each other, so it changes nothing who cuts them: the compiled encoder cuts short pieces
itself and is handed the single pre-tokens of long ones, as its stack does not bear a million blanks.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")
SHORT = 64
NEVER = 1 << 40
#: Longer pieces are cut into pre-tokens here: the compiled encoder's own cutting recurses over a run of white space.
COMPILED_CUT = 10_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        to_bytes = lambda s: bytes(letter[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[self.ids[left], self.ids[right]] = (r, self.ids[left + right])
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.piece: list[bytes] = [b""] * self.size
        for b, i in self.ids.items():
            self.piece[i] = b
        for s, i in self.special.items():
            self.piece[i] = s.encode()
        self._at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(word) if len(word) == 1 else None
        if whole is not None:
            return [whole]
        part = [self.byte_id[b] for b in word]
        return self._scan(part) if len(part) <= SHORT else self._heap(part)

    def _scan(self, part: list[int]) -> list[int]:
        rank = self.rank
        near = [rank.get(p, (NEVER, 0)) for p in zip(part, part[1:])]
        while near:
            best = min(near)
            if best[0] == NEVER:
                break
            i = near.index(best)
            part[i] = best[1]
            del part[i + 1], near[i]
            if i < len(near):
                near[i] = rank.get((part[i], part[i + 1]), (NEVER, 0))
            if i:
                near[i - 1] = rank.get((part[i - 1], part[i]), (NEVER, 0))
        return part

    def _heap(self, part: list[int]) -> list[int]:
        n, rank = len(part), self.rank
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap = [(rank[p][0], i, rank[p][1], p) for i, p in enumerate(zip(part, part[1:])) if p in rank]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := rank.get(p := (part[i], part[after[i]]))):
                heapq.heappush(heap, (found[0], i, found[1], p))

        while heap:
            _, i, new, p = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or (part[i], part[j]) != p:
                continue
            part[i], alive[j] = new, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [x for x, a in zip(part, alive) if a]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which special strings are ordinary."""
        return [i for w in PRE_TOKEN.findall(text) for i in self.merge(w.encode())]

    def decode(self, ids) -> str:
        piece = self.piece
        return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")

    def split_special(self, text: str) -> list[str]:
        """Plain stretches at even places, special strings at odd ones."""
        return self._at_special.split(text) if self._at_special else [text]


class _Edge(Exception):
    """A piece starts or ends with white space: the text needs the careful split."""


class ChunkTable(dict):
    """Piece after a blank -> little-endian ids of blank and piece."""

    def __init__(self, encode: Callable[[str], list[int]], limit: int = 300_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Edge
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= SHORT:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace() and rest or not first and rest:
                raise _Edge
            return b"".join([np.array(self.encode(first), "<u4").tobytes(), *map(self.__getitem__, rest)])
        except _Edge:
            first, *rest = INNER_BLANK.split(text)
            return b"".join([np.array(self.encode(first), "<u4").tobytes(), *(self._whole(x) for x in rest)])

    def _whole(self, chunk: str) -> bytes:
        if chunk[0].isspace() or chunk[-1].isspace():  # only the last piece can
            return np.array(self.encode(" " + chunk), "<u4").tobytes()
        return self[chunk]


@lru_cache(maxsize=4)
def _loaded(path: str) -> tuple[ByteBPE, ChunkTable]:
    bpe = ByteBPE(path)
    return bpe, ChunkTable(bpe.encode_plain)


@lru_cache(maxsize=4)
def _by_library(path: str) -> tuple[ByteBPE, ChunkTable]:
    import tiktoken

    bpe = ByteBPE(path)
    core = tiktoken.Encoding("from-file", pat_str=PRE_TOKEN.pattern, mergeable_ranks=bpe.ids, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) <= COMPILED_CUT:
            return core.encode_ordinary(text)
        return [i for w in PRE_TOKEN.findall(text) for i in core._encode_single_piece(w.encode())]

    return bpe, ChunkTable(encode)


def encode_bytes(path: str, text: str, by_library: bool = False) -> bytes:
    """Little-endian unsigned 32-bit ids; special strings in the text are their own ids, as the tokenizers library has it.

    ``by_library``: pieces not met before go through a compiled encoder over the same ranks instead of the rank array.
    """
    bpe, chunks = (_by_library if by_library else _loaded)(path)
    out = []
    for k, part in enumerate(bpe.split_special(text)):
        if k % 2:
            out.append(np.array([bpe.special[part]], "<u4").tobytes())
        elif part:
            out.append(chunks.plain(part))
    return b"".join(out)


def decode_ids(path: str, ids) -> str:
    return _loaded(path)[0].decode(ids)

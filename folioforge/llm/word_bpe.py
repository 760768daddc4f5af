"""Ids of a word-end BPE file of the tokenizers library, at the speed a corpus needs.

White space is dropped by this kind of vocabulary, so a text is the list of its pre-tokens, each ended by a mark that its
last symbol carries. Characters for which normalising, lower-casing and cutting are beyond doubt (a stated set) are cut by
one pattern here, and a compiled merger over the file's own ranks takes the pre-tokens, each ended by a mark byte that such
texts cannot hold. Runs without white space that hold any other character or a special string are handed to the
tokenizers library itself. What a short piece gives is kept in a bounded table, as words repeat; a table that is full is
emptied. Both ways give the library's ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

from folioforge.llm.byte_bpe import byte_letters

#: Fixed value: how the file writes the end of a word.
WORD_END = "</w>"
#: Stands for the end of a word inside the compiled merger; texts that hold it take the other way.
MARK = b"\x01"
BLANKS = re.compile(r"[ \t-\r]+")
#: Blanks, printable ASCII, Latin letters and signs (no letter that lower-cases to two), dashes and quotes, kana, common Han:
#: composed already, and of one kind in every version of Unicode that holds them.
SAFE = r" -~\t-\r¡-įı-ž‐-‧ぁ-ゖァ-ヺ一-龥"
UNSAFE = re.compile(f"[^{SAFE}]")
TABLE = 400_000
KEPT = 64


class Pieces(dict):
    """Piece of text -> its ids as bytes."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(piece)).tobytes()
        if len(piece) <= KEPT:
            if len(self) >= TABLE:
                self.clear()
            self[piece] = ids
        return ids


def _pre_token() -> re.Pattern:
    """Letters, contractions, single digits, other signs: the file's own pattern, spelled out for the safe characters."""
    safe = re.compile(f"[{SAFE}]")
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(0x10000)):
        kind = unicodedata.category(c)[0]
        if kind in kinds and safe.match(c):
            kinds[kind].append(c)
    letters, digits = ("".join(kinds[k]) for k in "LN")
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^\s{letters}{digits}]+")


class WordBPE:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ended = token.endswith(WORD_END) and token != WORD_END
            ranks[bytes(letter[c] for c in (token[: -len(WORD_END)] if ended else token)) + (MARK if ended else b"")] = i
        library = Tokenizer.from_file(path)
        merge = tiktoken.Encoding("from-file", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = Pieces(lambda w: merge(w.encode() + MARK))
        self.runs = Pieces(lambda r: library.encode(r, add_special_tokens=False).ids)
        self.cut = _pre_token().findall

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(text.lower())))

    def doubtful(self, text: str) -> bool:
        return UNSAFE.search(text) is not None or any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not self.doubtful(text):
            return self._plain(text)
        out, plain = [], []
        for run in BLANKS.split(text):
            if self.doubtful(run):
                out += [self._plain(" ".join(plain)), self.runs[run]]
                plain = []
            else:
                plain.append(run)
        return b"".join([*out, self._plain(" ".join(plain))])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    return WordBPE(path)

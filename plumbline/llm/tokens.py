"""Token ids by a tokenizer file of the tokenizers library, for whole texts.

The ids of a chunk between white space don't depend on what is around it, for tokenizers that drop white space. So a
text is taken apart as the file's own normaliser and pre-tokenizer would, each distinct piece goes to the library's
model once, and chunks and pieces are looked up afterwards. Texts with characters outside the range for which this is
certain, and files of another make, are encoded whole by the library.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Characters that no normaliser joins or splits: printable ASCII, tab and line ends, Latin letters up to U+017F.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xbf-įı-ſ]*").fullmatch

TOKENIZER = "word_bpe_49k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


#: Chunks of more characters are made anew each time: `limit` then bounds the bytes kept too.
LONGEST = 64


class _Chunks(dict):
    """Ids by chunk, looked up or made; of two generations of `limit` chunks the older goes, what is still in use moves up."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > LONGEST:
                return out
        if len(self) >= self.limit:
            self.older = {}  # free before the copy
            self.older = self.copy()
            self.clear()
        self[key] = out
        return out


#: Chunks that an encoder keeps of a generation where nothing else is said.
LIMIT = 500_000


class Encoder:
    """Texts to little-endian uint32 ids. limit bounds the chunks kept: two times as many, of some 160 bytes each."""

    def __init__(self, path: str, limit: int = LIMIT):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            make = json.load(f)
        steps = make["pre_tokenizer"].get("pretokenizers", [])
        kinds = [s["type"] for s in (make.get("normalizer") or {}).get("normalizers", [])]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and bool(steps[0]["invert"]) and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex", True)
        if self.known:
            self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.names = _byte_names()
        self.tokens = self.tokenizer.model.tokenize
        self.bytes_of = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {}
        if self.known:
            self.marks = {c: self._piece(c) for c in map(chr, range(33, 127))}
        self.chunks = _Chunks(self._chunk, limit)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(piece) == 1 and (one := self.marks.get(piece)):
            return one
        shown = piece if piece.isascii() else "".join(map(self.names.__getitem__, piece.encode()))
        return b"".join([self.bytes_of[t.id] for t in self.tokens(shown)])

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha():  # one piece, and so is the mark after it, if it is one of these
            return self._piece(low)
        if low[-1] in ",." and (word := low[:-1]).isalpha():
            return (self.chunks.get(word) or self._piece(word)) + self._piece(low[-1])
        return b"".join(map(self._piece, self.split(low)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or "<|" in text or not _PLAIN(text):
            return self._library(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = LIMIT) -> Encoder:
    """One per Python worker."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS.clear()  # chunks of two are not kept side by side
        _ENCODERS[path, limit] = Encoder(path, limit)
    return _ENCODERS[path, limit]

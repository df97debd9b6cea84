"""Token ids of whole texts, exactly as the tokenizers library gives them, with each distinct chunk encoded once.

Both byte-pair vocabularies split a text into chunks by a pattern before any merge, so a chunk's ids do not depend
on its neighbours. Within the alphabet SAFE (Latin letters that are their own NFC form) the pattern can be run by
``re``; a text with any other character, or with the string of an added token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

import numpy as np

#: A character outside SAFE: ASCII text and the Latin letters from U+00C0 to U+00FF.
UNSAFE = re.compile("[^\t\n\r -~\u00c0-\u00ff]")
_L = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: The chunk patterns of the two vocabularies, restricted to SAFE.
#: Letters come first, being the most; no two alternatives before the last ones begin alike.
WORD_CHUNKS = re.compile(rf"[{_L}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_L}0-9]+")
BYTE_CHUNKS = re.compile(rf" ?[{_L}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
#: Distinct chunks that a worker keeps; beyond it the table starts anew. Longer chunks are not kept.
TABLE, CHUNK_CHARS = 1_200_000, 48
_ID = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte (as a Latin-1 character): printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """ids(text) -> array of unsigned 32-bit ids. kind: "word" lower-cases and drops white space, "byte" keeps all."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        #: What every added token's string begins with, as far as no letter case matters, and all of them.
        self.mark = re.match(r"[^a-zA-Z]*", os.path.commonprefix(added))[0]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.model = self.tokenizer.model
        self.lower = kind == "word"
        self.chunks = (WORD_CHUNKS if self.lower else BYTE_CHUNKS).findall
        self.letters = _byte_letters()
        self.table: dict[str, bytes] = {}

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk, by the library's merges alone: normaliser and pattern have done their part."""
        plain = chunk.isascii() and chunk.isalpha()
        found = array("I", map(_ID, self.model.tokenize(chunk if plain else chunk.encode().decode("latin-1").translate(self.letters)))).tobytes()
        if len(chunk) <= CHUNK_CHARS:
            self.table[chunk] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if UNSAFE.search(text) or self.added and self.mark in text and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(self.table) > TABLE:
            self.table.clear()
        chunks = self.chunks(text.lower() if self.lower else text)
        found = list(map(self.table.get, chunks))
        if None in found:
            found = [self.chunk(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        return np.frombuffer(b"".join(found), "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder; it outlives a task."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]

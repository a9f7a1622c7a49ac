"""Token ids of whole texts, by the tokenizers library, with a per-process store of the ids of short chunks.

Byte-level BPE first cuts a text at boundaries that depend on character classes alone, then merges within each piece. A
text cut at some of these boundaries therefore has the ids of its parts, one after another. `chunks` only cuts where the
library's own pre-tokenizer always cuts too; every chunk not seen before goes through the library, and a bounded
dictionary keeps its packed ids.
"""

from __future__ import annotations

import os
import re
from array import array

from weftline.runtime import kept

#: White space as the byte-level pre-tokenizer's \s has it (Unicode White_Space; fixed values).
_WS = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_MARKS = ".,*&$%#|"
#: In this order: letters before a mark, white space or the end; marks up to white space; anything up to white space; the rest.
_CHUNK = re.compile(f"[{_WS}]*[{_LETTERS}]+(?=[{_WS}{_MARKS}]|\\Z)|[{_MARKS}]+(?=[{_WS}]|\\Z)|[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Chunks kept in a process (some 250 bytes each) and the longest one that is kept.
STORE_CHUNKS, STORE_CHARS = 500_000, 40

chunks = _CHUNK.findall


_WORD = re.compile(f" ?[{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself where printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Store(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers; encodes what is missing."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens have ids of their own; a text that holds one goes to the library whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):  # one piece for the merges: straight to the library's model
            spelt = chunk.encode().decode("latin-1").translate(self.letters)
            packed = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
        elif chunk[0] == "\n" and _WORD.fullmatch(chunk, 1):
            return self["\n"] + self[chunk[1:]] if chunk[1] != " " else self.encoded(chunk)
        else:
            packed = self.encoded(chunk)
        if len(self) < STORE_CHUNKS and len(chunk) <= STORE_CHARS:
            self[chunk] = packed
        return packed

    def encoded(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text, packed. Null and empty texts have none."""
        if not text:
            return b""
        if self.added and self.added.search(text):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, chunks(text)))


def store(path: str) -> _Store:
    """The process's store for a tokenizer file; Python workers that are used again keep it between tasks."""
    return kept(("tokens", path), lambda: _Store(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

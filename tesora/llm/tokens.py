"""Token ids of whole texts by a public tokenizer, one encoding per distinct chunk and worker.

Both vocabularies cut a text into pieces before merging, and a blank in front of
a visible character, or a line end behind one, always starts a new piece. So a
text is cut there, each distinct chunk is encoded once by the tokenizers library,
and the ids of a text are joined from that table as bytes. A word is looked up
in the same table whatever sign or line end follows it. The table is emptied when
it is full, so its memory is bounded. A text that spells a special token is
encoded whole, as the library does by default.
"""

from __future__ import annotations

import gc
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer


#: Distinct chunks a worker remembers (byte-level, word-level), pieces of them, and the longest that it does.
REMEMBERED = {True: 1_000_000, False: 400_000}
PIECES = 100_000
LONGEST = 64


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies spell them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: The stand-ins of all bytes, in their order.
_SPELL = "".join(c for _, c in sorted(_byte_characters().items()))
#: Pieces that both vocabularies cut in the same plain way: runs of Latin letters, of digits (single ones, word-level)
#: and of ASCII signs but the apostrophe, and lone line ends.
_PIECES = {
    True: re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\\[-`{-~]+|\n"),
    False: re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+|\n"),
}
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Such letters and ASCII signs (but the apostrophe) behind them, which are a piece of their own.
_SIGNED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]+)")
#: Where any text may be cut: at a blank in front of a visible character, and between such a one and a line end.
_CUT = re.compile(r" (?=\S)|(?<=\S)(?=\n)")


class _Loose(Exception):
    """Blanks stand beside blanks or line ends, so that a text can't be cut at every one."""


class _Table(dict[str, bytes]):
    """Packed ids of chunks; a new chunk is encoded and, unless it is long, kept. A full table is emptied."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        self.encode, self.most = encode, most

    def __missing__(self, part: str) -> bytes:
        found = self.encode(part)
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[part] = found
        return found


class Encoder:
    """Encodes texts with ``leading`` blanks as part of a word (byte-level) or without (word-level)."""

    def __init__(self, path: str, leading: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.leading, self.pattern = self.tokenizer.model, leading, _PIECES[leading]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.table = _Table(self._chunk, REMEMBERED[leading])
        self.pieces: dict[str, bytes] = {}

    @property
    def count(self) -> int:
        """Chunks remembered."""
        return len(self.table)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _library(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, piece: str) -> bytes:
        """Ids of one piece by the library's model, which wants its bytes spelled."""
        spelled, _ = charmap_decode((piece if self.leading else piece.lower()).encode(), "strict", _SPELL)
        return self._packed([t.id for t in self.model.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            known = b"" if piece == "\n" and not self.leading else self._plain(piece)
            if len(piece) <= LONGEST:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _ids(self, chunk: str) -> bytes:
        """Ids of one chunk; plain pieces skip the library's text handling and go to its model."""
        found = self.pattern.findall(chunk)
        if sum(map(len, found)) != len(chunk) or "\n\n" in chunk or (self.leading and chunk.find(" ", 1) > 0):
            return self._library(chunk)
        return b"".join(map(self._piece, found))

    def _chunk(self, part: str) -> bytes:
        """Ids of a chunk cut off at a blank, which it lacks, or in front of a line end, which it has."""
        if part.isalpha() and part.isascii():
            return self._packed([t.id for t in self.model.tokenize(_SPELL[32] + part if self.leading else part.lower())])
        signed = _SIGNED.fullmatch(part)
        if signed:
            return self.table[signed[1]] + self._piece(signed[2])
        if self.leading and (not part or part[-1].isspace() or (part[0].isspace() and part[0] != "\n")):
            raise _Loose
        lead = " " if self.leading and part[0] != "\n" else ""
        return self._plain(lead + part) if _LETTERS.fullmatch(part) else self._ids(lead + part)

    def _cut(self, text: str) -> bytes:
        """Ids of a text with any blanks; a chunk that ends in some is not kept."""
        first, *rest = _CUT.split(text)
        found = [self._ids(first)]
        for part in rest:
            found.append(self._ids(part if part[0] == "\n" else " " + part) if part[-1].isspace() else self.table[part])
        return b"".join(found)

    def _text(self, text: str) -> bytes:
        if not self.leading:
            return b"".join(map(self.table.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            found = b"".join(map(self.table.__getitem__, rest))
        except _Loose:
            return self._cut(text)
        return self._ids(first) + found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null counts as empty."""
        if not text:
            return np.empty(0, self.kind)
        whole = any(token in text for token in self.special)
        return np.frombuffer(self._library(text) if whole else self._text(text), self.kind)


@lru_cache(maxsize=4)
def encoder(path: str, leading: bool) -> Encoder:
    """One per worker process. Its tables hold no cycles, so they are kept from the cycle collector's rounds."""
    found = Encoder(path, leading)
    gc.freeze()
    gc.set_threshold(200_000, 50, 1000)
    return found

"""Terms of whole texts as numpy arrays: spans in the bytes of an Arrow batch, packed words, radix order.

A term is a run of the bytes a class allows; all bytes of code points beyond
ASCII belong to it, so bytes and code points give the same runs. A-Z become a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on, unless one text is longer.
STEP = 1 << 22
#: Bytes of zeros behind the text, so that a word can be read at any place.
_TAIL = 16


def term_bytes(digits: bool) -> np.ndarray:
    """Which bytes belong to a term: letters, all bytes beyond ASCII and, if asked, digits."""
    found = np.zeros(256, bool)
    found[128:] = True
    found[ord("a") : ord("z") + 1] = found[ord("A") : ord("Z") + 1] = True
    if digits:
        found[ord("0") : ord("9") + 1] = True
    return found


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def steps(column: pa.Array, size: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes with a tail of zeros, offsets of the rows) of pieces of a column of texts.

    Null is an empty text. A piece holds about ``size`` bytes, one text at least.
    """
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        own = data[offsets[row] : offsets[end]]
        out = np.zeros(len(own) + _TAIL, np.uint8)
        out[: len(own)] = _LOWER[own]
        yield row, out, offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of every term; a term never crosses two rows."""
    inside = allowed[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    ends = np.flatnonzero(before & (first | ~inside))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends - starts, row


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: int = 0) -> np.ndarray:
    """Bytes 8 * word to 8 * word + 7 of each term as one number, zeros behind its end: numbers sort as the bytes do."""
    at_any = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    taken = at_any[starts + 8 * word].astype(np.uint64)
    spare = (8 * np.clip(8 - (lengths - 8 * word), 0, 7)).astype(np.uint64)
    return (taken >> spare) << spare


def radix_order(*words: np.ndarray) -> np.ndarray:
    """Stable order by the first word, then the next ones; numpy sorts 16-bit digits by counting."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        spread = int(np.bitwise_or.reduce(word ^ word[:1])) if len(word) else 0
        for shift in range(0, 64, 16):
            if spread >> shift & 0xFFFF:
                digit = (word[order] >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit, kind="stable")]
    return order


def unpacked(words: list[np.ndarray]) -> list[bytes]:
    """The terms behind packed words."""
    rows = np.stack(words, axis=1).astype(">u8")
    return rows.view(f"S{8 * len(words)}").ravel().tolist()


def long_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions among the given terms, their bytes as one sortable array) for each length."""
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield at, data[starts[at][:, None] + np.arange(length)].view(f"S{length}").ravel()

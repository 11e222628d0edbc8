r"""Vectorised text handling for Arrow batches: bytes in, word and shingle hashes out.

Words are ``[^\x20\x09-\x0D]+`` of the UTF-8 bytes with A-Z in lower case. Texts are
taken in pieces of about ``PIECE`` bytes (a longer text is a piece of its own), so the
memory for intermediate arrays follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20


def _table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CODE = _table()
#: Bytes that are no ASCII letters or digits, nor part of characters beyond ASCII.
PUNCTUATION = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127) for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype="u8")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def release() -> None:
    """Give freed memory back at the end of a task: the worker process stays, beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8", len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, "i8")
    return (np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")), at


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each piece of a column."""
    data, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its length, offsets of each row's words in these)."""
    solid = ~breaks[data]
    edge = np.ones(len(data) + 1, bool)  # a row starts here, or the byte before is space
    edge[1:] = False
    edge[1:-1] = ~solid[:-1]
    edge[at] = True
    start = np.flatnonzero(solid & edge[:-1])
    stop = np.ones(len(data), bool)
    stop[:-1] = ~solid[1:]
    inner = at[1:]
    stop[inner[inner > 0] - 1] = True
    end = np.flatnonzero(solid & stop) + 1
    return start, end - start, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as lower case."""
    if not len(start):
        return np.zeros(0, "u8")
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    offset = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, "u8"))
    value = _CODE[_LOWER[data[np.repeat(start, length) + offset]]] * power[offset]
    return mix(np.add.reduceat(value, first) + length.astype("u8"))


def shingle_hashes(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of a row's ``n``-word shingles; of the whole sequence if it has fewer words."""
    if len(h) < n:
        if not len(h):
            return h
        return mix((h * _STEP[: len(h)]).sum(dtype="u8", keepdims=True) + np.uint64(len(h)))
    s = np.zeros(len(h) - n + 1, "u8")
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * _STEP[k % len(_STEP)] * np.uint64(2 * (k // len(_STEP)) + 1)
    return mix(s + np.uint64(n))


def lower_words(text: str) -> list[bytes]:
    """The same words as byte strings."""
    return text.encode().lower().split()

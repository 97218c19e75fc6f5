"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Texts come as one buffer of UTF-8 bytes with row offsets (the layout of an Arrow string column). A word's hash is a
polynomial over a random number per byte; running sums over the buffer give it for all words without a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = np.arange(256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between bare words: all ASCII characters other than letters and digits.
_BARE = np.ones(256, dtype=bool)
_BARE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
with np.errstate(over="ignore"):
    _CODE = mix(_BYTES * _BASE + _U(1))
    #: Odd multipliers for the words of a shingle.
    _PLACE = mix((np.arange(64, dtype=np.uint64) + _U(7)) * _BASE) | _U(1)
_CODE_LOWER = _CODE[_LOWER]
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        base = 0xD6E8FEB86659FD93
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for k, b in enumerate((base, pow(base, -1, 1 << 64))):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of ``n_rows`` texts: byte ranges in ``buf``, hashes, and for each row the range of its words."""

    buf: np.ndarray
    offsets: np.ndarray  # bytes: row i is buf[offsets[i]:offsets[i + 1]]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # words: row i has words first[i]:first[i + 1]

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = True, bare: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower``: A-Z count as a-z; ``bare``: words without ASCII
    punctuation, which parts them like blanks."""
    buf, offsets = text_buffer(texts)
    n = len(buf)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(buf, offsets, none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64))
    word = ~(_BARE if bare else _BLANK)[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[buf] * up[:n], out=sums[1:], dtype=np.uint64)
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _BASE)
    return Words(buf, offsets, start, end, hashes, np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text or buffer; shorter texts give none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = np.full(n, _U(size) * _BASE, dtype=np.uint64)
        for j in range(size):
            x += hashes[j:j + n] * _PLACE[j]
    return mix(x)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes. A text with fewer than ``size`` words has its whole word
    sequence as one shingle, a text without words none."""
    runs = shingles(w.hash, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            x = np.sort(runs[a:b - size + 1])
            keep = np.empty(len(x), dtype=bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        else:
            out.append(shingles(w.hash[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64))
    return out

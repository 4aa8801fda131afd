"""Arrow batches of texts as byte arrays, and vectorised hashes of their words.

The helpers run inside Spark tasks on one block of text at a time; blocks have a fixed size, so
memory stays bounded whatever the batch or the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A new identifier for the pair of identifiers (a, b); wraps modulo 2^64."""
    x = (a ^ (a >> U64(31))) * _K1
    x += b
    x ^= x >> U64(29)
    x *= _K2
    return x


def final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * _K3
    return x ^ (x >> U64(29))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and where each row starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def row_blocks(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``size`` bytes; a longer row is a block of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_WORD_TABLE = final(np.arange(1, 257, dtype=U64) * _K1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = U64(0xD1342543DE82EF95)


def _inverse(base: int) -> int:
    x = base
    for _ in range(6):
        x = x * (2 - base * x) % 2**64
    return x


_INVERSE = U64(_inverse(int(_BASE)))


def _powers(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_PIECE = 1 << 22


def _word_pieces(data: np.ndarray, lo: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_PIECE`` bytes of a long text, cut where a word ends."""
    while lo < end:
        hi = min(lo + _PIECE, end)
        while hi < end and not _SPACE[data[hi]]:
            step = np.flatnonzero(_SPACE[data[hi : min(hi + _PIECE, end)]])
            hi = hi + int(step[0]) if len(step) else min(hi + _PIECE, end)
        yield lo, hi
        lo = hi


class WordHasher:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lowered, each as a 64-bit hash."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.empty(0, U64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of a block, and for each row where its words start."""
        if len(offsets) == 2 and offsets[1] - offsets[0] > _PIECE:
            parts = [self._words(data, np.array(p))[0] for p in _word_pieces(data, int(offsets[0]), int(offsets[1]))]
            out = np.concatenate(parts)
            return out, np.array([0, len(out)])
        return self._words(data, offsets)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        at = offsets[:-1] - offsets[0] + np.arange(1, n + 1)
        total = int(offsets[-1] - offsets[0])
        text = np.full(total + n + 1, 32, np.uint8)
        if n == 1:
            text[1 : 1 + total] = data[offsets[0] : offsets[1]]
        else:
            text[np.repeat(at - (offsets[:-1] - offsets[0]), lengths) + np.arange(total)] = data[offsets[0] : offsets[-1]]
        text = _LOWER[text]
        word = ~_SPACE[text]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        if len(text) > len(self.powers):
            self.powers, self.inverses = (_powers(x, len(text) * 5 // 4) for x in (_BASE, _INVERSE))
        sums = np.empty(len(text) + 1, U64)
        sums[0] = 0
        np.cumsum(_WORD_TABLE[text] * self.powers[: len(text)], out=sums[1:])
        hashes = final((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U64))
        return hashes, np.searchsorted(starts, np.append(at, len(text)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a shorter, non-empty text is one run as a whole."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1] * _K3 + U64(k)
    for i in range(1, k):
        out = mix(out, words[i : len(words) - k + 1 + i])
    return final(out)

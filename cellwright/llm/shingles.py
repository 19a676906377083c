"""Words and word shingles of Arrow text columns as 64-bit hashes, with numpy.

A batch is taken in blocks of about a quarter of a megabyte of text, so memory does not follow the
batch; only a single longer text makes a larger block.  Words are runs of anything but space and
0x09-0x0D, A-Z lower-cased; no word crosses a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
#: Powers for longer texts are made anew each time.
MOST_POWERS = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, _U), np.zeros(0, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base modulo 2**64, and those of its inverse.  One table is kept, of
    the greatest size so far."""
    global _powers
    size = 1 << max(16, int(n - 1).bit_length())
    if size > MOST_POWERS:
        return _make_powers(n)
    if size > len(_powers[0]):
        _powers = _make_powers(size)
    a, b = _powers
    return a[:n], b[:n]


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        p = np.full(n, base, dtype=_U)
        p[0] = 1
        return np.multiply.accumulate(p)
    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a non-null string column."""
    if texts.type == pa.large_string():
        offset_type = np.int64
    else:
        texts, offset_type = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=offset_type)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the first word of every text (one more at the end)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    low = np.frombuffer(data.tobytes().translate(_LOWER), dtype=np.uint8)
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(low)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    up, down = powers(len(low))
    total = np.zeros(len(low) + 1, dtype=_U)
    np.cumsum(np.where(inside, low, 0).astype(_U) * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + mix((ends - starts).astype(_U))), np.searchsorted(starts, offsets)


_ROUND = [_U((pow(_BASE, 2 * i + 3, 1 << 64)) | 1) for i in range(64)]


def shingle_at(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position that has k words after it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    s = words[:n] * _ROUND[0]
    for i in range(1, k):
        s = s + mix(words[i:i + n] + _U(i)) * _ROUND[i]
    return mix(s)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole short word sequence, apart from all shingles of full length."""
    h = len(words) + 1
    for w in words.tolist():
        h = (h * _BASE + w) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h ^ 0x5EED], dtype=_U))[0])


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes).  A text with fewer than k words has its whole
    word sequence as its only shingle, one without words has none."""
    for a, b, data, offsets in blocks(texts):
        words, first = word_hashes(data, offsets)
        every = shingle_at(words, k)
        for row in range(a, b):
            s, e = int(first[row - a]), int(first[row - a + 1])
            if e - s >= k:
                yield row, np.unique(every[s:e - k + 1])
            elif e > s:
                yield row, np.array([sequence_hash(words[s:e])], dtype=_U)
            else:
                yield row, np.zeros(0, _U)

"""Words and hashes of Arrow text columns, computed over the bytes of many texts at once.

Texts are UTF-8; all separators used here are ASCII, so bytes can be classified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = np.ones(256, bool)
WORD[list(SPACES)] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts per piece: a document's number in its piece must fit the bits left beside a 52-bit hash.
PIECE_TEXTS = 4096
PIECE_BYTES = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not len(column):
        return buf[:0], np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about `limit` bytes each or one longer text."""
    buf, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + PIECE_TEXTS, n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the range of its words."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = is_word[buf]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    begins[cuts] = inside[cuts + 1]
    stops[cuts - 1] = inside[cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H[i]: polynomial hash of the first i bytes."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, end), equal for equal strings wherever they stand."""
    inverse = powers(len(prefix))[1]
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(buf), starts, ends)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (runs may cross texts; the caller drops those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0xD1342543DE82EF95) + words[k : k + m])
    return mix(h ^ np.uint64(n))


def shingle_sets(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word runs of each text as sorted 52-bit hashes, and the range of each text.

    A text with fewer than n words has its whole sequence as its one run; one without words has none.
    """
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = run_hashes(words, n)
    place = np.arange(len(runs))
    fits = place + n <= bounds[owner[: len(runs)] + 1]
    keys, whose = [runs[fits]], [owner[: len(runs)][fits]]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            keys.append(run_hashes(words, size)[bounds[short]])
            whose.append(short)
    packed = (np.concatenate(whose).astype(np.uint64) << np.uint64(52)) | (np.concatenate(keys) >> np.uint64(12))
    packed.sort()
    if len(packed):
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    ranges = np.searchsorted(packed, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(52))
    if len(counts) == PIECE_TEXTS:  # 4096 << 52 wraps to 0
        ranges[-1] = len(packed)
    return packed & np.uint64((1 << 52) - 1), ranges


def binary_rows(values: np.ndarray, ranges: np.ndarray) -> pa.Array:
    """One binary value per range of a numeric array."""
    offsets = (ranges * values.itemsize).astype(np.int64)
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(ranges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

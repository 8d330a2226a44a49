"""Vectorised text work inside tasks: Arrow batches as byte buffers, words, rolling fingerprints, minimizers.

Everything here sees one slice of a partition at a time (``slice_bytes`` of text, or one
text that is longer than that), so memory does not depend on the size of a partition.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
NOT_SPACE = np.array([b not in SPACES for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Slice:
    """Some rows of a batch: their other columns, and their texts as one byte buffer."""

    rows: pa.RecordBatch
    null: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def ids(self, name: str) -> np.ndarray:
        """An integer column; null becomes the largest long, so it comes after every id."""
        return long_column(self.rows, name)


def long_column(rows: pa.RecordBatch, name: str) -> np.ndarray:
    column = rows.column(name).cast(pa.int64())
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches into slices of whole rows; a null text is an empty one and marked."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_string())
        null = column.is_null().to_numpy(zero_copy_only=False)
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(offsets, offsets[start] + slice_bytes, "right")) - 1
            stop = min(max(stop, start + 1), len(column))
            part = offsets[start : stop + 1]
            yield Slice(batch.slice(start, stop - start), null[start:stop], data[part[0] : part[-1]], part - part[0])
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64 bits (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER) + np.uint64(seed))


#: fingerprints are polynomials modulo this prime. Modulo a power of two every odd multiplier gives equal values to sequences that
#: anybody can write down (two symbols in the order of the Thue-Morse sequence and its complement); a prime has no such pair
_PRIME = np.uint64((1 << 61) - 1)
_BASE = _MULTIPLIER % ((1 << 61) - 1)
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << k) - 1) for k in (29, 30, 31, 32))
_30, _31, _61 = (np.uint64(k) for k in (30, 31, 61))
_PIECE = 1 << 14  # what is worked on at once stays in the processor's cache


def _folded(x: np.ndarray) -> np.ndarray:
    """Equal modulo the prime and at most 7 above it, for any 64 bits."""
    return (x & _PRIME) + (x >> _61)


def _least(x: np.ndarray) -> np.ndarray:
    """The value below the prime of something folded."""
    return np.minimum(x, x - _PRIME)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, folded, for folded values, by halves of 30 and 31 bits."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), _PIECE):
        x, y = a[i : i + _PIECE], b[i : i + _PIECE] if b.ndim else b
        x1, x0, y1, y0 = x >> _31, x & _LOW31, y >> _31, y & _LOW31
        middle = x1 * y0
        middle += x0 * y1
        x1 *= y1  # stands for 2**62, which is 2; the upper part of the middle stands for 2**61, which is 1
        x1 += x1
        x1 += middle >> _30
        middle &= _LOW30
        middle <<= _31
        x1 += middle
        x0 *= y0
        x1 += x0
        out[i : i + _PIECE] = _folded(x1)
    return out


class _Powers:
    """Powers of a number modulo the prime; a process keeps as many as its longest sequence needed."""

    def __init__(self, base: int):
        self.base = base
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), int(_PRIME)))
            self.known = np.concatenate((self.known, _least(_product(self.known, np.asarray(step)))))
        return self.known[:n]


_POWERS, _BACK = _Powers(_BASE), _Powers(pow(_BASE, -1, (1 << 61) - 1))


class Rolling:
    """Fingerprints of any range of a sequence of 64-bit values, by prefix sums modulo a prime."""

    def __init__(self, values: np.ndarray):
        terms = _product(_folded(values), _POWERS.upto(len(values)))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        before = np.uint64(0)
        for i in range(0, len(values), _PIECE):
            part = terms[i : i + _PIECE]
            # the upper half counts 2**32 each: what passes 2**61 comes back as ones
            upper, lower = np.cumsum(part >> np.uint64(32)), np.cumsum(part & _LOW32)
            lower += upper >> np.uint64(29)
            upper &= _LOW29
            upper <<= np.uint64(32)
            upper += lower
            upper += before
            self.sums[i + 1 : i + 1 + len(part)] = part = _folded(upper)
            before = part[-1]

    @staticmethod
    def _print(low: np.ndarray, high: np.ndarray, back: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), np.uint64)
        for i in range(0, len(low), _PIECE):
            at = slice(i, i + _PIECE)
            apart = high[at] + (_PRIME + _PRIME) - low[at]
            raw = _least(_product(_folded(apart), back[at]))
            out[at] = mix(raw + (length[at] if length.ndim else length) * np.uint64(0xD6E8FEB86659FD93))
        return out

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        back = _BACK.upto(len(self.sums))[start]
        return self._print(self.sums[start], self.sums[stop], back, (stop - start).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """Of every range of one width."""
        back = _BACK.upto(len(self.sums) - width)
        return self._print(self.sums[:-width], self.sums[width:], back, np.array(width, np.uint64))


def byte_values(data: np.ndarray, seed: int = 1) -> np.ndarray:
    return _table(seed)[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more at the end)."""
    inside = in_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][filled], offsets[1:][filled] - 1
    first[head] = inside[head]
    last[tail] = inside[tail]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return Rolling(byte_values(data, seed)).of(starts, ends)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost smallest value of each window of ``width`` lies; compares the upper 40 bits."""
    at = np.arange(len(values), dtype=np.uint64)
    key = (values & ~np.uint64(0xFFFFFF)) | (at & np.uint64(0xFFFFFF))
    if len(values) > 1 << 24:  # one very long text: positions need all bits
        return _wide_argmin(values, width)
    reach = 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        step = width - reach
        key = np.minimum(key[:-step], key[step:])
    return (key & np.uint64(0xFFFFFF)).astype(np.int64)


def _wide_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The same in overlapping pieces, each short enough for 24-bit positions."""
    piece = (1 << 24) - width
    parts = [sliding_argmin(values[i : i + piece + width - 1], width) + i for i in range(0, len(values) - width + 1, piece)]
    return np.concatenate(parts)


def ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All integers of all ranges, one after another."""
    lengths = stops - starts
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def covered(length: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of ``length`` elements lie in one of the ranges."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

"""Vectorised work on the UTF-8 bytes of a batch of texts.

Everything here takes a bounded slice of rows as one byte array with row offsets; a slice holds
about a megabyte of text, or a single text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240601)
_BYTE_VALUE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_LANE = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class RangeHash:
    """64-bit hashes of any byte ranges of one array, each in constant time after one pass."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        self.back = _power(_BASE_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes outside ``\\x20\\x09-\\x0D``; no word crosses a row."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] |= inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def run_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each word on, whatever rows they lie in, in constant time for each."""
    sums = np.zeros(len(word_hash) + 1, np.uint64)
    np.cumsum(word_hash * _power(_BASE, len(word_hash)), out=sums[1:])
    at = max(0, len(word_hash) - n + 1)
    return mix((sums[n:] - sums[:at]) * _power(_BASE_INVERSE, at))


def shingles(word_hash: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words of a row; a shorter row gives its whole sequence."""
    hashes, rows = [], []
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(first, len(row)))
    for w in range(1, width + 1):
        if w == width:
            at = np.arange(max(0, len(row) - width + 1))
            at = at[row[at] == row[at + width - 1]]
        else:
            at = first[count == w]
        if len(at):
            total = np.full(len(at), _LANE[63 - w], np.uint64)
            for j in range(w):
                total += mix(word_hash[at + j] + _LANE[j]) * _LANE[j + 20]
            hashes.append(mix(total))
            rows.append(row[at])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def by_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """An order by row, then hash: one sort of the row's bits before the hash's high ones, which nearly always tell."""
    bits = np.uint64(int(rows.max(initial=0)).bit_length())
    if not bits:
        return np.argsort(hashes)
    key = (rows.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(key)
    key, hashes = key[order], hashes[order]
    if np.any((key[1:] == key[:-1]) & (hashes[1:] < hashes[:-1])):
        return order[np.lexsort((hashes, key))]
    return order


def distinct_sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each of ``n`` rows."""
    order = by_row(hashes, rows)
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    return np.split(hashes, np.searchsorted(rows, np.arange(1, n)))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets): the distinct word shingles of each text, A-Z lower-cased."""
    for row, end, data, offsets in slices(texts):
        data = lower_ascii(data)
        start, stop, of = words(data, offsets)
        word_hash = RangeHash(data).of(start, stop)
        yield row, distinct_sets(*shingles(word_hash, of, width), end - row)

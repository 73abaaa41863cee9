"""Vectorised text primitives for use inside Arrow tasks.

Everything works on one bounded chunk of concatenated UTF-8 texts at a time, so
the memory of a task follows the chunk and the longest single text, never the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: A second, independent multiplier.
BASE2 = 0xC2B2AE3D27D4EB4F | 1
BASE2_INV = pow(BASE2, -1, 1 << 64)
#: UTF-8 bytes of texts worked on together.
CHUNK_BYTES = 1 << 20
#: Position bits under the hash bits when a minimum is searched with its place.
POS_BITS = 28

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for later calls of the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """A 64-bit random-looking symbol for each byte."""
    return _BYTE_TABLE[data]


class Poly:
    """Polynomial hashes of any stretch of a symbol sequence, in constant time each."""

    def __init__(self, symbols: np.ndarray, base: int = BASE, inverse: int = BASE_INV):
        n = len(symbols)
        self.inv = powers(inverse, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(base, n), out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of [start, end)."""
        return mix((self.prefix[end] - self.prefix[start]) * self.inv[start])

    def every(self, k: int) -> np.ndarray:
        """Mixed hashes of all k-long stretches."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by running minima within blocks."""
    n = len(keys)
    if n < width:
        return keys[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def super_windows(poly: Poly, ends: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Group the `length`-long windows of concatenated documents by their minimizer.

    `ends` holds, for each symbol, where its document ends. The minimizer of a
    window is its leftmost k-gram of least hash, so equal windows have equal
    minimizers at equal offsets, wherever they stand. Consecutive windows of one
    document with one minimizer form a row: `first` and `last` window start,
    `anchor` (minimizer start), `fp` (hash of the k-gram), `sx` and `sx2` (two
    independent parts of a hash of the whole stretch the windows span).
    """
    n = len(ends)
    if n >> POS_BITS:
        raise ValueError(f"a text of 2**{POS_BITS} symbols or more has no room for their places")
    empty = {c: np.zeros(0, np.int64) for c in ("first", "last", "anchor")}
    if n < length:
        return empty | {c: np.zeros(0, np.uint64) for c in ("fp", "sx")}
    grams = poly.every(k)
    low = np.uint64((1 << POS_BITS) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(keys, length - k + 1)
    starts = np.flatnonzero(np.arange(length, n + 1) <= ends[: n - length + 1])
    if not len(starts):
        return empty | {c: np.zeros(0, np.uint64) for c in ("fp", "sx")}
    at = (best[starts] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    a, b = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
    first, last, anchor = starts[a], starts[b], at[a]
    shape = (anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    sx = mix(poly.of(first, last + length) ^ mix(shape))
    return {"first": first, "last": last, "anchor": anchor, "fp": grams[anchor], "sx": sx}


class Chunk:
    """Some documents of an Arrow batch: `lo:hi` are their rows, `data` their bytes one after another."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def ends(self) -> np.ndarray:
        """For each byte, where its document ends."""
        return np.repeat(self.offsets[1:], np.diff(self.offsets))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Texts of a batch (null: empty) in chunks of about `most` bytes; a longer text is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a chunk, `[^\\x20\\x09-\\x0D]+` or runs of the bytes that `letters` marks: byte ranges, 64-bit hashes, and where each document's words begin."""

    def __init__(self, chunk: Chunk, lower: bool = False, letters: np.ndarray | None = None):
        data = _LOWER[chunk.data] if lower else chunk.data
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[data] if letters is None else letters[data]
        # A document's first byte begins a word even if the document before ends in one.
        edges = np.unique(chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(data))])
        step = np.diff(inside)
        begin = step[:-1] == 1
        finish = step == -1
        both = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
        begin[both] = True
        finish[both] = True
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish)
        self.offsets = np.searchsorted(self.start, chunk.offsets)
        self.poly = Poly(byte_symbols(data), BASE2, BASE2_INV)
        self.hash = self.poly.of(self.start, self.end)

    def ends(self) -> np.ndarray:
        """For each word, the word position at which its document ends."""
        return np.repeat(self.offsets[1:], np.diff(self.offsets))


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)

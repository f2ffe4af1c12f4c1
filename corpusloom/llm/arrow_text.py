"""Whole Arrow batches of texts as byte arrays: words, hashes and per-document sums without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes worked on at a time, so that temporaries stay some MB whatever the batch holds.
PIECE_BYTES = 1 << 18

_U64 = np.uint64


def is_space() -> np.ndarray:
    """Per byte: one of the six ASCII white-space characters."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64; wraps on purpose."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    """The same n pseudo-random words everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15) + mix(np.array([seed], dtype=np.uint64)))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)[texts.offset:].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes each; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the slices between offsets, along the first axis; an empty slice sums to zero."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


class Words:
    """Words (runs of other than ASCII white space) of documents laid end to end, with a 64-bit hash of each."""

    def __init__(self, seed: int, lower: bool = False, piece: int = PIECE_BYTES):
        self.space, self.piece = is_space(), piece
        self.table = random_u64(256, seed)
        if lower:
            self.table[ord("A"):ord("Z") + 1] = self.table[ord("a"):ord("z") + 1]
        # powers of an odd multiplier and their inverses, so that any slice of one prefix sum is a polynomial hash
        base = 0x9E3779B97F4A7C15
        self.base, self.inverse = _U64(base), _U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(size, self.base))
                self.down = np.cumprod(np.full(size, self.inverse))
        return self.up, self.down

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte, hash, offsets of each document's words)."""
        n = len(data)
        solid = ~self.space[data]
        starts, ends = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            filled = offsets[1:] > offsets[:-1]
            first[offsets[:-1][filled]] = True
            last[offsets[1:][filled] - 1] = True
            starts[1:] = solid[1:] & ~solid[:-1]
            starts |= first & solid
            ends[:-1] = solid[:-1] & ~solid[1:]
            ends |= last & solid
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        hashes = np.empty(len(s), np.uint64)
        i = 0
        while i < len(s):  # pieces that end between words
            j = max(i + 1, int(np.searchsorted(e, s[i] + self.piece, side="right")))
            lo, hi = s[i], e[j - 1]
            up, down = self._powers(int(hi - lo))
            with np.errstate(over="ignore"):
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(self.table[data[lo:hi]] * up[:hi - lo], out=total[1:])
                hashes[i:j] = (total[e[i:j] - lo] - total[s[i:j] - lo]) * down[s[i:j] - lo]
            i = j
        with np.errstate(over="ignore"):
            hashes = mix(hashes + (e - s).astype(np.uint64))
        return s, e, hashes, np.searchsorted(s, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets) of the `width`-word shingles of each document; fewer words are one shingle, none are none."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    with np.errstate(over="ignore"):
        total = len(hashes)
        rolled = np.zeros(total, np.uint64)
        for k in range(width):
            if total > k:
                rolled[:total - k] = mix(rolled[:total - k] + hashes[k:] * _U64(2 * k + 1))
        result = np.empty(out[-1], np.uint64)
        where = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], count)
        result[:] = rolled[where]
        for d in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence
            h = np.zeros(1, np.uint64)
            for k in range(n[d]):
                h = mix(h + hashes[offsets[d] + k] * _U64(2 * k + 1))
            result[out[d]] = h[0]
    return result, out


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document: bytes that don't continue a character."""
    return sums(((data & 0xC0) != 0x80).astype(np.int64), offsets)

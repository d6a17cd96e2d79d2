"""Words, shingles and MinHash of whole texts, vectorised over Arrow string arrays.

A word is a run of bytes outside [\\x20\\x09-\\x0D] of the UTF-8 text; A-Z are lowered first. A word's hash sums a
random 64-bit value per byte times an odd power of its place, then mixes; a shingle's hash mixes the words' hashes
times one odd factor per place and the number of words. Two different shingles share a hash with probability
about 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(0x77616C6B)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_POWER = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of whole texts of about most_bytes; null is empty."""
    text = text.fill_null("").cast(pa.large_string()) if len(text) else text.cast(pa.large_string())
    _, offsets, values = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word."""
    live = ~_IS_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = live.copy()
    first[1:] &= ~live[:-1] | edge[1:-1]
    last = live.copy()
    last[:-1] &= ~live[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    power = np.cumprod(np.full(int(size.max()) + 1, _POWER, np.uint64))
    base = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(base, size)
    part = _BYTE[data[place + np.repeat(start, size)]]
    part *= power[place]
    return mix64(np.add.reduceat(part, base) + size.astype(np.uint64))


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k words in a row, and of the whole of a text with fewer words; with repeats."""
    count = np.bincount(row, minlength=rows)
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _FACTORS[j] if len(total) else total
    whole = row[: len(total)] == row[k - 1 :] if len(total) else np.zeros(0, bool)
    out, at = [mix64(total[whole] + np.uint64(k))], [row[: len(total)][whole]]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(row, short)
        for n in range(1, k):
            these = count[short] == n
            s = np.zeros(int(these.sum()), np.uint64)
            for j in range(n):
                s += h[first[these] + j] * _FACTORS[j]
            out.append(mix64(s + np.uint64(n)))
            at.append(short[these])
    return np.concatenate(out), np.concatenate(at)


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text, in order; empty for texts without words."""
    for at, data, off in slices(text):
        rows = len(off) - 1
        start, end, row = words(data, off)
        sh, r = shingles(word_hashes(data, start, end), row, rows, k)
        order = np.argsort(r, kind="stable")
        sh, n = sh[order], np.bincount(r, minlength=rows)
        stop = np.cumsum(n)
        for i in range(rows):
            yield at + i, np.unique(sh[stop[i] - n[i] : stop[i]])


class MinHash:
    """size hash functions x -> (x ^ seed) * odd mod 2^32 over the upper halves of shingle hashes."""

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        self.xor = rng.integers(0, 2**32, size, dtype=np.uint32)
        self.odd = rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signatures(self, sets: list[np.ndarray], block: int = 1 << 17) -> np.ndarray:
        """One row of size uint32 for each set; no set may be empty."""
        out = np.empty((len(sets), self.size), np.uint32)
        at = 0
        while at < len(sets):
            end, total = at, 0
            while end < len(sets) and (end == at or total + len(sets[end]) <= block):
                total += len(sets[end])
                end += 1
            x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
            base = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
            buf = np.empty_like(x)
            for j in range(self.size):
                np.bitwise_xor(x, self.xor[j], out=buf)
                np.multiply(buf, self.odd[j], out=buf)
                out[at:end, j] = np.minimum.reduceat(buf, base)
            at = end
        return out


def digest16(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()

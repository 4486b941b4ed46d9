"""Vectorised word and shingle hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
#: A 64-bit value for each byte, A-Z as a-z, and an odd base; words hash by a polynomial over these.
_BYTE = _RNG.integers(1, 2**63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MULT = _RNG.integers(1, 2**63, 64, dtype="uint64") * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; a block ends at white space.
BLOCK = 1 << 19
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype="uint64")
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK:  # one giant word: not kept
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; a null is an empty string."""
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype="int64" if wide else "int32")[col.offset : col.offset + len(col) + 1].astype("int64")
    data = np.frombuffer(col.buffers()[2] or b"", dtype="uint8")
    return data, offsets


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and the words before each text (and after the last)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    starts, hashes = [np.zeros(0, "int64")], [np.zeros(0, "uint64")]
    at = lo
    while at < hi:
        end = min(hi, at + BLOCK)
        while end < hi:  # back to the last white space, or on to the next
            gaps = np.flatnonzero(_SEP[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(hi, end + BLOCK)
        b = data[at:end]
        word = ~_SEP[b]
        edge = np.zeros(len(b) + 1, dtype=bool)
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at
        edge[inner] = True
        edge[0] = edge[-1] = True
        first = word & (edge[:-1] | np.concatenate(([True], ~word[:-1])))
        last = word & (edge[1:] | np.concatenate((~word[1:], [True])))
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            up, down = _powers(len(b))
            total = np.cumsum(np.where(word, _BYTE[b], np.uint64(0)) * up[: len(b)])
            before = np.where(s > 0, total[s - 1], np.uint64(0))
            hashes.append(mix((total[e] - before) * down[s] + (e - s).astype("uint64")))
            starts.append(s + at)
        at = end
    start, h = np.concatenate(starts), np.concatenate(hashes)
    return h, np.searchsorted(start, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; fewer words count as one shingle, none as no shingle."""
    h, bound = words(data, offsets)
    n = max(0, len(h) - k + 1)
    rolled = np.zeros(n, dtype="uint64")
    for j in range(k):
        rolled += h[j : j + n] * _MULT[j]
    rolled = mix(rolled)
    for a, z in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if z - a >= k:
            yield np.unique(rolled[a : z - k + 1])
        elif z > a:
            yield mix(np.array([(h[a:z] * _MULT[: z - a]).sum() + np.uint64(z - a)], dtype="uint64"))
        else:
            yield np.zeros(0, dtype="uint64")

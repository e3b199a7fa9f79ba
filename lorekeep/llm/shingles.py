"""Hashed words and shingles of whole Arrow batches, in numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: The white space that parts words (space and U+0009 to U+000D).
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit counts."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0.. and P^-0.. up to n, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _P), np.full(size, np.uint64(pow(int(_P), -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: runs without the bytes in parts, within documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike wherever it stands."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted and back to back, and the n+1 offsets of the documents' sets."""
    n_docs = len(offsets) - 1
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets, side="left")
    counts = np.diff(at)
    n = len(words)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total[: max(n - j, 0)] += words[j:] * np.uint64(pow(int(_Q), j, 1 << 64))
    left = np.repeat(at[1:], counts) - np.arange(n)
    shingles = mix(total[left >= width] ^ np.uint64(width << 56))
    sizes = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = {}
    for d in short:
        h = sum(int(w) * pow(int(_Q), j, 1 << 64) for j, w in enumerate(words[at[d] : at[d + 1]])) % (1 << 64)
        extra[d] = mix(np.array([h ^ (int(counts[d]) << 56)], np.uint64))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out, lengths = [], np.zeros(n_docs, np.int64)
    for d in range(n_docs):
        own = shingles[bounds[d] : bounds[d + 1]] if d not in extra else extra[d]
        if len(own):
            own = np.sort(own)
            if len(own) > 1:
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
            out.append(own)
            lengths[d] = len(own)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(lengths)))

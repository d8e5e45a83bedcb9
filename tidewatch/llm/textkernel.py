"""Vectorised word and shingle hashing over the bytes of many texts."""

from __future__ import annotations

import numpy as np

# The separators of a word (space, tab, line feeds, returns).
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[SPACES] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P[i] = sum of code(byte j) * BASE^j over j < i, modulo 2^64."""
    power, _ = _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * power[:len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes."""
    _, inverse = _grow(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of the bytes marked in ``table``), and
    the first word index of each text."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[:n - 1]
    edges = offs[1:-1]
    edges = edges[edges < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside[:n].copy()
    if n:
        last[:n - 1] &= ~inside[1:n]
        edges = edges[edges > 0]
        last[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets.

    Words are lower-cased in A-Z. A text with fewer than ``width`` words has
    its whole sequence as the only shingle, a text without words has none.
    """
    low = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    words = span_hashes(prefix_sums(low), starts, ends)
    count = np.diff(first)
    doc_of = np.repeat(np.arange(len(count)), count)
    rng = np.random.Generator(np.random.PCG64(width))
    key = rng.integers(1, 2**63, width + 1, dtype=np.uint64) | np.uint64(1)
    size = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate(([0], np.cumsum(size)))
    h = np.empty(bounds[-1], np.uint64)
    o = np.repeat(np.arange(len(count)), size)
    long = count[o] >= width
    m = len(words) - width + 1
    if m > 0:
        acc = np.full(m, key[width], np.uint64)
        for j in range(width):
            acc += words[j:j + m] * key[j]
        h[long] = mix(acc[doc_of[:m] == doc_of[width - 1:]])
    for short in range(1, width):
        docs = np.flatnonzero(count == short)
        if len(docs):
            acc = np.full(len(docs), key[width] + np.uint64(short), np.uint64)
            for j in range(short):
                acc += words[first[docs] + j] * key[j]
            h[bounds[docs]] = mix(acc)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(count) + 1))

"""Hashed byte grams of texts, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20          # bytes hashed together; a longer text comes alone
STRETCH = 1 << 19        # bytes of terms, or starts of a text, looked at together
# (gram, windows): a string of gram + windows - 1 bytes or more has at least
# one window of grams, and the smallest hash of each of its windows is also
# the smallest of a window of any text that holds the string.
KINDS = {"long": (12, 13), "medium": (8, 5), "brief": (7, 2)}
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _packed(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (at most 7) bytes from each position as one number."""
    n = max(len(data) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out |= data[j:j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


def _gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    if width < 8:
        return _mix(_packed(data, width) ^ _K[0])
    words = _packed(data, 4)
    n = max(len(data) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for j in range(0, width, 4):
        out += words[j:j + n] * _K[j // 4]
    return _mix(out)


def _window_minima(data: np.ndarray, gram: int, windows: int) -> np.ndarray:
    hashes = _gram_hashes(data, gram)
    if len(hashes) < windows:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(hashes, windows).min(axis=1)


def gram_kinds(size: int) -> int | str:
    """The kind of grams that a term of so many bytes is filed under; the
    whole of a term of at most seven bytes is its gram."""
    for kind, (gram, windows) in KINDS.items():
        if size >= gram + windows - 1:
            return kind
    return size


def _values(data: np.ndarray, kind) -> tuple[np.ndarray, int]:
    """Hashes from each position and the bytes that each one covers."""
    if kind in KINDS:
        gram, windows = KINDS[kind]
        return _window_minima(data, gram, windows), gram + windows - 1
    return _mix(_packed(data, kind) | np.uint64(kind << 56)), kind


def text_grams(column: pa.Array, kinds: list, bits: np.ndarray | None = None) -> pa.Array:
    """Distinct grams of the given kinds of each text, as lists of 64-bit
    numbers; with ``bits`` (a bitmap by the low bits of a gram) only those
    whose bit is set. A null text has none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    body = column.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    owners, grams, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1)
        data, ends = body[offsets[lo]:offsets[hi]], offsets[lo + 1:hi + 1] - offsets[lo]
        for kind in kinds:
            h, span = _values(data, kind)
            owner = np.searchsorted(ends, np.arange(len(h)), side="right")
            keep = np.arange(len(h)) + span <= ends[np.minimum(owner, len(ends) - 1)]
            if bits is not None:
                at = h & np.uint64(8 * len(bits) - 1)
                keep &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            owners.append(owner[keep] + lo)
            grams.append(h[keep])
        lo = hi
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, gram = owner[new], gram[new]
    bounds = np.searchsorted(owner, np.arange(len(column) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(gram.view(np.int64)))


def prefix_widths(size: int) -> list[int]:
    """Widths of the beginnings that a term of so many bytes is known by."""
    return [w for k in range(3, 63) if (w := 1 << k) <= size]


class PieceHashes:
    """Hashes of any pieces of a row of bytes, from one running sum."""

    _B = 0x9E3779B97F4A7C15
    _BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n + 1, self._B, np.uint64)
        self.back = np.full(n + 1, pow(self._B, -1, 1 << 64), np.uint64)
        power[0] = self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._BYTES[data] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size, whole: bool) -> np.ndarray:
        """A whole term and the beginning of one have different hashes."""
        salt = (np.atleast_1d(size).astype(np.uint64) << np.uint64(1) | np.uint64(whole)) * _K[1]
        return _mix(_mix((self.sums[start + size] - self.sums[start]) * self.back[start]) ^ salt)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8), offsets


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` (a power of two) equal shares of all terms each
    whole term belongs to."""
    return (_mix(h ^ _K[2]) & np.uint64(parts - 1)).astype(np.int32)


def term_hashes(column: pa.Array, parts: int = 1):
    """(part, hash) of all terms, a stretch of them at a time: of a whole term
    its hash and, once more, the upper half of it, and of its beginnings."""
    body, offsets = bytes_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRETCH, side="right")) - 1)
        start, size = offsets[lo:hi] - offsets[lo], np.diff(offsets[lo:hi + 1])
        sums = PieceHashes(body[offsets[lo]:offsets[hi]])
        whole = sums.of(start, size, True)
        part = _part(whole, parts)
        yield np.concatenate((part, part)), np.concatenate((whole, whole >> np.uint64(32)))
        for width in prefix_widths(int(size.max(initial=0))):
            able = size >= width
            yield part[able], sums.of(start[able], width, False)
        lo = hi


def bits_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (of its low bits) is set."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _stretches(body: np.ndarray, offsets: np.ndarray, lo: int, hi: int | None, reach: int):
    """(row, first and last start, end of the bytes to read, characters before
    the first start) of the starts ``lo:hi`` of the texts, ``STRETCH`` at most."""
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at, last, seen, before = begin + lo, end if hi is None else min(begin + hi, end), begin, 0
        while at < last:
            before += int(np.count_nonzero((body[seen:at] & 0xC0) != 0x80))
            stop = min(at + STRETCH, last)
            yield row, at, stop, min(stop + reach, end), before
            seen, at = at, stop


def _pieces_of(body: np.ndarray, stretches: list, sizes: np.ndarray, bits: np.ndarray, part: int, parts: int):
    row, first, last, end, before = np.array(stretches, np.int64).T
    data = np.concatenate([body[a:b] for a, b in zip(first.tolist(), end.tolist())])
    shift = np.cumsum(end - first) - end            # from a place in the body to one in the data
    count = last - first
    owner = np.repeat(np.arange(len(row)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + (first + shift)[owner]
    leads = (data & 0xC0) != 0x80                   # a term starts where a character does
    owner, start = owner[leads[start]], start[leads[start]]
    stop, sums = (end + shift)[owner], PieceHashes(data)
    chars = np.concatenate(([0], np.cumsum(leads)))
    able, width = np.arange(len(start)), 0
    while len(able):
        further = max(8, 2 * width)
        for size in sizes[(sizes >= width) & (sizes < further)].tolist():
            at = able[start[able] + size <= stop[able]]
            h = sums.of(start[at], size, True)
            keep = bits_set(bits, h) & bits_set(bits, h >> np.uint64(32))
            at = at[keep & (_part(h, parts) == part)]
            for k in range(0, len(at), step := max(1, STRETCH // size)):
                o, s = owner[at[k:k + step]], start[at[k:k + step]]
                yield row[o], before[o] + chars[s] - chars[(first + shift)[o]], s - shift[o], np.full(len(o), size)
        width = further
        able = able[start[able] + width <= stop[able]]
        if width > sizes.max(initial=0):
            return
        able = able[bits_set(bits, sums.of(start[able], width, False))]


def text_pieces(body: np.ndarray, offsets: np.ndarray, lo: int, hi: int | None, sizes: np.ndarray, bits: np.ndarray, part: int = 0, parts: int = 1):
    """(row, first character, place in the body, size) of the pieces of the
    texts that start at the bytes ``lo:hi`` and may be terms of a part: of one
    of the ``sizes`` and, like their beginnings, with the bits of their hashes
    set.  Some at a time, at most ``STRETCH`` bytes."""
    held, room = [], 0
    for one in _stretches(body, offsets, lo, hi, int(sizes.max(initial=0))):
        if held and room + one[3] - one[1] > STRETCH:
            yield from _pieces_of(body, held, sizes, bits, part, parts)
            held, room = [], 0
        held.append(one)
        room += one[3] - one[1]
    if held:
        yield from _pieces_of(body, held, sizes, bits, part, parts)


def cut_out(body: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The pieces of the body at the given places."""
    ends = np.cumsum(size)
    data = body[np.repeat(at - ends + size, size) + np.arange(size.sum())]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

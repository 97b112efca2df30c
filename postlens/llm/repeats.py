"""Which 200-byte strings occur twice: anchors that equal strings share, found by content alone."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Polynomial hashes of substrings of one byte array, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASE):
        up, down = self._table(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])
        self.down = down

    @classmethod
    def _table(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < size:
            size = max(size, 1 << 16)
            have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
            cls._powers[base] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_ranges(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Cuts the windows of each document into ranges that share an anchor.

    The anchor of a window is its gram with the smallest hash, the first of several; equal
    windows have it at the same place.  For each range: row (document), a (first window, from
    the document's start), n (windows), key (hash of the anchor) and c (hash of all bytes of
    the range's windows and of where the anchor lies in them).
    """
    lengths = np.diff(offsets)
    empty = np.zeros(0, np.int64)
    if len(data) < width or (lengths < width).all():
        return {"row": empty, "a": empty, "n": empty, "key": empty, "c": empty}
    rolling = Rolling(data)
    grams = mix(rolling.all(gram))
    place = np.arange(len(grams), dtype=np.uint64)
    bits = max(1, int(len(grams)).bit_length())
    low = np.uint64((1 << bits) - 1)
    anchor = (window_minimum((grams & ~low) | place, width - gram + 1) & low).astype(np.int64)

    valid = np.zeros(len(anchor), bool)
    edges = np.zeros(len(data) + 1, np.int64)
    long = lengths >= width
    np.add.at(edges, offsets[:-1][long], 1)
    np.add.at(edges, (offsets[1:] - width + 1)[long], -1)
    valid = np.cumsum(edges)[: len(anchor)] > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first[offsets[:-1][long]] = True
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    last_of_row = offsets[row + 1] - width
    end = np.minimum(np.append(start[1:], len(data)) - 1, last_of_row)  # last window of the range
    p = anchor[start]
    shift = (p - start).astype(np.uint64)
    size = (end - start + 1).astype(np.uint64)
    salt = mix(shift * np.uint64(0xD6E8FEB86659FD93) + size)
    return {
        "row": row, "a": start - offsets[row], "n": end - start + 1, "key": mix(rolling.of(p, p + gram) + np.uint64(1)).view(np.int64),
        "c": mix(rolling.of(start, end + width) ^ salt).view(np.int64),
    }

"""Encode texts through their distinct words: each is encoded once and the ids are put together again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Encoded = tuple[np.ndarray, np.ndarray]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs [start, start + length) of ``flat``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class WordStore:
    """Ids by word.  Holds the first ``limit`` words it meets; a later one is encoded again in each batch."""

    def __init__(self, encode: Callable[[list[str]], Encoded], limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.slots: dict[str, int] = {}
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, lengths): the ids of words[i] are flat[starts[i]:][:lengths[i]]."""
        slot = np.fromiter(map(self.slots.get, words, (-1 for _ in words)), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        if not len(new):
            return self.flat, self.starts[slot], self.lengths[slot]
        ids, offsets = self.encode([words[i] for i in new])
        room = max(0, min(len(new), self.limit - len(self.slots)))
        flat = np.concatenate([self.flat, ids.astype(np.int32)])
        starts = np.concatenate([self.starts, offsets[:-1] + len(self.flat)])
        lengths = np.concatenate([self.lengths, np.diff(offsets)])
        slot[new] = len(self.starts) + np.arange(len(new))
        found = flat, starts[slot], lengths[slot]
        if room:
            for i in new[:room]:
                self.slots[words[i]] = int(slot[i])
            keep = len(self.starts) + room
            self.flat, self.starts, self.lengths = flat[: len(self.flat) + offsets[room]], starts[:keep], lengths[:keep]
        return found


def encode_split(texts: pa.Array, store: WordStore, cut: str, lead: str = "") -> Encoded:
    """Flat ids of texts cut at ``cut``, with ``lead`` before each part, and where each text starts."""
    lists = pc.split_pattern(texts, cut)
    offsets = np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    coded = pc.list_flatten(lists).dictionary_encode()
    index = np.asarray(coded.indices, np.int64)
    flat, starts, lengths = store.lookup([lead + w for w in coded.dictionary.to_pylist()] if lead else coded.dictionary.to_pylist())
    parts = lengths[index]
    ends = np.concatenate([[0], np.cumsum(parts)])
    return gather(flat, starts[index], parts), ends[offsets]


def interleave(pieces: list[tuple[np.ndarray, Encoded]], rows: int) -> Encoded:
    """Joins encodings of disjoint sets of rows into one in row order."""
    flat = np.concatenate([p[1][0] for p in pieces])
    starts, lengths = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    base = 0
    for at, (ids, offsets) in pieces:
        starts[at], lengths[at] = offsets[:-1] + base, np.diff(offsets)
        base += len(ids)
    return gather(flat, starts, lengths), np.concatenate([[0], np.cumsum(lengths)])

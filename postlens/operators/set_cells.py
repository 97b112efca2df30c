"""Similar sets met block by block: what a task of ``dedup.block_pairs`` does, in numpy.

A set is known by 32-bit hashes of its tokens (of block and token, so sets of two blocks share none but
by chance), in the order of (how often a hash's last ``SLOTS`` bits are met, hash).  Equal hashes of two tokens only
add pairs, which are compared by their tokens later; no pair is lost by them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLOTS = 20
EPS = 1e-6


def prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's rarest tokens hold one that any partner shares."""
    return (n - np.ceil(n * threshold - 1e-9) + 1).astype(np.int64)


def parity_words(n: np.ndarray) -> np.ndarray:
    """The longs that ``parities`` gives for n tokens."""
    need = np.maximum(4 * n - 1, 1)
    return np.maximum(1 << np.ceil(np.log2(need + 1)).astype(np.int64), 64) // 64


def parities(s: np.ndarray) -> np.ndarray:
    """Bits as longs, four or more a shingle and a power of two: how many shingles fall on a bit, odd or even."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def parts(lists: pa.ListArray, kind: type) -> list[np.ndarray]:
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(kind)
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]


def encoded(hashes: list[np.ndarray], often: np.ndarray, threshold: float) -> tuple[list[bytes], list[bytes]]:
    """Prefix (hashes, rarest first) and parity bits of every set."""
    first, bits = [], []
    for h in hashes:
        rank = often[h & ((1 << SLOTS) - 1)].astype(np.uint64) << np.uint64(32) | h.astype(np.uint64)
        rank.sort()
        size = int(prefix_sizes(np.array(len(h)), threshold))
        first.append(rank[:size].astype(np.uint32).tobytes())
        bits.append(parities(h.astype(np.int64)).tobytes())
    return first, bits


def flat_sets(df: DataFrame) -> DataFrame:
    """The array of texts ``_set`` as ``_words``, one after the other, and ``_ends``, the length of each."""
    kept = [f for f in df.schema if f.name != "_set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.values for x in batch["_set"]]
            sizes = [pc.binary_length(x).fill_null(0).to_numpy().astype(np.int32).tobytes() for x in rows]
            words = ["".join(w or "" for w in x.to_pylist()).encode() for x in rows]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], [*(f.name for f in kept), "_words", "_ends"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", _words binary, _ends binary")


class Block:
    """Sets of one packed row, in the order of (block, size)."""

    def __init__(self, row: dict, threshold: float):
        self.who, self.text = row["who"], (row["words"], row["ends"])
        self.home, self.n = np.frombuffer(row["home"], np.int64), np.frombuffer(row["n"], np.int64)
        self.sizes = prefix_sizes(self.n, threshold)
        self.tokens = np.frombuffer(row["first"], np.uint32)
        self.bits = np.frombuffer(row["bits"], np.uint64)
        self.words = parity_words(self.n)
        self.bits_at = np.cumsum(self.words) - self.words

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The set of every prefix token and its place in it."""
        owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.sizes)
        return owner, np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of every span, one after the other."""
    return np.repeat(starts - (np.cumsum(counts, dtype=np.int64) - counts), counts) + np.arange(counts.sum())


def near_by_bits(a: Block, z: Block, i: np.ndarray, j: np.ndarray, slack: float, room: int = 1 << 20) -> np.ndarray:
    """Which pairs (i of a, j of z) the parity bits do not rule out; the longer bits are folded to the shorter."""
    out = np.zeros(len(i), bool)
    kinds = a.words[i] << 32 | z.words[j]
    for kind in np.unique(kinds):
        wa, wz, rows = int(kind >> 32), int(kind & 0xFFFFFFFF), np.flatnonzero(kinds == kind)
        for part in np.array_split(rows, max(1, len(rows) * max(wa, wz) // room)):
            x = a.bits[a.bits_at[i[part]][:, None] + np.arange(wa)]
            y = z.bits[z.bits_at[j[part]][:, None] + np.arange(wz)]
            while x.shape[1] != y.shape[1]:
                if x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
                else:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
            out[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (a.n[i[part]] + z.n[j[part]]) * slack + EPS
    return out


def meet(a: Block, z: Block, same: bool, threshold: float, room: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a, of z), a's set no larger, that share a token at places which leave both enough tokens for the
    threshold, and that the parity bits do not rule out.  At most ``room`` combinations are looked at together."""
    share, slack = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
    homes = np.unique(a.home)
    at = np.minimum(np.searchsorted(homes, z.home), len(homes) - 1)
    known = homes[at] == z.home
    keys = np.searchsorted(homes, a.home) << 32 | a.n

    def until(n: np.ndarray, home: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(keys, home << 32 | np.clip(n, 0, (1 << 32) - 1).astype(np.int64), side)

    low, high = until(np.ceil(z.n * threshold - EPS), at, "left"), until(z.n, at, "right")
    if same:
        high = np.minimum(high, np.arange(len(z.n)))
    # The smaller set's tokens at places that leave it two shares of its size, by (token, set).
    owner, place = a.entries()
    kept = a.n[owner] - place >= a.n[owner] * (2 * share) - EPS
    owner, place = owner[kept], place[kept]
    index = a.tokens[kept].astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64)
    order = np.argsort(index)
    index, owner, over = index[order], owner[order], (a.n[owner] - place - a.n[owner] * share)[order]
    del kept, place, order
    # The other's, by token, so that neighbours are looked up side by side.
    z_owner, z_place = z.entries()
    use = np.flatnonzero((known & (low < high))[z_owner])
    by_token = (z.tokens[use].astype(np.uint64) << np.uint64(32)) | use.astype(np.uint64)
    by_token.sort()
    some = []
    for use in np.array_split(by_token, max(1, len(by_token) // room)):
        token, use = use & ~np.uint64(0xFFFFFFFF), (use & np.uint64(0xFFFFFFFF)).astype(np.int64)
        who = z_owner[use]
        left = z.n[who] - z_place[use]
        most = np.minimum(high[who], until(np.floor((left + EPS) / share - z.n[who]), at[who], "right"))
        begin = np.searchsorted(index, token | low[who].astype(np.uint64))
        counts = np.searchsorted(index, token | most.astype(np.uint64)) - begin
        hit = np.flatnonzero(counts > 0)
        some.append((begin[hit].astype(np.int32), counts[hit].astype(np.int32), who[hit]))
    del by_token, z_place, index
    begin, counts, z_owner = (np.concatenate(x) for x in zip(*some))
    total, found, waiting, held = np.cumsum(counts, dtype=np.int64), [], [], 0

    def settle() -> None:
        pairs = np.unique(np.concatenate(waiting))
        found.append(pairs[near_by_bits(a, z, pairs >> 32, pairs & 0xFFFFFFFF, slack)])
        waiting.clear()

    start = 0
    while start < len(begin):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + room, "right")))
        for cut in range(0, int(counts[start]), room) if end == start + 1 else (0,):  # one token's list alone may be over the room
            n = np.minimum(counts[start:end] - cut, room) if end == start + 1 else counts[start:end]
            entry = spans(begin[start:end] + cut, n)
            other = np.repeat(z_owner[start:end], n)
            good = over[entry] >= z.n[other] * share - EPS
            waiting.append(owner[entry[good]].astype(np.int64) << 32 | other[good])
            held += len(waiting[-1])
        start = end
        if held > 2 * room:
            settle()
            held = 0
    if waiting:
        settle()
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def packer(room: int, carry: list[str], schema: pa.Schema):
    """Batches of sets, in order, to rows of about ``room`` tokens each: see ``Block``.  ``at`` orders the rows of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            n, home = t["_n"].to_numpy().astype(np.int64), t["_home"].to_numpy().astype(np.int64)
            join = lambda c: b"".join(t[c].to_pylist()) if c in t.column_names else b""
            return pa.RecordBatch.from_pylist([{
                "at": at, "low": int(home[0]), "high": int(home[-1]), "n_low": int(n[0]), "n_high": int(n[-1]), "home": home.tobytes(), "n": n.tobytes(),
                "first": join("_first"), "bits": join("_bits"), "words": join("_words"), "ends": join("_ends"), "who": {c: t[c].to_pylist() for c in carry}}], schema=schema)

        for batch in batches:
            upto = tokens + np.cumsum(batch["_n"].to_numpy().astype(np.int64))
            ends = np.flatnonzero(np.diff(upto // room, prepend=tokens // room))
            start = 0
            for end in [*ends.tolist(), batch.num_rows]:  # a set that fills a row up begins the next one
                if end > start:
                    held.append(batch.slice(start, end - start))
                if end < batch.num_rows and held:
                    yield row()
                    at, held[:] = at + 1, []
                start = end
            tokens = int(upto[-1]) if len(upto) else tokens
        if held:
            yield row()

    return run


def runner(fn: Callable, threshold: float, schema: pa.Schema):
    """``fn`` of the two rows a and z, of a's and z's places in the pairs that meet, and the threshold, for every row of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, z = (Block(batch[side][k].as_py(), threshold) for side in ("a", "z"))
                i, j = meet(a, z, batch["a"][k]["at"] == batch["z"][k]["at"], threshold)
                yield pa.RecordBatch.from_pydict(fn(a, z, i, j, threshold), schema=schema)

    return run


def in_pairs(a: Block, z: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> dict[str, list]:
    """The sets that are in some pair."""
    i, j = np.unique(i).tolist(), np.unique(j).tolist()
    return {"_id": [a.who["_rep"][x] for x in i] + [z.who["_rep"][x] for x in j], "_copies": [a.who["_copies"][x] for x in i] + [z.who["_copies"][x] for x in j]}


def shared(a: Block, z: Block, i: np.ndarray, j: np.ndarray, room: int = 1 << 21) -> np.ndarray:
    """How many tokens each pair shares, by the tokens themselves."""
    words, sizes = (np.concatenate([np.frombuffer(x, kind) for x in side]) for side, kind in zip(zip(a.text, z.text), (np.uint8, np.int32)))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(words)])
    code = texts.dictionary_encode().indices.to_numpy()
    left, right = code[: int(a.n.sum())], code[int(a.n.sum()):]
    a_at, z_at = np.cumsum(a.n) - a.n, np.cumsum(z.n) - z.n
    marked, out = np.zeros(len(code) + 1, bool), np.zeros(len(i), np.int64)
    order = np.argsort(j, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(j[order])) + 1):
        if not len(part):
            continue
        own = right[z_at[j[part[0]]]: z_at[j[part[0]]] + z.n[j[part[0]]]]
        marked[own] = True
        for some in np.array_split(part, max(1, int(a.n[i[part]].sum()) // room)):
            n = a.n[i[some]]
            out[some] = np.add.reduceat(marked[left[spans(a_at[i[some]], n)]], np.cumsum(n) - n, dtype=np.int64)
        marked[own] = False
    return out


def similar(a: Block, z: Block, i: np.ndarray, j: np.ndarray, threshold: float) -> dict[str, list]:
    """The pairs of a block that reach the threshold, with the sizes of what they share and of what they have."""
    both = shared(a, z, i, j)
    either = a.n[i] + z.n[j] - both
    good = both >= either * threshold - 1e-9
    i, j, both, either = (x[good].tolist() for x in (i, j, both, either))
    same = [k for k, (x, y) in enumerate(zip(i, j)) if a.who["_block"][x] == z.who["_block"][y]]
    out = {"_block": [a.who["_block"][i[k]] for k in same], "_i": [both[k] for k in same], "_u": [either[k] for k in same]}
    for side, at, x in ((a, i, "a"), (z, j, "z")):
        out |= {f"_{x}": [side.who["_rep"][at[k]] for k in same], f"_c{x}": [side.who["_copies"][at[k]] for k in same]}
    return out

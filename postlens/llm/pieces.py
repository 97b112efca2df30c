"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are joined into one text, whose suffixes are sorted; a binary
search finds where each vocabulary piece occurs; the occurrences, as edges from start to end,
are sorted by where they end and relaxed in that order.

The model is a BPE model, so an edge is not scored by a sum: the encoding of a prefix that
ends with piece t is the encoding of the rest of the prefix, and t, exactly if the piece before
t and t do not merge across their border.  So each position has one edge that holds, and
relaxing finds it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Encoded, WordStore, encode_split, gather

SPACE = "▁"
NONE, START, BYTES = -1, -2, -3


def merge(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """Plain BPE on a short string: best rank first, leftmost among equals."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            break
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


@dataclass
class Model:
    """Tables read from a model file; small, and sent to every task."""

    pieces: list[str]
    bytes_: dict[int, int]
    skip: set[int]
    unknown: int
    prefix: bool
    ids: np.ndarray = field(init=False)  # of the pieces that encoding may use
    rank: np.ndarray = field(init=False)  # by id: when the piece is formed, -1 for one character
    left: np.ndarray = field(init=False)
    right: np.ndarray = field(init=False)
    pairs: np.ndarray = field(init=False)  # left * size + right, sorted
    pair_rank: np.ndarray = field(init=False)
    spaces: dict[str, float] = field(init=False)

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        bytes_ = {i: int(pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        model = cls(pieces, bytes_, skip, sp.unk_id(), sp.decode(sp.encode("a")) == "a" and pieces[sp.encode("a")[0]].startswith(SPACE))
        if len(bytes_) != 256:
            raise ValueError("a model with byte fallback is needed")
        model._build({i: sp.get_score(i) for i in range(n) if i not in bytes_ and i not in skip})
        return model

    def _build(self, scores: dict[int, float]) -> None:
        # Runs of spaces share one score and so merge last, from the left: kept apart.
        runs = {i for i in scores if len(self.pieces[i]) > 1 and not self.pieces[i].strip(SPACE)}
        self.spaces = {self.pieces[i]: -scores[i] for i in runs}
        plain = {i: -s for i, s in scores.items() if i not in runs}
        rank = {self.pieces[i]: r for i, r in plain.items()}
        ident = {self.pieces[i]: i for i in plain}
        many = [r for p, r in rank.items() if len(p) > 1]
        if len(set(many)) != len(many) or any(SPACE * 2 in p for p in rank) or any(self.spaces[p] <= max(many, default=0) for p in self.spaces):
            raise ValueError("pieces of more than one character must have scores of their own")
        size = len(self.pieces)
        self.rank = np.full(size, -1.0)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        use = []
        for piece, i in ident.items():
            if len(piece) > 1:
                last = self._last_merge(piece, rank)
                if last is None:
                    continue
                self.left[i], self.right[i] = ident[last[0]], ident[last[1]]
                self.rank[i] = rank[piece]
            use.append(i)
        self.ids = np.array(sorted(use), np.int64)
        made = self.ids[self.left[self.ids] >= 0]
        if (self.rank[self.left[made]] >= self.rank[made]).any() or (self.rank[self.right[made]] >= self.rank[made]).any():
            raise ValueError("a piece must be formed after its parts")
        keys = self.left[made] * size + self.right[made]
        order = keys.argsort()
        self.pairs, self.pair_rank = keys[order], self.rank[made][order]

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, float]) -> tuple[str, str] | None:
        """The two parts whose merge forms the piece; None if BPE never forms it."""
        symbols = list(piece)
        if any(c not in rank for c in symbols):
            return None
        while len(symbols) > 2:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
            if best is None:
                return None
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        return symbols[0], symbols[1]

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are.

        Looks back through time at what stood on both sides of the border: undo the later of
        the two merges, and ask whether the neighbours of then would have merged first.
        """
        size = len(self.pieces)
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), np.inf)  # a merge over the border counts if it is earlier than this
        even = np.zeros(len(a), bool)  # or as early
        while len(at):
            key = x * size + y
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            r = np.where(self.pairs[k] == key, self.pair_rank[k], np.inf)
            bad = (r < before) | (even & (r == before) & (r < np.inf))
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            undo_x = rx > ry
            before, even = np.where(undo_x, rx, ry), ~undo_x
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok


def suffix_ranks(points: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` or more characters (prefix doubling)."""
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return rank


class PieceEncoder:
    """Encodes and decodes columns of texts; makes the same ids as the model's own library."""

    def __init__(self, model: Model):
        self.model = model
        self.table = [model.pieces[i] for i in model.ids]
        self.sizes = np.array([len(p) for p in self.table])
        self.deep = int(self.sizes.max())
        self.points = np.zeros((len(self.table), self.deep), np.uint32)
        for i, p in enumerate(self.table):
            self.points[i, : len(p)] = [ord(c) for c in p]
        lead = [np.where(np.arange(3) < self.sizes[:, None], self.points[:, :3].astype(np.uint64), np.uint64(rest)) for rest in (0, (1 << 21) - 1)]
        self.lead = [x[:, 0] << np.uint64(42) | x[:, 1] << np.uint64(21) | x[:, 2] for x in lead]
        self.byte_ids = np.zeros(256, np.int64)
        for i, b in model.bytes_.items():
            self.byte_ids[b] = i
        self.one_space = model.pieces.index(SPACE)
        self.space_ids = {p: model.pieces.index(p) for p in [SPACE, *model.spaces]}
        self.runs: dict[int, np.ndarray] = {}
        self.store = WordStore(self.encode_words, 400_000)
        surface = [b"" if i in model.skip else bytes([model.bytes_[i]]) if i in model.bytes_ else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        surface[model.unknown] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface])
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size

    def _ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the sorted suffixes those that begin with each piece lie, by binary search.

        The first three characters of a suffix are one number, so one search of sorted numbers
        settles short pieces and narrows the others down; these go on character by character.
        """
        padded = np.concatenate([text, np.zeros(self.deep + 3, text.dtype)])
        wide = padded.astype(np.uint64)
        keys = (wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:])[order]
        low = np.searchsorted(keys, self.lead[0], "left")
        high = np.searchsorted(keys, self.lead[1], "right")
        longer = np.flatnonzero((self.sizes > 3) & (low < high))
        steps = np.arange(3, self.deep)
        inside, points = steps < self.sizes[:, None], self.points[:, 3:]

        def bound(beyond: bool) -> np.ndarray:
            a, b, at = low.copy(), high.copy(), longer
            while len(at):
                mid = (a[at] + b[at]) // 2
                suffix = padded[order[mid][:, None] + steps]
                differ = (suffix != points[at]) & inside[at]
                k = differ.argmax(1)
                rows = np.arange(len(k))
                right = np.where(differ[rows, k], suffix[rows, k] < points[at, k], beyond)
                a[at[right]], b[at[~right]] = mid[right] + 1, mid[~right]
                at = at[a[at] < b[at]]
            return a

        first, after = bound(False), bound(True)
        short = self.sizes <= 3
        return np.where(short, low, first), np.where(short, high, after)

    def encode_words(self, words: list[str], most: int = 1 << 17) -> Encoded:
        """Ids of strings that are encoded each by itself; spaces are already marked.

        About ``most`` characters share a suffix array (one word at least), which bounds what
        their matches take in memory.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        part = np.cumsum([len(w) for w in words]) // most
        if len(words) > 1 and part[0] != part[-1]:
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
            made = [self._encode_part(words[a:b]) for a, b in zip(cuts, cuts[1:])]
            return np.concatenate([m[0] for m in made]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(m[1]) for m in made]))])
        return self._encode_part(words)

    def _encode_part(self, words: list[str]) -> Encoded:
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        limit = np.repeat(starts + lengths, lengths + 1)  # by position: where its word ends

        order = suffix_ranks(text, self.deep).argsort(kind="stable")
        low, high = self._ranges(text, order)
        count = high - low
        begin = gather(order, low, count)
        piece = np.repeat(np.arange(len(self.table)), count)
        size = self.sizes[piece]
        inside = begin + size <= limit[begin]  # no piece holds the separator unless a text does
        begin, piece, size = begin[inside], piece[inside], size[inside]

        alone = np.ones(len(text), bool)
        alone[begin[size == 1]] = False
        alone[starts + lengths] = False
        odd = np.flatnonzero(alone)  # characters outside the vocabulary: bytes
        begin = np.concatenate([begin, odd])
        token = np.concatenate([self.model.ids[piece], np.full(len(odd), BYTES)])
        end = np.concatenate([begin[: len(size)] + size, odd + 1])
        home = np.repeat(starts, lengths + 1)
        reach = end - home[begin]
        by_end = np.argsort(reach, kind="stable")
        begin, token, end = begin[by_end], token[by_end], end[by_end]
        steps = np.concatenate([[0], np.cumsum(np.bincount(reach))])

        last = np.full(len(text) + 1, NONE, np.int64)
        origin = np.zeros(len(text) + 1, np.int64)
        last[starts] = START
        for k in range(1, len(steps) - 1):
            b, t, e = begin[steps[k] : steps[k + 1]], token[steps[k] : steps[k + 1]], end[steps[k] : steps[k + 1]]
            prior = last[b]
            holds = (prior == START) | (prior == BYTES) | (t == BYTES)
            ask = np.flatnonzero(~holds & (prior >= 0))
            holds[ask] = self.model.stand(prior[ask], t[ask])
            last[e[holds]], origin[e[holds]] = t[holds], b[holds]

        at, row, got, who = starts + lengths, np.arange(len(words)), [], []
        while True:
            going = at > starts[row]
            at, row = at[going], row[going]
            if not len(at):
                break
            t = last[at]
            got.append(np.where(t == BYTES, -4 - (at - 1), t))
            who.append(row)
            at = origin[at]
        if not got:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        flat, owner = np.concatenate(got)[::-1], np.concatenate(who)[::-1]
        in_order = np.argsort(owner, kind="stable")
        flat, owner = flat[in_order], owner[in_order]
        return self._spell(flat, owner, text, len(words))

    def _spell(self, flat: np.ndarray, owner: np.ndarray, text: np.ndarray, words: int) -> Encoded:
        """Characters outside the vocabulary become their UTF-8 bytes."""
        odd = np.flatnonzero(flat < 0)
        if len(odd):
            spelled = {int(c): self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(text[-4 - flat[odd]])}
            put = [spelled[int(c)] for c in text[-4 - flat[odd]]]
            sizes = np.ones(len(flat), np.int64)
            sizes[odd] = [len(p) for p in put]
            starts = np.cumsum(sizes) - sizes
            grown = np.repeat(flat, sizes)
            for i, p in zip(starts[odd], put):
                grown[i : i + len(p)] = p
            flat, owner = grown, np.repeat(owner, sizes)
        return flat, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words))])

    def encode(self, texts: pa.Array) -> Encoded:
        """Flat ids of all texts and where each text starts; null and empty texts have none."""
        texts = texts.fill_null("")
        if not self.model.prefix:
            raise ValueError("a model that puts a space before a text is needed")
        flat, starts = encode_split(texts, self.store, " ", SPACE)
        empty = np.asarray(pc.equal(texts, ""))
        lengths = np.diff(starts)
        if empty.any():  # an empty text was encoded as its leading space
            flat, lengths = flat[np.repeat(~empty, lengths)], np.where(empty, 0, lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)])
        return self._join_spaces(flat, starts)

    def _join_spaces(self, flat: np.ndarray, starts: np.ndarray) -> Encoded:
        """Single spaces side by side in one text, in the pieces that runs of spaces have."""
        lone = flat == self.one_space
        double = np.flatnonzero(lone[:-1] & lone[1:])
        first = np.zeros(len(flat) + 1, bool)
        first[starts[:-1]] = True
        double = double[~first[double + 1]]
        if not len(double) or not self.model.spaces:
            return flat, starts
        row = np.searchsorted(starts, double, "right") - 1
        out, sizes = [], np.diff(starts)
        at = 0
        for r in np.unique(row):
            ids = flat[starts[r] : starts[r + 1]]
            out.append(flat[at : starts[r]])
            out.append(new := self._joined(ids))
            sizes[r] = len(new)
            at = starts[r + 1]
        out.append(flat[at:])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        lone = np.concatenate([[0], ids == self.one_space, [0]])
        edges = np.flatnonzero(np.diff(lone))
        parts, at = [], 0
        for a, b in zip(edges[::2], edges[1::2]):
            parts.append(ids[at:a])
            n = int(b - a)
            if n not in self.runs:
                self.runs[n] = self._run(n)
            parts.append(self.runs[n])
            at = b
        return np.concatenate([*parts, ids[at:]])

    def _run(self, n: int) -> np.ndarray:
        """A run of n spaces: equal scores merge from the left, so it grows to the longest piece
        that can be reached and begins again."""
        symbols: list[str] = []
        longest = len(merge([SPACE] * min(n, 4 * self.deep), self.model.spaces)[0])
        while n > 4 * self.deep:
            symbols.append(SPACE * longest)
            n -= longest
        symbols += merge([SPACE] * n, self.model.spaces)
        return np.array([self.space_ids[s] for s in symbols], np.int64)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of flat ids; one leading space goes, bytes that are no UTF-8 become U+FFFD."""
        sizes = self.surface_size[ids]
        data = gather(self.surface, self.surface_at[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[starts]
        found = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [t[1:] if t.startswith(" ") and self.model.prefix else t for t in found]

"""Near copies by exact Jaccard similarity of word shingles, found through SimHash fingerprints and prefix keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import _verify, connected_components, odd_apart, parities
from ..session import cut_lineage
from .common import map_text
from .simhash import SEED, fingerprint_links


PIECE = 2 << 20  # bytes of text at a time
SKETCH = ["p0", "p1", "p2", "p3"]  # the parities of 256 bits, which go with every key


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; words as in ``simhash.fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    runs = set(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">i8").astype(np.int64))


def shingle_sets(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """set (distinct shingle hashes) and sig (a hash of the set) of every document."""

    def make():
        def run(texts: pa.Array) -> list:
            sets = [shingle_set(t, width) for t in texts.to_pylist()]
            return [as_lists(sets), signatures(sets)]

        return run

    return map_text(docs.select(text), make, "set array<long>, sig long", text, piece_bytes=PIECE).select("set", "sig")


def as_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    odd = np.array([np.bincount(s & 255, minlength=256) & 1 for s in sets], np.uint8).reshape(-1, 256)
    return list(np.packbits(odd, axis=1).view(np.int64).T.copy())


def majority(s: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes: a bit is set if over half of them have it."""
    ones = sum(np.unpackbits(s[i : i + 65536].view(np.uint8)).reshape(-1, 64).sum(0, np.int64) for i in range(0, len(s), 65536))
    return int(np.packbits(2 * ones > len(s)).view(np.int64)[0]) if len(s) else 0


def frequent_shingles(named: DataFrame, width: int, sample_size: int, share: int = 8, most: int = 250_000) -> np.ndarray:
    """(hash, count), by hash, of shingles in over four documents of a sample, at most the ``most`` frequent ones.

    The sample is one document in ``share``, more in a small table.  So what counts as frequent is a number of
    documents, some forty, at any size, and the sets that meet at a key do not grow with the table.
    """
    every = max(1, min(share, named.count() // sample_size))
    sample = shingle_sets(named.filter(F.pmod("body", F.lit(every)) == 0), width=width)
    seen = sample.select(F.explode("set").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 4")
    hot = np.array([tuple(x) for x in seen.orderBy(F.col("c").desc(), "key").limit(most).collect()], np.int64).reshape(-1, 2)
    return hot[np.argsort(hot[:, 0])]


def summaries(named: DataFrame, width: int = 5) -> DataFrame:
    """row, sig, n (distinct shingles), bits (see ``parities``), fp (see ``majority``) and the sketch of every text."""

    def make():
        def run(texts: pa.Array) -> list:
            sets = [shingle_set(t, width) for t in texts.to_pylist()]
            return [signatures(sets), np.array([len(s) for s in sets], np.int32), as_lists([parities(s) for s in sets]), np.array([majority(s) for s in sets], np.int64), *sketches(sets)]

        return run

    return map_text(named, make, "sig long, n int, bits array<long>, fp long, " + ", ".join(f"{p} long" for p in SKETCH), "text", ["ident", "body"], PIECE)


def prefix_keys(named: DataFrame, threshold: float, width: int = 5, sample_size: int = 5_000) -> DataFrame:
    """key, sig, n, pos: the first n - ceil(n * threshold) + 1 shingles of each set by one order for
    all sets, of which two sets that reach the threshold have one in common, and their places from 0.

    Any order will do.  Shingles frequent in a sample come last, rarest first, so a
    passage that stands in many documents is a key only of those that are little else.
    """
    hot = frequent_shingles(named, width, sample_size)

    def first(s: np.ndarray) -> np.ndarray:
        count = np.zeros(len(s), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot[:, 0], s), len(hot) - 1)
            count = np.where(hot[at, 0] == s, hot[at, 1], 0)
        return s[np.lexsort((s, count))[: len(s) - int(np.ceil(len(s) * threshold - 1e-9)) + 1]]

    def make():
        def run(texts: pa.Array) -> list:
            sets = [shingle_set(t, width) for t in texts.to_pylist()]
            return [signatures(sets), np.array([len(s) for s in sets], np.int32), as_lists([first(s) for s in sets])]

        return run

    made = map_text(named.select("text"), make, "sig long, n int, prefix array<long>", "text", piece_bytes=PIECE)
    return made.select(F.posexplode("prefix").alias("pos", "key"), "sig", "n").select("key", "sig", "n", "pos")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(_key, _id, n, pos): the prefix shingles that several sets have, and the sets."""
    kinds = {"key": np.int64, "sig": np.int64, "n": np.int32, "pos": np.int32}

    def as_batch(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(t)) for i, t in enumerate(kinds.values())], names=list(kinds))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key another set has too; comes sorted by (key, sig)."""
        held, paired = np.zeros((0, len(kinds)), np.int64), False
        for batch in batches:
            rows = np.concatenate([held, np.stack([np.asarray(c, np.int64) for c in batch.columns], 1)])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            rows = rows[new]
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            found = np.concatenate([[paired], same])
            found[:-1] |= same
            held, paired = rows[-1:], bool(found[-1])
            yield as_batch(rows[:-1][found[:-1]])
        if paired:
            yield as_batch(held)

    dealt = keys.repartition("key").sortWithinPartitions("key", "sig")
    return dealt.mapInArrow(shared, "key long, sig long, n int, pos int").withColumnsRenamed({"key": "_key", "sig": "_id"})


def with_before(keys: DataFrame, most: int = 6) -> DataFrame:
    """Adds before: the ``most`` keys of the same set that come last before each key."""
    order = Window.partitionBy("_id").orderBy("pos")
    return keys.withColumn("before", F.array_compact(F.array(*[F.lag("_key", i).over(order) for i in range(1, most + 1)])))


def met_first(before: str, other: str):
    """False only if two sets that meet at a key have met at one of the keys right before it.

    All sets have one order, so at the first key that two sets share this holds, and a pair comes out there at least;
    of two texts that are alike most other meetings are left out.
    """
    return ~F.arrays_overlap(before, other)


def proposals(rows: DataFrame, reach: int) -> DataFrame:
    """(src, dst): sets that SimHash takes for near copies.

    Sets of one fingerprint are paired with its smallest one, and those of fingerprints up to ``reach``
    bits apart, as the vantage-point trees of ``simhash`` link them, with each other.
    """
    points = cut_lineage(rows.groupBy("fp").agg(F.min("sig").alias("first")))
    within = rows.join(points, "fp").filter(F.col("sig") != F.col("first")).select(F.col("first").alias("src"), F.col("sig").alias("dst"))
    linked = fingerprint_links(points, reach)
    return within.unionByName(linked.join(points.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(points.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_copy_groups(keys: DataFrame, rows: DataFrame, named: DataFrame, threshold: float, width: int, reach: int, most_broadcast: int = 1_000_000) -> DataFrame:
    """(sig, component) of every set joined to another over pairs that reach the threshold.

    SimHash proposes first.  Then the sets of a key are compared with one of them, then across those groups that the
    key still holds, so a large group of copies of one text makes no square.  The place of a key in
    two sets bounds what they can share from there on: the smaller set of a near pair has its first
    common key in the first n - 2t / (1 + t) * n + 1 places.  So only sets that hold a key so early are paired with the
    others of it, and a passage that stands in many texts, late in the order, pairs none.  Across groups two sets are
    paired where they meet first, not at each key they share.  No pair is missed:
    every odd bit that differs needs a shingle that differs, so pairs with more such bits than
    the threshold leaves shingles to differ are ruled out before texts are read again.
    """
    sized = rows.select("sig", "n", "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        a = sized.select(F.col("sig").alias("src"), F.col("n").alias("na"), F.col("bits").alias("ba"))
        b = sized.select(F.col("sig").alias("dst"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
        met = pairs.distinct().join(a, "src").join(b, "dst").filter(alike("na", "nb"))
        near = cut_lineage(met.filter(odd_apart("ba", "bb") <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("src", "dst"))
        ids = near.select(F.explode(F.array("src", "dst")).alias("sig")).distinct()
        bodies = cut_lineage(rows.select("sig", "body").join(ids, "sig", "left_semi").select("body"))
        # Few texts as a rule are left to compare; more than a bound of them are not broadcast.
        few = F.broadcast(bodies) if bodies.count() <= most_broadcast else bodies.hint("merge")
        sets = cut_lineage(shingle_sets(named.select("body", "text").join(few, "body", "left_semi"), width=width).dropDuplicates(["sig"]))
        return cut_lineage(_verify(near, sets.select(F.col("sig").alias("_id"), F.col("set").alias("_set")), threshold))

    def alike(a: str, b: str):
        return F.least(a, b) >= F.greatest(a, b) * threshold

    def early(n: str, pos: str):
        return F.col(n) - F.col(pos) >= F.col(n) * (2 * threshold / (1 + threshold)) - 1e-6

    def possible(n: str, pos: str, m: str, at: str):
        """By their places, and by the bits of their sketches that differ."""
        apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"q_{p}"))) for p in SKETCH), F.lit(0))
        return alike(n, m) & (apart <= (F.col(n) + F.col(m)) * ((1 - threshold) / (1 + threshold)) + 1e-6) & (F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)) >= (F.col(n) + F.col(m)) * (threshold / (1 + threshold)) - 1e-6)

    pivots = keys.groupBy("_key").agg(F.min(F.struct((~early("n", "pos")).alias("late"), "_id", "n", "pos", *SKETCH)).alias("p")).filter("NOT p.late").select("_key", F.col("p._id").alias("src"), F.col("p.n").alias("m"), F.col("p.pos").alias("at"), *[F.col(f"p.{p}").alias(f"q_{p}") for p in SKETCH])
    star = keys.join(pivots, "_key").filter((F.col("_id") != F.col("src")) & possible("n", "pos", "m", "at")).select("src", F.col("_id").alias("dst"))
    first = verified(star.unionByName(proposals(rows, reach)))
    labels = connected_components(first).withColumnRenamed("node", "_id")
    labelled = cut_lineage(keys.join(labels, "_id", "left").withColumn("_comp", F.coalesce("component", "_id")))
    mixed = labelled.groupBy("_key").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).filter("_lo <> _hi").select("_key")
    left = labelled.filter(early("n", "pos")).join(mixed, "_key", "left_semi").select("_key", F.col("_id").alias("src"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("_comp").alias("_a"), F.col("before").alias("_before"), *[F.col(p).alias(f"q_{p}") for p in SKETCH])
    right = labelled.select("_key", F.col("_id").alias("dst"), "n", "pos", F.col("_comp").alias("_b"), "before", *SKETCH)
    smaller = F.struct("m", "src") < F.struct(F.col("n").alias("m"), F.col("dst").alias("src"))
    met = left.join(right, "_key").filter((F.col("_a") != F.col("_b")) & smaller & met_first("before", "_before") & possible("n", "pos", "m", "at"))
    across = met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().join(star.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), ["src", "dst"], "left_anti")
    return connected_components(first.unionByName(verified(across))).withColumnRenamed("node", "sig")


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, width: int = 5, reach: int = 3) -> DataFrame:
    """One document of each group, the one with the smallest key, with the columns it came with.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word shingles
    is at least ``threshold``.  Fingerprints within ``reach`` bits propose pairs, prefix keys give all others, and
    every pair is compared in full.

    A text of fewer words than ``width`` is one shingle.  Null, empty and blank texts have none
    and are one group.  A null key is larger than any other; of different texts under the smallest key the one with
    the smallest hash stays, and rows equal in key and text stay or go together.  An empty
    table gives an empty result.  Extra columns keep their names and values.
    """
    named = docs.select(F.col(f"`{key}`").alias("ident"), F.col(f"`{text}`").alias("text")).withColumn("body", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = cut_lineage(summaries(named, width).select("row.ident", "row.body", "sig", "n", "bits", "fp", *SKETCH))
    # One row a set: its least body, sizes and bits.
    sets = cut_lineage(rows.groupBy("sig").agg(F.min("body").alias("body"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp"), *[F.first(p).alias(p) for p in SKETCH]).filter("n > 0"))
    keys = cut_lineage(with_before(shared_keys(prefix_keys(named, threshold, width)).join(sets.select(F.col("sig").alias("_id"), *SKETCH), "_id")))
    best = F.struct(F.col("ident").isNull().alias("none"), "ident", "body")
    labelled = rows.select("ident", "body", "sig").join(near_copy_groups(keys, sets, named, threshold, width, reach), "sig", "left").withColumn("group", F.coalesce("component", "sig"))
    stays = labelled.groupBy("group").agg(F.min(best).alias("b")).select("b.*")
    stays = stays.select("none", F.coalesce("ident", F.lit(0)).alias("i"), "body")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{key}`"].isNull().alias("none"), F.coalesce(docs[f"`{key}`"], F.lit(0)).alias("i"), F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias("body"))
    return whole.join(stays, ["none", "i", "body"], "left_semi").select("row.*")

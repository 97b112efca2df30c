"""Near-duplicates by SimHash fingerprints, linked through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from ..session import cut_lineage
from .common import map_text

SEED = 42


def fingerprint(text: str | None, width: int = 3, step: int = 1 << 16) -> bytes:
    """Eight bytes, the highest bit first: bit set if over half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return bytes(8)
    runs = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) if len(words) >= width else [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(runs), step):
        hashes = b"".join(map(xxhash.xxh64_digest, runs[at : at + step], repeat(SEED)))
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, np.int64)
    return np.packbits(2 * ones > len(runs)).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, width: int = 3) -> DataFrame:
    """row and fp (the 64 bits as a long) for every document; no words: all bits zero."""

    def make():
        return lambda texts: [np.frombuffer(b"".join(fingerprint(t, width) for t in texts.to_pylist()), ">i8").astype(np.int64)]

    return map_text(docs, make, "fp long", text, carry)


@dataclass
class Tree:
    """Inner nodes: vantage point and radius; a child below zero is shard ``-1 - child``."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    shards: int


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def plant(sample: np.ndarray, shards: int) -> Tree:
    """A tree over a sample: each node halves its part at the median distance from its first point."""
    nodes: list[list[int]] = []
    leaves = 0

    def grow(part: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        if wanted > 1 and len(part) > 2:
            d = distance(part, part[0])
            radius = int(np.median(d))
            near = d <= radius
            if near.all():
                radius -= 1
                near = d <= radius
            if near.any() and not near.all():
                here = len(nodes)
                nodes.append([int(part[0].view(np.int64)), radius, 0, 0])
                nodes[here][2] = grow(part[near], wanted // 2)
                nodes[here][3] = grow(part[~near], wanted - wanted // 2)
                return here
        leaves += 1
        return -leaves

    grow(sample, shards)
    table = np.array(nodes, np.int64).reshape(-1, 4)
    return Tree(table[:, 0].view(np.uint64), table[:, 1], table[:, 2], table[:, 3], leaves)


def route(tree: Tree, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions, is home) for every shard that points live in or could have partners in.

    By the triangle inequality a partner within ``reach`` of a point at distance d from the
    vantage point lies within d - reach and d + reach of it.
    """
    stack = [(0 if len(tree.vantage) else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if node < 0:
            yield -1 - node, at, home
            continue
        d, radius = distance(points[at], tree.vantage[node]).astype(np.int64), tree.radius[node]
        near, to_in, to_out = d <= radius, d - reach <= radius, d + reach > radius
        stack.append((int(tree.inside[node]), at[to_in], home[to_in] & near[to_in]))
        stack.append((int(tree.outside[node]), at[to_out], home[to_out] & ~near[to_out]))


def links(points: np.ndarray, queries: np.ndarray, reach: int, block: int = 1 << 21) -> np.ndarray:
    """Pairs that join all points and queries as the pairs within ``reach`` do.

    Goes down a vantage-point tree of its own until a product is small.  A block with few
    pairs gives them all; one with many gives each member with the smallest it is joined to,
    so a dense group costs no more rows than it has members.
    """
    found: list[np.ndarray] = []

    def product(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, block // len(p))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            near = distance(part[:, None], p[None, :]) <= reach
            i, j = np.nonzero(near)
            if len(i) > 4 * (len(p) + len(part)):
                nodes = np.unique(np.concatenate([part[i], p[j]]))
                a, b = np.searchsorted(nodes, part[i]), np.searchsorted(nodes, p[j])
                label = np.arange(len(nodes))
                while True:
                    low = label.copy()
                    np.minimum.at(low, a, label[b])
                    np.minimum.at(low, b, label[a])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                found.append(np.stack([nodes, nodes[label]], 1)[label != np.arange(len(nodes))])
            else:
                pairs = np.stack([part[i], p[j]], 1)
                found.append(pairs[pairs[:, 0] != pairs[:, 1]])

    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > 128 and len(p) * len(q) > 1 << 16:
            d = distance(p, p[len(p) // 2]).astype(np.int64)
            radius = int(np.median(d))
            near = d <= radius
            if near.any() and not near.all():
                dq = distance(q, p[len(p) // 2]).astype(np.int64)
                stack.append((p[near], q[dq - reach <= radius]))
                stack.append((p[~near], q[dq + reach > radius]))
                continue
        product(p, q)
    if not found:
        return np.zeros((0, 2), np.uint64)
    pairs = np.concatenate(found)
    return np.unique(np.sort(pairs, 1), axis=0)


def fingerprint_links(points: DataFrame, reach: int = 2, sample_size: int = 4096, shard_size: int = 16_384, most_sampled: int = 1 << 18) -> DataFrame:
    """(src, dst) between distinct fingerprints ``fp``: the links that make the same groups as
    all pairs within ``reach`` bits.

    The top of the tree is planted on a sample, first by hash, and sent to every task; all
    fingerprints are indexed by it.  The sample is ``sample_size`` fingerprints, or four for
    each shard wanted where that is more, up to ``most_sampled`` (2 MB).  A shard is home to ``shard_size`` points, or
    to twice the root of their number: more shards would cost copies, fewer would outgrow a task.  Each lives in one shard and is
    also a query in every shard across whose boundary a partner could lie.
    """
    many = points.count()
    shards = max(1, -(-many // max(shard_size, 2 * isqrt(many))))
    size = min(most_sampled, max(sample_size, 4 * shards))
    sample = np.array([r[0] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64).view(np.uint64)
    tree = plant(sample, shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for shard, at, home in route(tree, fp.view(np.uint64), reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(fp[at]), pa.array(home)], names=["shard", "fp", "home"])

    def search(shard: pa.Table) -> pa.Table:
        fp = shard["fp"].to_numpy().view(np.uint64)
        home = shard["home"].to_numpy()
        pairs = links(fp[home], fp, reach).view(np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return points.select("fp").mapInArrow(deal, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(search, "src long, dst long")


def near_groups(hashed: DataFrame, reach: int = 2, **options) -> DataFrame:
    """(fp, component_id), from (ident, fp): the smallest ident reachable over links.

    A null ident is never the smallest unless its group has no other.
    """
    points = cut_lineage(hashed.groupBy("fp").agg(F.min("ident").alias("first")))
    linked = connected_components(fingerprint_links(points, reach, **options))
    labelled = cut_lineage(points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("group")))
    smallest = labelled.groupBy("group").agg(F.min("first").alias("component_id"))
    return labelled.join(smallest, "group").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, reach: int = 2, **options) -> DataFrame:
    """(ident, fp, component_id) for every document.

    Equal fingerprints are folded before the search, so copies cost nothing there.  A null or
    empty text has fingerprint zero and is linked like any other; repeated rows share a group.
    """
    hashed = cut_lineage(fingerprints(docs.select(F.col(f"`{key}`").alias("ident"), F.col(f"`{text}`").alias("text")), carry=["ident"], width=width).select("row.ident", "fp"))
    return hashed.join(near_groups(hashed, reach, **options), "fp")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, reach: int = 2, **options) -> DataFrame:
    """One document of each group, the one with the smallest key, with the columns it came with.

    Of different texts under that key the one with the smallest hash stays; rows equal in
    key and text stay or go together.
    """
    named = docs.select(F.col(f"`{key}`").alias("ident"), F.col(f"`{text}`").alias("text")).withColumn("body", F.xxhash64(F.coalesce("text", F.lit(""))))
    hashed = cut_lineage(fingerprints(named, carry=["ident", "body"], width=width).select("row.ident", "row.body", "fp"))
    best = F.struct(F.col("ident").isNull().alias("none"), "ident", "body")
    stays = hashed.join(near_groups(hashed, reach, **options), "fp").groupBy(F.col("component_id")).agg(F.min(best).alias("b")).select("b.*")
    stays = stays.select("none", F.coalesce("ident", F.lit(0)).alias("i"), "body")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{key}`"].isNull().alias("none"), F.coalesce(docs[f"`{key}`"], F.lit(0)).alias("i"), F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))).alias("body"))
    return whole.join(stays, ["none", "i", "body"], "left_semi").select("row.*")

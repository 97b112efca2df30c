"""A Merkle manifest of a dataset: trees of digests in blocks of van Emde Boas layout.

Rows of a group are leaves in ascending key order; while several nodes remain, every
``ARITY`` consecutive ones (fewer in the last run) become their digest.  The roots of the
groups, in ascending group order, are the leaves of one more such tree.

A tree is stored in blocks: aligned subtrees of at most ``height`` levels above their
leaves.  The roots of one level's blocks are the leaves of the next level's.  Inside a block
the levels are split at half height, the top part is stored first and then each bottom part
after the other, each in the same way, so a path from a leaf to the block's root stays in few
cache lines whatever their size.  Nothing but arithmetic says where a node is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import remove_path

ARITY = 3
WIDTH = 32  # bytes of a digest


def field(value: Column) -> Column:
    """A value as it enters a leaf: - if null, else its length in bytes, a colon, itself."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def tree_size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (root: 0) of a complete tree of ``levels`` levels are stored."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return tree_size(top) + index // width * tree_size(levels - top) + address(levels - top, depth - top, index % width)


def height_of(leaves: int, most: int) -> int:
    """Levels above the leaves until one node remains, at most ``most``."""
    height = 0
    while height < most and ARITY**height < leaves:
        height += 1
    return height


class Block:
    """A subtree of ``count`` leaves and ``height`` levels above them, as one array of digests."""

    def __init__(self, nodes: np.ndarray, count: int, height: int):
        self.nodes, self.height = nodes, height
        self.sizes = [count]  # nodes of a level, leaves first
        for _ in range(height):
            self.sizes.append(-(-self.sizes[-1] // ARITY))

    def at(self, level: int, index: np.ndarray) -> np.ndarray:
        return address(self.height + 1, self.height - level, index)

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        block = cls(np.zeros((tree_size(height + 1), WIDTH), np.uint8), len(leaves), height)
        block.nodes[block.at(0, np.arange(len(leaves)))] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, WIDTH)
        for level in range(height):
            below = block.hex(level)
            made = [sha256("".join(below[i : i + ARITY]).encode()).digest() for i in range(0, len(below), ARITY)]
            block.nodes[block.at(level + 1, np.arange(len(made)))] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, WIDTH)
        return block

    @classmethod
    def load(cls, data: bytes, count: int, height: int) -> Block:
        return cls(np.frombuffer(data, np.uint8).reshape(-1, WIDTH), count, height)

    def hex(self, level: int) -> list[str]:
        """Digests of a level in order, gathered from their addresses."""
        text = self.nodes[self.at(level, np.arange(self.sizes[level]))].tobytes().hex()
        return [text[i : i + 2 * WIDTH] for i in range(0, len(text), 2 * WIDTH)]

    def root(self) -> bytes:
        return self.nodes[self.at(self.height, np.zeros(1, np.int64))[0]].tobytes()

    def paths(self) -> list[list[tuple[str, str]]]:
        """For every leaf, level by level: the siblings left of the path and those right of it."""
        per_level = []
        for level in range(self.height):
            row = self.hex(level)
            runs = [row[i : i + ARITY] for i in range(0, len(row), ARITY)]
            per_level.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        paths, at = [], np.arange(self.sizes[0])
        steps = [(at // ARITY**level).tolist() for level in range(self.height)]
        for leaf in range(self.sizes[0]):
            paths.append([per_level[level][steps[level][leaf]] for level in range(self.height)])
        return paths


def number_leaves(rows: DataFrame, group: str, order: list[str], path: str) -> DataFrame:
    """``place`` 0.. of every row in its group by ``order``, and ``total``, the group's rows.

    Rows are range-partitioned by group and order, so a group of a third of all rows spreads
    over many partitions; a row's place is its place in its partition plus the group's rows
    in those before.  One short row a partition and group is all that is counted.  ``path``
    takes the dealt rows, so that a place never depends on how they were dealt a second time.
    """
    rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(offsets, [group, "part"]).withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


BLOCK = "grp string, level int, block long, last boolean, n int, height int, nodes binary, root binary"


def build_blocks(leaves: DataFrame, level: int, height: int, carry: str = "") -> DataFrame:
    """One row a block from (grp, place, total, leaf): its nodes, its root, ``last`` if it is its tree's only one; columns of ``carry`` as arrays."""
    width = ARITY**height
    names = [c.split()[0] for c in carry.split(",") if c.strip()]
    schema = BLOCK + "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in carry.split(",") if c.strip())
    keyed = leaves.select("grp", F.expr(f"place div {width}").alias("block"), "place", "total", "leaf", *names)

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total, n = table.column("total")[0].as_py(), table.num_rows
        tall = height_of(total, height)
        block = Block.build(table.column("leaf").to_pylist(), tall)
        head = {"grp": table.column("grp")[:1], "level": pa.array([level], pa.int32()), "block": table.column("block")[:1], "last": [total <= width], "n": pa.array([n], pa.int32()),
                "height": pa.array([tall], pa.int32()), "nodes": [block.nodes.tobytes()], "root": [block.root()]}
        return pa.table({**head, **{c: [table.column(c).to_pylist()] for c in names}}, schema=to_schema)

    to_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    return keyed.groupBy("grp", "block").applyInArrow(make, schema)


def grow(leaves: DataFrame, folder: str, name: str, height: int, carry: str = "") -> list[str]:
    """Writes all levels of blocks over (grp, place, total, leaf, ...); returns their paths, lowest first.

    Each level has one row for up to ARITY ** height of the level below, so there are few.
    """
    spark, paths = leaves.sparkSession, []
    while True:
        paths.append(f"{folder}/{name}-{len(paths)}")
        build_blocks(leaves, len(paths) - 1, height, carry if len(paths) == 1 else "").write.parquet(paths[-1])
        above = spark.read.parquet(paths[-1]).filter("NOT last")
        if above.isEmpty():
            return paths
        width = ARITY**height
        sizes = above.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
        leaves = above.select("grp", F.col("block").alias("place"), F.col("root").alias("leaf")).join(sizes, "grp")


STEPS = "array<struct<left string, right string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, list[tuple[str, str]]]]:
    """One block at a time: its row, its nodes, the path above its root."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block.load(row["nodes"], row["n"], row["height"]), [(s["left"], s["right"]) for s in row["above"]]


def as_steps(paths: list[list[tuple[str, str]]], above: list[tuple[str, str]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in path + above] for path in paths], _STEPS)


def descend(spark: SparkSession, paths: list[str], start: DataFrame | None) -> DataFrame:
    """The lowest blocks with ``above``, the path from their root upwards, and ``subroot``.

    ``start`` has (grp, above, subroot) of whole trees; None where the tree's own root is the
    end.  A level is joined with the one above it on (grp, block), one row a block, so that a
    large group spreads; only its topmost block is joined on the group alone.
    """

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, above in each_block(batches):
            n, first = row["n"], row["block"] * ARITY ** row["height"]
            yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * n), pa.array(range(first, first + n), pa.int64()), as_steps(block.paths(), above), pa.array([row["subroot"]] * n, pa.string())], names=["grp", "block", "above", "subroot"])

    carried = None
    for path in reversed(paths):
        blocks = spark.read.parquet(path)
        tops = blocks.filter("last")
        tops = tops.withColumns({"above": F.array().cast(STEPS), "subroot": F.lit(None).cast("string")}) if start is None else tops.join(start, "grp")
        rows = tops if carried is None else tops.unionByName(blocks.filter("NOT last").join(carried, ["grp", "block"]))
        if path == paths[0]:
            return rows
        carried = rows.select("grp", "block", "n", "height", "nodes", "above", "subroot").mapInArrow(unfold, f"grp string, block long, above {STEPS}, subroot string")
    raise ValueError("no level")


class Manifest:
    """The written blocks of a dataset's trees: of each group, and of the one over the groups."""

    def __init__(self, spark: SparkSession, groups: list[str], top: list[str]):
        self.spark, self.groups, self.top = spark, groups, top

    def blocks(self) -> DataFrame:
        """All blocks: tree (the group's, or null for the one over the groups), level, block, n, height, nodes, root."""
        named = [(self.groups, F.col("grp")), (self.top, F.lit(None).cast("string"))]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p).select(tree.alias("tree"), "level", "block", "n", "height", "nodes", "root") for paths, tree in named for p in paths])

    def root(self) -> str | None:
        """The dataset's root; None for an empty table."""
        found = self.spark.read.parquet(*self.top).filter("last").select(F.lower(F.hex("root"))).first()
        return found[0] if found else None


def write_manifest(leaves: DataFrame, folder: str, height: int = 7) -> Manifest:
    """Builds and stores the trees over (grp, ident, leaf, other) of every row.

    ``grp`` is "" for a null group, else "=" and the group, so that null comes first and the
    rest in order of bytes.  Rows of a group ascend by ident, null first, equal ones by digest;
    repeated rows are leaves each.  ``other`` is the digest to verify in place of the leaf,
    null for the leaf itself.  An empty table gives no block and no root.
    """
    spark = leaves.sparkSession
    groups = grow(number_leaves(leaves, "grp", ["ident", "leaf"], f"{folder}/leaves"), folder, "group", height, "ident bigint, other binary")
    roots = spark.read.parquet(*groups).filter("last").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("leaf"))
    top = grow(number_leaves(roots, "grp", ["name"], f"{folder}/subroots"), folder, "top", height, "name string")
    remove_path(spark, f"{folder}/leaves")
    remove_path(spark, f"{folder}/subroots")
    return Manifest(spark, groups, top)


def prove(manifest: Manifest) -> DataFrame:
    """ident, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Paths come down from the root, and only the lowest blocks unfold into rows.
    """
    root = manifest.root()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, above in each_block(batches):
            yield pa.RecordBatch.from_arrays([pa.array(row["name"], pa.string()), as_steps(block.paths(), above), pa.array(block.hex(0))], names=["grp", "above", "subroot"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, above in each_block(batches):
            tail = "".join(a + b for a, b in above)
            leaves, proofs, folded = block.hex(0), [], []
            for leaf, other, path in zip(leaves, row["other"], block.paths(), strict=True):
                proofs.append(sha256(("".join([a + b for a, b in path]) + tail).encode()).hexdigest())
                digest = leaf if other is None else other.hex()
                for a, b in path + above:
                    digest = sha256((a + digest + b).encode()).hexdigest()
                folded.append(digest)
            columns = {"ident": pa.array(row["ident"], pa.int64()), "leaf": leaves, "subroot": [row["subroot"]] * len(leaves), "root": [root] * len(leaves), "proof_sha256": proofs, "folded_root": folded}
            yield pa.RecordBatch.from_pydict({**columns, "verified": [f == root for f in folded]})

    top = descend(manifest.spark, manifest.top, None).select("name", "n", "height", "nodes", "above")
    start = top.mapInArrow(trees, f"grp string, above {STEPS}, subroot string")
    lowest = descend(manifest.spark, manifest.groups, start)
    return lowest.select("ident", "other", "n", "height", "nodes", "above", "subroot").mapInArrow(rows, "ident long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def leaf_rows(docs: DataFrame, group: str, key: str, fields: list[str], change: Callable[[DataFrame], tuple[Column, dict[str, Column]]] | None = None) -> DataFrame:
    """(grp, ident, leaf, other) of every row for ``write_manifest``.

    A leaf is the digest of ``fields`` in their order; every column may be null.  ``change``
    gives a condition and new values of fields: where it holds, ``other`` is the digest with
    those values, what is found later in a copy of the dataset.
    """
    own = {f: docs[f"`{f}`"] for f in fields}
    other = F.lit(None).cast("binary")
    if change:
        where, values = change(docs)
        other = F.when(where, leaf_digest(*{**own, **values}.values()))
    named = docs[f"`{group}`"].cast("string")
    grp = F.when(named.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), named))
    return docs.select(grp.alias("grp"), docs[f"`{key}`"].cast("long").alias("ident"), leaf_digest(*own.values()).alias("leaf"), other.alias("other"))

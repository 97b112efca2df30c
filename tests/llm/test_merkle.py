import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm.merkle import Block, address, leaf_rows, prove, tree_size, write_manifest
from postlens.llm.queries import QUERIES
from postlens.session import scratch_path

from .conftest import ROOT

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=...):
    values = [row[f] for f in FIELDS[:4]] + [row["text"] if text is ... else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root of a list of digests and, for each, its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % 3 : k - k % 3 + 3]
            paths[i].append((run[: k % 3], run[k % 3 + 1 :]))
            at[i] = k // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(b"" if r["source"] is None else b"=" + r["source"].encode(), []).append(r)
    names = sorted(groups)
    trees = {}
    for name in names:
        held = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = held, *climb([leaf(r) for r in held])
    root, tops = climb([trees[n][1] for n in names])
    out = []
    for name, top in zip(names, tops):
        held, subroot, paths = trees[name]
        for r, path in zip(held, paths):
            path = path + top
            proof = h(*[x for a, b in path for x in a + b])
            digest = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                digest = leaf(r, r["text"] and r["text"].replace("\n", ""))
            for a, b in path:
                digest = h(*a, digest, *b)
            out.append((r["doc_id"], leaf(r), subroot, root, proof, digest, digest == root))
    return sorted(out, key=str)


def tamper(docs):
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))}


def proven(spark, docs, height):
    manifest = write_manifest(leaf_rows(docs, "source", "doc_id", FIELDS, tamper), scratch_path(spark, "merkle"), height)
    return manifest, sorted(map(tuple, prove(manifest).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 8])
def test_addresses_are_a_layout(levels):
    spots = [address(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(spots).tolist()) == list(range(tree_size(levels)))
    if levels == 5:  # top of two levels, then nine bottoms of three levels, each on its own
        assert sorted(np.concatenate(spots[:2]).tolist()) == [0, 1, 2, 3]
        below = np.concatenate([spots[2][:1], spots[3][:3], spots[4][:9]])
        assert sorted(below.tolist()) == list(range(4, 17))


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 20, 27])
def test_block_against_plain_tree(count):
    leaves = [sha256(str(i).encode()).digest() for i in range(count)]
    height = next(k for k in range(9) if 3**k >= count)
    block = Block.build(leaves, height)
    root, paths = climb([x.hex() for x in leaves])
    assert block.root().hex() == root
    assert block.paths() == [[("".join(a), "".join(b)) for a, b in p] for p in paths]
    assert Block.load(block.nodes.tobytes(), count, height).root() == block.root()


@pytest.mark.parametrize("height", [1, 2, 7])
def test_given_documents(spark, given, height):
    """Small blocks make several levels of them."""
    docs, rows = given
    manifest, got = proven(spark, docs, height)
    assert got == brute(rows)
    blocks = manifest.blocks()
    assert blocks.filter("tree IS NULL").count() >= 1 and (blocks.agg(F.max("level")).first()[0] > 0) == (height < 7)
    assert {r[6] for r in got} == {True, False}


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows + [(20 + i, f"x\n{i}", None, "hot") for i in range(40)]).withColumn("n_chars", F.length("text").cast("long"))
    rows = [r.asDict() for r in docs.collect()]
    assert proven(spark, docs, 2)[1] == brute(rows)
    assert len(rows) == 54


def test_one_row_and_empty(spark, make_docs):
    one = make_docs([(1, "a\nb")]).withColumn("n_chars", F.lit(3))
    manifest, got = proven(spark, one, 7)
    assert got == brute([r.asDict() for r in one.collect()]) and got[0][4] == h() and got[0][1] == got[0][3]
    manifest, got = proven(spark, make_docs([]).withColumn("n_chars", F.lit(3)), 7)
    assert got == [] and manifest.root() is None and manifest.blocks().count() == 0


def test_query(spark, given):
    got = QUERIES["op11_merkle_manifest"](spark, ROOT)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(given[1])

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postlens.llm.queries import QUERIES
from postlens.llm.simhash import fingerprint, fingerprint_links, links, near_dedup, near_duplicates, plant, route

from .conftest import ROOT, long_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, reach=2):
    """Smallest position reachable, over all pairs."""
    fp = np.array(prints, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= reach
    label = np.arange(len(fp))
    while True:
        low = np.where(near, label[None], len(fp)).min(1)
        if (low == label).all():
            return label
        label = low


def clustered(rng, n=3000):
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = seeds[rng.integers(0, 40, n // 2)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))
    return np.unique(np.concatenate([fp, rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]))


def label_from(pairs, points):
    at = {int(p): i for i, p in enumerate(points)}
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = root(at[int(a)]), root(at[int(b)])
        label[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(points))])


def test_query_against_all_pairs(spark, given):
    rows = sorted((r["doc_id"], r["text"]) for r in given[1])
    prints = [brute_print(t) for _, t in rows]
    ids = [i for i, _ in rows]
    expected = {(i, f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, groups(prints))}
    assert {tuple(r) for r in QUERIES["op9_simhash"](spark, ROOT).select("doc_id", "fingerprint", "component_id").collect()} == expected


@pytest.mark.parametrize("block", [256, 1 << 21])
def test_links_make_the_groups_of_all_pairs(block):
    points = clustered(np.random.default_rng(3))
    assert (label_from(links(points, points, 2, block), points) == groups(points)).all()


def test_dense_group_costs_few_rows():
    base = np.uint64(0x0123456789ABCDEF)
    points = np.unique(np.array([base] + [base ^ (np.uint64(1) << np.uint64(b)) for b in range(64)], np.uint64))
    found = links(points, points, 2)
    assert len(found) < 4 * len(points)
    assert (label_from(found, points) == 0).all()


def test_routes_lose_no_pair():
    points = clustered(np.random.default_rng(4), 1200)
    tree = plant(points[:200], 16)
    home, seen = {}, set()
    for shard, at, here in route(tree, points, 2):
        home |= {int(i): shard for i in at[here]}
        seen |= {(int(i), shard) for i in at}
    assert len(home) == len(points) and tree.shards > 4
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None]) <= 2)
    assert all((int(a), home[int(b)]) in seen for a, b in near)


def test_sharded_links(spark):
    points = clustered(np.random.default_rng(5), 1500)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    pairs = np.array([tuple(r) for r in fingerprint_links(df, shard_size=100, sample_size=64).collect()], np.int64).view(np.uint64)
    assert (label_from(pairs, points) == groups(points)).all()


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = near_duplicates(docs).collect()
    assert len(out) == len(odd_rows)
    by = {r.ident: r for r in out}
    assert by[4].fp == by[5].fp == by[6].fp == 0 and by[5].component_id == 4
    assert by[1].component_id == by[2].component_id == 1
    left = near_dedup(docs)
    assert left.columns == docs.columns
    assert left.filter(F.col("doc_id").isin(1, 2)).count() == 1 and left.filter("doc_id = 7").count() == 1


def test_empty_and_long(make_docs):
    assert near_duplicates(make_docs([])).count() == 0 and near_dedup(make_docs([])).count() == 0
    text = long_text(4000)
    assert int.from_bytes(fingerprint(text, step=100), "big") == brute_print(text)

import re

import numpy as np
from hypothesis import given as each, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.llm.boosting import fit
from postlens.llm.quality import FEATURES, MONOTONE, fit_quality, judge, quality_filter, statistics

from .conftest import ROOT, long_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@settings(max_examples=300, deadline=None)
@each(st.text(alphabet="ab #*\n\t\x0b\x1c\xa0é日", max_size=80))
def test_counts(text):
    assert statistics(text)[0] == brute(text)


def test_counts_of_given_and_long(given):
    for row in given[1]:
        assert statistics(row["text"])[0] == brute(row["text"])
    assert statistics(None)[0] == [0] * 5 == statistics("")[0]
    assert statistics(long_text())[0] == brute(long_text())


def test_monotone_trees():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(600)) > 0).astype(float)
    trees = fit(x, y, (1, -1, 0), rounds=30)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.8
    grid = np.linspace(0, 1, 50)
    for _ in range(20):
        row = np.tile(rng.random(3), (50, 1))
        for f, sign in ((0, 1), (1, -1)):
            moved = row.copy()
            moved[:, f] = grid
            assert (sign * np.diff(trees.probability(moved)) >= -1e-12).all()


def test_flat_scoring_is_the_walk():
    rng = np.random.default_rng(2)
    x = rng.random((200, 2))
    trees = fit(x, (x[:, 0] > 0.5).astype(float), (0, 0), rounds=5)
    for row, got in zip(x[:30], trees.probability(x[:30])):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.right[node] if row[trees.feature[node]] > trees.threshold[node] else trees.left[node]
            total += trees.value[node]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-12


def test_keeps_clean_and_rejects_junk(spark, given):
    docs, _ = given
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    out = judge(docs, fit_quality(docs, labels), carry=["doc_id"]).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0 and not r.toxic]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert bad and sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_held_out_labels(spark, given):
    docs, _ = given
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = fit_quality(docs, labels.filter("doc_id % 2 = 0"))
    out = judge(docs, trees, carry=["doc_id"]).select("row.doc_id", "base_failed", "kept").join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in out) >= 0.97 * len(out)


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = judge(docs, None).collect()
    for r in out:
        n, _, _, _, repeated = brute(r.row.text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == (not r.base_failed)
    assert quality_filter(docs, None).columns == docs.columns


def test_without_usable_labels(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert fit_quality(make_docs(odd_rows), labels) is None
    assert fit_quality(make_docs([]), labels) is None
    assert judge(make_docs([]), None).count() == 0


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs([(i, "good words here " * (i % 5 + 1)) for i in range(50)] + [(50 + i, "# * " * 30) for i in range(50)])
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 50, 1).otherwise(0).alias("quality"))
    assert len(MONOTONE) == len(FEATURES)
    assert fit_quality(docs, labels, max_rows=40) is not None

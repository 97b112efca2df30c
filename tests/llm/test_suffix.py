import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given as each, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.llm import suffix_dedup as module
from postlens.llm.queries import QUERIES
from postlens.llm.repeats import anchored_ranges, window_minimum
from postlens.llm.suffix_dedup import _ranges, suffix_dedup
from postlens.llm.suffix_sort import suffix_array

from .conftest import ROOT


@settings(max_examples=400, deadline=None)
@each(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 4))
def test_suffix_array(text, times):
    text = text * times
    assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_regular_texts():
    for text in (b"", b"a", b"a" * 200, b"ab" * 90, b"abracadabra" * 9, bytes(range(256)), bytes(range(255, -1, -1))):
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, width):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (ident, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        left = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((ident, len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("ident", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def planted(rng):
    words = ["the", "on", "re", "tion", "né", "ß", "日", "a"]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = [say(12) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [say(int(rng.integers(0, 12)))]
        for s in shared:
            if rng.random() < 0.5:
                parts += [s[int(rng.integers(0, 5)) :], say(int(rng.integers(0, 3)))]
        rows.append((i, " ".join(parts)))
    return rows + [(100, rows[0][1]), (101, rows[0][1][:40] + "!" + rows[0][1][40:]), (102, "ab" * 60), (103, "x" * 50), (104, None), (105, ""), (None, shared[0]), (106, shared[1]), (106, shared[1])]


@pytest.mark.parametrize("most", [2048, 2, 1])
def test_against_all_windows(make_docs, most):
    rows = planted(np.random.default_rng(most))
    assert found(suffix_dedup(make_docs(rows), width=24, gram=8, most=most, block_bytes=500)) == brute(rows, 24)


def test_query_against_all_windows(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given[1]]
    out = QUERIES["op6_suffix_array"](spark, ROOT).withColumnRenamed("doc_id", "ident")
    assert found(out) == brute(rows, 200)


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = [r[:2] for r in odd_rows]
    assert found(suffix_dedup(docs, width=50, gram=20)) == brute(rows, 50)
    kept = suffix_dedup(docs, width=50, gram=20, with_bytes=True).filter("ident = 10").first()
    assert kept.kept.decode() == odd_rows[12][1]
    assert suffix_dedup(make_docs([])).count() == 0


def test_long_text_by_windows(make_docs, monkeypatch):
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcd"), 3000))
    rows = [(1, text), (2, text[500:2500]), (3, "".join(rng.choice(list("abcd"), 3000)))]
    cut = lambda r, w, g, whole: _ranges(r, w, g, whole, step=64)
    monkeypatch.setattr(module, "_ranges", cut)
    assert found(suffix_dedup(make_docs(rows), width=40, gram=12)) == brute(rows, 40)


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[3000:3300] = data[100:400]
    got = anchored_ranges(data, np.array([0, 1500, 4000]), 30, 10)
    key = {}
    for row, a, n, k in zip(got["row"], got["a"], got["n"], got["key"]):
        key |= {(0, 1500)[row] + int(a) + i: int(k) for i in range(n)}
    assert len(key) == 1500 - 29 + 2500 - 29
    where = {}
    for at, k in key.items():
        where.setdefault(data[at : at + 30].tobytes(), set()).add(k)
    assert all(len(v) == 1 for v in where.values())
    values = rng.integers(0, 50, 100)
    assert window_minimum(values, 13).tolist() == [values[i : i + 13].min() for i in range(88)]


def test_hot_passage(make_docs):
    passage = "this passage stands in every text of the table and is long enough to go " * 2
    rows = [(i, f"{i} head {i * 31} " + passage + f" tail {i * 17}") for i in range(400)]
    assert found(suffix_dedup(make_docs(rows), width=60, gram=24, most=50)) == brute(rows, 60)
    assert suffix_dedup(make_docs(rows), width=60, gram=24).filter(F.col("n_removed") == 0).count() == 0

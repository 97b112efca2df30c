import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm.queries import QUERIES
from postlens.llm.spelling import count_words, letter_bits, near_words, part_enum, spelling_variants

from .conftest import ROOT


def edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    """Neighbours through all words with a letter struck out."""
    wild = {}
    for w in words:
        for i in range(len(w)):
            wild.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), group in wild.items():
        for w in group:
            near[w] |= group - {w}
        if a + b in near:
            near[a + b] |= group
            for w in group:
                near[w].add(a + b)
    return near


def brute(counts, least=5, times=3):
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def damaged_counts(rows):
    counts = Counter()
    for ident, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{ident}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return counts


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def test_given_documents(spark, given):
    expected = brute(damaged_counts([(r["doc_id"], r["text"]) for r in given[1]]))
    out = QUERIES["op12_spelling_variants"](spark, ROOT)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert order(out.collect()) == order(expected)
    assert sum(r[4] for r in expected) > 100


def variants(seed=5):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéñßÿz")
    words = {}
    for _ in range(60):
        w = "".join(rng.choice(letters, rng.integers(5, 14)))
        n = int(rng.integers(3, 4000))
        for _ in range(8):
            words.setdefault(w, n)
            i, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
            w = w[:i] + ("", rng.choice(letters), w[i] + rng.choice(letters))[kind] + w[i + 1 :]
            n = max(3, n // int(rng.integers(1, 5)))
    return {w: n for w, n in words.items() if w}


@pytest.mark.parametrize("parts,parts_one", [((1, 6), (1, 4)), ((1, 3), (1, 2)), ((2, 4), (1, 3)), ((3, 1), (2, 1))])
def test_all_pairs_by_every_partition(spark, parts, parts_one):
    words = sorted(variants())
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(sorted(r)) for r in near_words(frame, parts=parts, parts_one=parts_one).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if edit_one(a, b)}
    assert len(got) > 200


def test_chains_and_ties(spark):
    counts = {**variants(), "chaina": 3, "chainab": 6, "chainabc": 12, "chainabcd": 24, "chainabcde": 48, "lonelyword": 9, "tie-less": 0}
    counts |= {"tiedx": 10, "tieda": 40, "tiedb": 40, "four": 900, "fours": 5, "rarely": 2, "rarel": 3}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = order(spelling_variants(frame).collect())
    assert got == order(brute(counts))
    by = {r[0]: r for r in got}
    assert by["chaina"][2] == "chainabcde" and by["tiedx"][1] == "tieda" and by["fours"][4] == 0 and "rarely" not in by


def test_signature_count():
    row, bits = letter_bits(["banana", "ananab", "banane"])
    assert len(bits) == 18 and len(set(bits.tolist())) == 7
    sigs = part_enum(row, bits, 3, 2, 1, 6)
    assert sigs.shape == (3, 15) and (sigs[0] == sigs[1]).all() and (sigs[0] == sigs[2]).any()


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows + [(90, "h" * 50_000 + " " + "h" * 49_999), (91, ("h" * 50_000 + " ") * 3 + ("H" * 49_999 + "-") * 7)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    counts = count_words(docs, held=7)
    assert dict(map(tuple, counts.collect())) == plain
    words = {w: n for w, n in plain.items() if n > 3 or len(w) > 40_000}
    got = order(spelling_variants(counts.filter((F.col("n") > 3) | (F.length("word") > 40_000))).collect())
    assert order(r[:2] + r[3:] for r in got) == order((r[:2] + r[3:]) for r in brute_small(words))


def brute_small(words):
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    out = []
    for w, n in words.items():
        near = [x for x in words if edit_one(w, x)] if len(w) < 1000 else [x for x in words if abs(len(x) - len(w)) == 1]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        good = best is not None and words[best] >= 2 * n
        out.append((w, best if good else None, None, n, len(near), words[best] if good else None))
    return out


def test_empty(spark, make_docs):
    assert spelling_variants(count_words(make_docs([]))).count() == 0

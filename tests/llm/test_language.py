from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from postlens.llm.language import UNKNOWN, Profiles, _count, identify, learn_profiles
from postlens.llm.queries import QUERIES

from .conftest import ROOT, long_text


def test_held_out_accuracy(spark, given):
    lang = {r["doc_id"]: r["lang"] for r in given[1]}
    out = QUERIES["op1_language_id"](spark, ROOT).collect()
    assert len(out) == len(lang)
    held = [r for r in out if r.held_out]
    assert 0.2 < len(held) / len(out) < 0.5
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def naive(text, profiles, top):
    counts = {}
    for word in text.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != " ":
                    counts[gram] = counts.get(gram, 0) + 1
    # The space between two words belongs to both.
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    best = sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]
    costs = []
    for j in range(len(profiles.languages)):
        ranks = {int(g): int(r) for g, r in zip(profiles.grams, profiles.rank[:, j]) if r < profiles.size}
        costs.append(sum(min(abs(ranks[code(g)] - i), profiles.size) if code(g) in ranks else profiles.size for i, g in enumerate(best)))
    j = costs.index(min(costs))
    return profiles.languages[j], 1 - costs[j] / (profiles.size * len(best))


def test_distance_by_hand(spark, make_docs):
    docs = make_docs([(1, "the cat and the dog and the bird", "en"), (2, "der hund und die katze und der vogel", "de"), (3, None, "en"), (4, "x", None), (5, "1 2 3", "en")] and [(1, "the cat and the dog and the bird", "en", None), (2, "der hund und die katze und der vogel", "de", None), (3, None, "en", None), (4, "zz", None, None), (5, "1 2 3", "en", None)])
    profiles = learn_profiles(docs, size=40)
    assert profiles.languages == ["de", "en"]
    for text in ("the hat", "und so weiter", "der the"):
        got = identify(make_docs([(1, text)]), profiles, carry=["doc_id"], top=30).collect()[0]
        name, score = naive(text, profiles, 30)
        assert got.lang_pred == name and abs(got.score - score) < 1e-12


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = {r.row.doc_id: r for r in identify(docs, learn_profiles(docs)).collect()}
    assert all(out[i].lang_pred == UNKNOWN and out[i].score == 0 for i in (4, 5, 6, 9))
    assert out[10].lang_pred in ("de", "en", "fr")
    assert len(out[1].row) == len(docs.columns)


def test_nothing_learned_and_empty(make_docs, odd_rows):
    nothing = learn_profiles(make_docs([]))
    assert nothing.languages == []
    assert {r.lang_pred for r in identify(make_docs(odd_rows), nothing).collect()} == {UNKNOWN}
    some = Profiles(["en"], np.array([101], np.uint64), np.array([[0]]), 5)
    assert identify(make_docs([]), some).count() == 0


def test_long_text_in_parts():
    text = long_text(3000)
    whole, parts = _count(text, 1 << 30), _count(text, 100)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_null_id_counts(spark, make_docs):
    docs = make_docs([(None, "abc abc", "en", None)])
    assert identify(docs, learn_profiles(docs)).select(F.col("lang_pred")).collect()[0][0] == "en"


def test_profiles_against_plain_counting(spark, given):
    """Counts and places of the most frequent grams over whole documents, in several passes of few grams each."""
    docs, rows = given
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    counts = {}
    for r in rows:
        if r["text"] and r["lang"]:
            here = counts.setdefault(r["lang"], Counter())
            for word in regex.sub(r"[^\p{L}]+", " ", r["text"].lower()).split():
                padded = f" {word} "
                here.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    # The space between two words belongs to both and is one character of the text: only grams inside a word and its edges count.
    for size, held in ((60, 1 << 20), (400, 500)):
        profiles = learn_profiles(docs.repartition(3), size=size, held=held)
        assert profiles.languages == sorted(counts)
        for j, name in enumerate(profiles.languages):
            best = sorted(counts[name], key=lambda g: (-counts[name][g], code(g)))[:size]
            got = {int(g): int(k) for g, k in zip(profiles.grams, profiles.rank[:, j]) if k < size}
            assert got == {code(g): k for k, g in enumerate(best)}

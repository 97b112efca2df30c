import re

import pytest
from pyspark.sql import functions as F

from postlens.llm.common import n_words
from postlens.llm.mixing import mix_plan, mix_to_targets


def reshared(sizes, weights, share=1.5, cap=2.0):
    """Targets by sharing what is over the caps again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        out = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if out[s] > cap * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: cap * sizes[s] for s in over}


def taken(plan):
    return {(r.source, r.ident, r.size): r for r in plan.collect()}


def check(rows, plan):
    sizes, largest = {}, {}
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
    targets = reshared(sizes, (3, 1, 2))
    got = {}
    for r in plan.values():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 2
        got[r.source] = got.get(r.source, 0) + r.copies * r.size * r.n
        largest[r.source] = max(largest.get(r.source, 0), r.size * r.n)
    for s, t in targets.items():
        assert abs(got.get(s, 0) - t) <= largest[s] + 1e-6


def test_targets_and_rounding(make_docs):
    rows = [(i, "w " * (1 + i * i % 37), f"s{i % 7}" if i % 7 else ("hot" if i % 2 else None)) for i in range(1500)]
    docs = make_docs([(i, t, "en", s) for i, t, s in rows])
    plan = taken(mix_plan(docs, n_words(F.col("text")), block=16))
    assert len(plan) == len(rows)
    check(rows, plan)
    again = taken(mix_plan(docs.repartition(5), n_words(F.col("text")), block=16, broadcast_sources=0))
    assert {k: v.copies for k, v in plan.items()} == {k: v.copies for k, v in again.items()}


def test_given_table(given):
    docs, rows = given
    check([(r["doc_id"], r["text"], r["source"]) for r in rows], taken(mix_plan(docs, n_words(F.col("text")))))


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    plan = taken(mix_plan(docs, n_words(F.col("text"))))
    assert sum(r.n for r in plan.values()) == len(odd_rows)
    mixed = mix_to_targets(docs, n_words(F.col("text")))
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.n * r.copies for r in plan.values())


def test_empty(make_docs):
    assert mix_plan(make_docs([]), n_words(F.col("text"))).count() == 0
    assert mix_to_targets(make_docs([]), n_words(F.col("text"))).count() == 0


def test_rounding_has_no_bias(make_docs):
    docs = make_docs([(i, "w " * 10, "en", "ab"[i % 2]) for i in range(200)])
    sums = {}
    for seed in range(6):
        for r in mix_plan(docs, n_words(F.col("text")), share=1.2, seed=1000 * seed).collect():
            sums[r.ident] = sums.get(r.ident, 0) + r.copies
    assert len(set(sums.values())) > 2  # not the same documents each time


def test_repeated_and_null_keys_go_together(make_docs):
    """Rows equal in source, key and size are one item, so a target is missed by up to all of its rows, and no more."""
    rows = [(i // 5, "w " * 12, "a") for i in range(400)] + [(None, "w " * 7, "a") for _ in range(40)] + [(i, "w " * 9, "b") for i in range(90)]
    plan = taken(mix_plan(make_docs([(i, t, "en", s) for i, t, s in rows]), n_words(F.col("text"))))
    assert plan[("a", None, 7)].n == 40 and plan[("a", 3, 12)].n == 5
    check(rows, plan)

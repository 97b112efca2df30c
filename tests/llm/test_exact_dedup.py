import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm.exact_dedup import content_sort, exact_dedup


def brute(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "largest" else min(known)) if known else None
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_groups(make_docs, odd_rows, keep):
    rows = odd_rows + [(100 + i, "copy of one text") for i in range(300)]
    found = content_sort(make_docs(rows), keep=keep)
    out = found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted([(r[0], r[1], r[2], r[4]) for r in out], key=str) == brute([r[:2] for r in rows], keep)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out}) and all(r.doc_id == r.keep_id for r in kept)


def test_keeps_columns_and_one_of_repeated_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = exact_dedup(docs, keep="largest")
    assert left.columns == docs.columns
    assert left.filter("doc_id = 2").count() == 1 and left.filter(F.col("doc_id") == 1).count() == 0


def test_empty_and_normalised(make_docs):
    assert content_sort(make_docs([])).count() == 0
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    assert sorted(r.doc_id for r in exact_dedup(make_docs(rows), normalise=F.lower).collect()) == [1, 3]


def test_refuses_other_rules(make_docs):
    with pytest.raises(ValueError):
        content_sort(make_docs([]), keep="any")

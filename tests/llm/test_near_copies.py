import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm.near_copies import drop_near_copies, frequent_shingles, met_first, odd_apart, parities, shingle_set, with_before

WIDTH, LEAST = 5, 0.8


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < WIDTH:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + WIDTH]) for k in range(len(words) - WIDTH + 1)}


def brute(rows):
    """Smallest ids of the groups, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= LEAST * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (ident, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), ident), ident)
    return sorted(low.values())


def planted(seed=3):
    """Texts of 100 to 600 words, each with a copy of 1 to 12 replaced words; a dense group around one text, and a line that many share."""
    rng = np.random.default_rng(seed)
    rows, ident, line = [], 0, " ".join(f"line{i}" for i in range(30))

    def replaced(words, k):
        words = list(words)
        for at in rng.choice(len(words), k, replace=False):
            words[at] = f"new{rng.integers(1 << 40)}"
        return words

    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(100, 600)))]
        for version in (words, replaced(words, int(rng.integers(1, 13)))):
            rows.append((ident, " ".join(version) + (f" {line}" if i % 2 else "")))
            ident += 1
    base = [f"d{x}" for x in rng.integers(0, 3000, 120)]
    for _ in range(90):
        rows.append((ident, " ".join(replaced(base, int(rng.integers(0, 5))))))
        ident += 1
    return rows


def test_planted_near_copies(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.stage_near(spark, docs, "").collect())
    assert len(expected) < len(rows) - 90
    assert got == expected


def test_given_documents(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in given[1]]
    assert sorted(r.doc_id for r in drop_near_copies(given[0]).select(F.col("doc_id")).collect()) == brute(rows)


def test_odd_rows(spark, make_docs, odd_rows):
    extra = [(70, "one two three four"), (71, "ONE two\tthree four"), (72, " "), (73, "\n" * 40_000)]
    rows = [r[:2] for r in odd_rows] + extra
    docs = make_docs(rows)
    out = drop_near_copies(docs)
    assert out.columns == docs.columns
    known = [r for r in rows if r[0] is not None]
    got = sorted(r.doc_id for r in out.collect())
    # Rows equal in key and text stay together.
    assert sorted(set(got)) == brute(known) and 70 in got and 71 not in got
    assert drop_near_copies(make_docs([])).count() == 0
    assert [r.doc_id for r in drop_near_copies(make_docs([(None, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f")])).collect()] == [5]


def test_parities_rule_out_no_pair(spark):
    """Folded or not, the bits never differ in more places than the sets do."""
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 5, 15, 16, 17, 60, 127, 129, 400):
        words = [f"w{x}" for x in rng.integers(0, 900, n + 4)]
        for m in range(0, n, max(1, n // 7)):
            other = words[: n + 4 - m // 4] + [f"x{x}" for x in rng.integers(0, 90, m // 9)]
            a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                rows.append((parities(a).tolist(), parities(b).tolist(), len(set(a.tolist()) ^ set(b.tolist()))))
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>, n int")
    assert len(rows) > 30 and frame.filter(odd_apart("x", "y") > F.col("n")).count() == 0
    assert any(len(r[0]) != len(r[1]) for r in rows)


def test_alike_sets_meet_about_once(spark):
    """Sixty sets of 60 keys, each 40 of a common order: with all keys they share a pair came out up to forty times."""
    rng = np.random.default_rng(5)
    rows = [(int(k), i, pos) for i in range(60) for pos, k in enumerate(sorted([*rng.choice(60, 40, replace=False), *(100 + rng.choice(10**6, 20))]))]
    keys = with_before(spark.createDataFrame(rows, "_key long, _id long, pos int"))
    a = keys.select("_key", F.col("_id").alias("a"), F.col("before").alias("x"))
    b = keys.select("_key", F.col("_id").alias("b"), F.col("before").alias("y"))
    every = a.join(b, "_key").filter("a < b")
    first = every.filter(met_first("x", "y"))
    assert {tuple(r) for r in first.select("a", "b").distinct().collect()} == {tuple(r) for r in every.select("a", "b").distinct().collect()}
    assert every.count() > 20 * 1770 and first.count() < 1.5 * 1770


def test_frequent_shingles_do_not_depend_on_the_size(spark):
    """A line in 100 of 2,000 documents, of which 50 were sampled, was not taken for frequent."""
    docs = spark.createDataFrame([(i, " ".join(f"u{i}w{k}" for k in range(8)) + (" one line that some of the documents share" if i % 20 == 0 else "")) for i in range(2000)], "ident long, text string")
    named = docs.withColumn("body", F.xxhash64("text"))
    hot = set(frequent_shingles(named, 5, 50)[:, 0].tolist())
    assert set(shingle_set("one line that some of the documents share").tolist()) <= hot

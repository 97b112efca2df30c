from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm.line_runs import LineRuns, drop_worn_lines, line_hash

from .conftest import long_text

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=20, docs=3):
    """rows: (doc_id, text); each row is a document."""
    held, top = defaultdict(int), {}
    split = [[(x, x.strip(SPACE).translate(LOWER)) for x in (t or "").split("\n")] for _, t in rows]
    for (ident, _), lines in zip(rows, split):
        for k in {k for _, k in lines if len(k) >= least}:
            held[k] += 1
            top[k] = max((x for x in (top.get(k), ident) if x is not None), default=None)
    out = []
    for (ident, text), lines in zip(rows, split):
        stays = [x for x, k in lines if not (held.get(k, 0) >= docs and top[k] != ident)]
        out.append((ident, None if text is None else "\n".join(stays), len(lines), len(lines) - len(stays)))
    return sorted(out, key=str)


def got(out):
    return sorted([(r.row.doc_id, r.row.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str)


def planted():
    line = "This line of a licence stands in very many documents."
    rows = [(i, f"own text of document number {i}\n  {line.upper() if i % 3 else line}\t\n\nshort line\n{'x' * (i % 30)}") for i in range(120)]
    rows += [(200 + i, f"Seen in {2 + i % 2} documents, group {i // 3:05d} of them") for i in range(30)]
    rows += [(300 + i, f"twice in here, {i // 2:09d}\ntwice in here, {i // 2:09d}\nend") for i in range(20)]
    return rows


@pytest.mark.parametrize("batches,fan", [(1, 3), (6, 3), (9, 2)])
def test_against_brute(spark, make_docs, batches, fan):
    rows = planted()
    assert got(drop_worn_lines(make_docs(rows), batches=batches, fan=fan)) == brute(rows)


def test_odd_rows(spark, make_docs, odd_rows):
    text = "\n".join(["a line that is the same everywhere", "É Ü ß und noch mehr davon", " " * 30, long_text(2000)])
    rows = [r[:2] for r in odd_rows] + [(50, text), (50, text), (51, text.lower()), (52, text + "\n"), (None, text), (53, "\n\n")]
    docs = make_docs(rows)
    out = drop_worn_lines(docs)
    assert got(out) == brute(rows)
    assert out.select("row.*").columns == docs.columns
    assert {r["a.b"] for r in out.select("row.*").collect()} == {"dot"}


def test_many_lines_and_empty(spark, make_docs):
    lines = [f"the same line in three documents {i}" for i in range(5000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "\n".join(lines + ["own"] * 5000)), (4, None)]
    assert got(drop_worn_lines(make_docs(rows))) == brute(rows)
    assert drop_worn_lines(make_docs([])).count() == 0


def test_null_ids_only(spark, make_docs):
    rows = [(None, "the same line without any id")] * 4
    assert got(drop_worn_lines(make_docs(rows))) == brute(rows)


def test_runs_are_levelled(spark):
    """A batch keeps what no run has; runs are compacted when a level is full, with no exchange in the anti-joins."""
    store = LineRuns(spark, buckets=4, fan=2)
    seen = set()
    for k in range(5):
        part = spark.range(k * 50, k * 50 + 100).select(F.col("id").cast("string").alias("line")).select("line", *line_hash(F.col("line")))
        name = store.save(part)
        fresh = store.add(spark.table(name))
        now = {str(i) for i in range(k * 50, k * 50 + 100)}
        assert {r.line for r in fresh.collect()} == now - seen
        seen |= now
        store.compact()
        store.drop(name)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    name = store.save(part)
    plan = store.fresh(spark.table(name))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 2 and "Exchange" not in plan
    assert sum(t.count() for t in store.runs()) == len(seen)
    store.drop(name, *[n for level in store.levels for n in level])
    assert not store.paths


def test_hash_is_wide(spark):
    h1, h2 = spark.createDataFrame([("a",)], "k string").select(*line_hash(F.col("k"))).first()
    assert h1 != h2

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm.queries import ORACLES, QUERIES
from postlens.llm.quality import fit_quality, judge

from .conftest import ROOT
from .test_mixing import reshared
from .test_near_copies import brute


def test_stages_by_hand(spark, given, tmp_path):
    docs, rows = given
    columns = docs.columns
    text = {r["doc_id"]: r["text"] for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    trees = fit_quality(docs, spark.read.parquet(f"{ROOT}/labels.parquet"))
    kept = [r[0] for r in judge(docs, trees, carry=["doc_id"]).filter("kept").select("row.doc_id").collect()]
    by_text = {}
    for i in sorted(kept):
        by_text[text[i] or ""] = i
    exact = sorted(by_text.values())
    near = brute([(i, text[i]) for i in exact])
    expected = [kept, exact, near]

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding"]
    at = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, ROOT)
        out.write.parquet(f"{tmp_path}/{number}")
        at = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert at.columns == columns
        if number < 3:
            assert sorted(r[0] for r in at.select("doc_id").collect()) == sorted(expected[number])
        if number == 3:
            copies = {r[0]: r[1] for r in at.groupBy("doc_id").count().collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i] or "")) for i in near}
    sums, largest, taken = {}, {}, {}
    for i in near:
        s = source[i]
        sums[s], largest[s] = sums.get(s, 0) + size[i], max(largest.get(s, 0), size[i])
        taken[s] = taken.get(s, 0) + size[i] * copies.get(i, 0)
    for s, target in reshared(sums, (3, 1, 2)).items():
        assert abs(taken[s] - target) <= largest[s]
    assert set(copies) <= set(near) and max(copies.values()) <= 2

    import sentencepiece

    from postlens.llm.byte_bpe import vocabulary_path

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    final = at.collect()
    assert len(final) == sum(copies.values()) and all(r.round_trip and r.ids == library.encode(text[r.doc_id] or "") for r in final)


def test_run_agrees_with_itself(spark):
    one = corpus_pipeline.run(spark, ROOT).groupBy("doc_id", "n_tokens").count().collect()
    two = corpus_pipeline.run(spark, ROOT).groupBy("doc_id", "n_tokens").count().collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_stages_on_odd_rows(spark, make_docs, odd_rows, tmp_path):
    names = ["doc_id", "text", "lang", "source", "row", "body", "kept"]
    for k, rows in enumerate((odd_rows, [])):
        at = make_docs(rows).select(*names, F.length("text").cast("long").alias("n_chars"))
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, ROOT)
            if number < 4:
                assert out.columns == at.columns
            out.write.parquet(f"{tmp_path}/{k}-{number}")
            at = spark.read.parquet(f"{tmp_path}/{k}-{number}")
        assert (at.count() == 0) == (not rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, ROOT)
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(expected.select(*columns).fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert np.all([callable(f) for f in QUERIES.values()])

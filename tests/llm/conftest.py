import pytest
from pyspark.sql import types as T

ROOT = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # Names that operators use themselves.
    T.StructField("row", T.StringType()), T.StructField("body", T.LongType()), T.StructField("ident", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("a.b", T.StringType()),
])


def long_text(n=30_000):
    return " ".join(f"word{i * 7919 % 1000003}" for i in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Rows (doc_id, text) or (doc_id, text, lang, source), with extra columns that clash."""
        full = [(*r, *([None, None] if len(r) == 2 else []), "r", 5, "i", "k", "s", "f", "n", "dot") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    text = "The quick brown fox jumps over the lazy dog, and then it runs away from all of them. " * 3
    return [
        (1, text, "en", "a"), (2, text, "en", None), (2, text, "en", None), (3, text + "x", None, "a"), (4, None, "en", "b"), (5, "", None, None), (6, " \n\t ", "de", "b"),
        (None, text, "en", "a"), (None, None, None, None), (7, long_text(), "en", "b"), (8, "a", "fr", "c"), (9, "1 2 3 ** ##", "fr", "c"), (10, "é ü ß 日本語 🙂\n\nzwei  Leerzeichen", "de", "c"), (11, "line\nline\nline\n", "en", "a"),
    ]


@pytest.fixture(scope="session")
def given(spark):
    """The documents of the smallest test table, as Spark and as a list."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    return docs, [r.asDict() for r in docs.collect()]

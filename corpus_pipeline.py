"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.byte_bpe import vocabulary_path
from postlens.llm.common import n_words, table
from postlens.llm.exact_dedup import exact_dedup
from postlens.llm.mixing import mix_to_targets
from postlens.llm.near_copies import drop_near_copies
from postlens.llm.piece_text import encode_pieces
from postlens.llm.quality import fit_quality, quality_filter
from postlens.session import remove_path, scratch_path


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees, fitted on the given labels, both keep."""
    return quality_filter(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id."""
    return exact_dedup(docs, keep="largest")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8), the one with the smallest id: SimHash links, made whole by prefix keys."""
    return drop_near_copies(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for; one not taken goes."""
    return mix_to_targets(docs, n_words(F.col("text")))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, repeats included."""
    made = encode_pieces(docs, vocabulary_path("piece_bpe_32k.model"), carry=["doc_id", "source"])
    return made.select("row.doc_id", "row.source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality rules", stage_quality),
    ("exact dedup", stage_exact),
    ("SimHash near-dedup", stage_near),
    ("mixing sources to target weights", stage_mix),
    ("SentencePiece encoding", stage_encode),
]

# Boosted trees, seeded rounding and subword encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's table goes when the next one's is written; the last one's input stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{number}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs

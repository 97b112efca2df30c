"""The registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .byte_bpe import encoder_of, vocabulary_path
from .chat import BLOCK, format_chats
from .common import n_words, table
from .exact_dedup import content_sort
from .language import identify, learn_profiles
from .line_runs import drop_worn_lines
from .merkle import leaf_rows, prove, write_manifest
from .mixing import mix_plan
from .piece_text import encode_pieces
from .quality import COUNTS, fit_quality, judge
from .records import read_records, write_records
from .simhash import near_duplicates
from .spelling import count_words, spelling_variants
from .suffix_dedup import suffix_dedup
from .token_files import count_tokens, write_flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_exact_dedup", """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group of equal texts that stays: the largest doc_id."""
    rows = content_sort(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return rows.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op7_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mix_plan(docs, n_words(F.col("text")))
    each = plan.select("ident", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return each.select(F.col("ident").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


@query("op1_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; profiles come from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    profiles = learn_profiles(docs.filter(~held_out))
    named = identify(docs, profiles, carry=["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge(docs, trees, carry=["doc_id"]).select("row.doc_id", *COUNTS, "base_failed", "kept", "good")


@query("op8_chat_format", f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER same AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)), chr(3)) OVER (same ROWS UNBOUNDED PRECEDING) AS so_far
  FROM turns WINDOW same AS (PARTITION BY conv_id ORDER BY turn, role, text)),
ends AS (SELECT so_far, min(conv_id) AS conv_id FROM placed WHERE pos = n GROUP BY so_far),
maximal AS (SELECT conv_id FROM ends WHERE so_far NOT IN (SELECT so_far FROM placed WHERE pos < n))
SELECT conv_id, CAST(floor((pos - 1) / {BLOCK}) AS INTEGER) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || regexp_replace(coalesce(text, ''), '<\\|im_(start|end)\\|>', '<| im_\\1 |>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed SEMI JOIN maximal USING (conv_id) GROUP BY 1, 2
""")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation as rendered text."""
    return format_chats(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


@query("op9_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("ident").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = encode_pieces(docs, vocabulary_path("piece_bpe_32k.model"), carry=["doc_id"])
    return made.select("row.doc_id", "n_tokens", "ids", "round_trip")


def _byte_bpe(path: str, special: bool):
    return lambda: encoder_of(path, special)


@query("op5_binary_records")
def binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as read back from the record files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "records")
    manifest = write_records(docs, folder, _byte_bpe(vocabulary_path("byte_bpe_50k.json"), special=True), vocabulary=50_257, end_id=0)
    return read_records(manifest, folder).withColumnRenamed("ident", "doc_id")


@query("op10_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files by their separators.

    The separator's string in a text is encoded as plain text, unlike in op5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "tokens")
    end = 50_256
    order = write_flat(docs, folder, _byte_bpe(vocabulary_path("byte_bpe_50k.json"), special=False), separator=end, width=2)
    counts = count_tokens(order.filter("ordinal = -1").select("name", "n_bytes"), folder, separator=end, width=2)
    named = order.filter("ordinal >= 0").select("name", "ordinal", F.col("ident").alias("doc_id"))
    # The table's file is small for its rows, and would be broadcast on that ground.
    return named.hint("merge").join(counts, ["name", "ordinal"]).select("doc_id", "n_tokens")


@query("op6_suffix_array")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that occur elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).withColumnRenamed("ident", "doc_id")


@query("op11_merkle_manifest")
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof, and whether the leaf found later still folds to the root.

    Line ends are deleted from the texts of documents whose id has an even CRC.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")

    def tamper(rows: DataFrame):
        return F.crc32(rows["doc_id"].cast("string").cast("binary")) % 2 == 0, {"text": F.replace(rows["text"], F.lit("\n"), F.lit(""))}

    manifest = write_manifest(leaf_rows(docs, "source", "doc_id", docs.columns, tamper), scratch_path(spark, "manifest"))
    return prove(manifest).withColumnRenamed("ident", "doc_id")


@query("op13_line_dedup", """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
worn AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (top IS NULL OR doc_id = top), '')) AS kept_sha256
FROM keyed LEFT JOIN worn USING (k) GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that stand in three or more, but for the largest doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256)
    return drop_worn_lines(docs).select("row.doc_id", "n_lines", "n_dropped", left.alias("kept_sha256"))


def _strike(ident: int | None, word: str) -> str:
    """One letter less in one of 97 words of a document."""
    h = zlib.crc32(f"{ident}:{word}".encode())
    at = h % len(word)
    return word if h % 97 else word[:at] + word[at + 1 :]


@query("op12_spelling_variants")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with the more frequent word that it is a variant of."""
    return spelling_variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), alter=_strike))

"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's multiset of letters is a binary vector: one bit for the first a, one for the second,
and so on.  Inserting or deleting a letter changes one bit, replacing one by another two.  So
vectors of words of one edit are at most two bits apart, and PartEnum finds all such pairs by
equality: the bits are partitioned, and every way to leave out as many parts as bits may
differ gives a signature of what remains; two vectors that close agree in one at least.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import pieces_of

LETTERS = re.compile("[a-zÀ-ÿ]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", alter: Callable[[int | None, str], str] | None = None, held: int = 200_000) -> DataFrame:
    """word and n of the maximal runs of letters, A-Z in lower case.

    ``alter`` makes another word of a document's key and one of its words.  A task folds its words before
    they are shuffled, ``held`` distinct ones at a time, so a word that is everywhere is one
    row a task.  A null text has no word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for part in pieces_of(batches, 1, 8 << 20):
            for ident, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                # bytes.lower() touches A-Z only
                for word, n in Counter(LETTERS.findall(body.encode().lower().decode())).items() if body else ():
                    word = alter(ident, word) if alter else word
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > held:
                    yield flush()
        if counts:
            yield flush()

    named = docs.select(docs[f"`{key}`"].cast("long").alias("ident"), docs[f"`{text}`"].cast("string").alias("body"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scatter(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_bits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of the bit) of every bit that is set."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(words)), lengths)
    codes = codes[np.lexsort((codes, row))]
    at = np.arange(len(codes))
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return row, scatter((codes << np.uint64(32) | nth.astype(np.uint64)) + _GOLD)


def part_enum(row: np.ndarray, bits: np.ndarray, count: int, distance: int, first: int, second: int) -> np.ndarray:
    """Signatures, one column each, of ``count`` vectors for a Hamming distance of up to ``distance``.

    Bits are dealt to ``first`` partitions, in one of which no more than ``leave`` bits can
    differ, and there to ``second`` parts; each choice of ``leave`` parts to leave out makes a
    signature.  Vectors are added up, so a signature is the partition's sum less the parts'.
    """
    leave = -(-(distance + 1) // first) - 1
    sums = np.zeros((count, first * second), np.uint64)
    np.add.at(sums, (row, (scatter(bits ^ _GOLD) % np.uint64(first * second)).astype(np.int64)), bits)
    made = []
    for p in range(first):
        own = sums[:, p * second : (p + 1) * second]
        whole = own.sum(1, dtype=np.uint64)
        for choice in combinations(range(second), leave):
            name = scatter(np.array([zlib.crc32(repr((p, choice, distance)).encode())], np.uint64))
            made.append(scatter((whole - own[:, choice].sum(1, dtype=np.uint64)) ^ name))
    return np.stack(made, 1)


def signature_rows(words: DataFrame, parts: tuple[int, int] = (1, 6), parts_one: tuple[int, int] = (1, 4)) -> DataFrame:
    """sig, role, word, head, tail: the signatures of every word.

    Role 0 is for a letter replaced (same length, distance two), 1 and 2 for the shorter and the longer
    word of a letter inserted (distance one); the shorter length is part of the signature.
    ``head`` and ``tail`` are hashes of the halves by that length, one of which an edit leaves alone.
    """

    def half(w: str, length: int) -> tuple[int, int]:
        m = length // 2
        return zlib.crc32(w[:m].encode()), zlib.crc32(w[len(w) - (length - m) :].encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                column = batch.column(0)[at : at + 4096]
                words = column.to_pylist()
                row, bits = letter_bits(words)
                size = np.array([len(w) for w in words], np.uint64)
                two = part_enum(row, bits, len(words), 2, *parts)
                one = part_enum(row, bits, len(words), 1, *parts_one)
                for role, sigs, length in ((0, two, size), (1, one, size), (2, one, size - np.uint64(1))):
                    sigs = scatter(sigs ^ scatter(length * _GOLD)[:, None])
                    halves = np.array([half(w, int(k)) for w, k in zip(words, length)], np.uint32).view(np.int32)
                    each = np.repeat(np.arange(len(words)), sigs.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.ravel().view(np.int64)), pa.array(np.full(len(each), role, np.int8)), column.take(pa.array(each)), pa.array(halves[each, 0]), pa.array(halves[each, 1])],
                                                     names=["sig", "role", "word", "head", "tail"])

    return words.select("word").mapInArrow(run, "sig long, role tinyint, word string, head int, tail int")


def near_words(words: DataFrame, **options) -> DataFrame:
    """src, dst: every pair of words exactly one insertion, deletion or replacement apart, once.

    Signatures are equi-joined; a pair that meets is compared by halves, then in full.
    """
    rows = signature_rows(words, **options)
    a, b = rows.alias("a"), rows.alias("b")
    roles = ((F.col("a.role") == 0) & (F.col("b.role") == 0) & (F.col("a.word") < F.col("b.word"))) | ((F.col("a.role") == 1) & (F.col("b.role") == 2))
    halves = (F.col("a.head") == F.col("b.head")) | (F.col("a.tail") == F.col("b.tail"))
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & roles & halves & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("src"), F.col("b.word").alias("dst")).distinct()


def follow(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain word -> form -> form ..., by doubling the steps.

    A form has at least twice the count of its word, so there are no cycles, a chain is no
    longer than the logarithm of the largest count, and rounds go with the logarithm of that.
    """
    at = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return at


def spelling_variants(counts: DataFrame, min_chars: int = 5, min_count: int = 3, factor: int = 2, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with enough characters and occurrences.

    ``counts`` has word (distinct, not null) and n.  ``form`` is the near word of the largest n, the first in code-point order
    of several, if that n is at least ``factor`` (2 or more) times the word's; else null.  ``root`` is where
    the forms lead, the word itself if it has none.  An empty table gives an empty result.
    """
    words = cut_lineage(counts.select("word", "n").filter((F.col("n") >= min_count) & (F.char_length("word") >= min_chars)))
    pairs = near_words(words, **options).select(F.explode(F.array(F.struct(F.col("src").alias("word"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("word"), F.col("src").alias("other")))).alias("p")).select("p.*")
    sized = pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = sized.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    good = -F.col("best.m") >= F.col("n") * factor
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
    judged = cut_lineage(judged)
    roots = follow(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

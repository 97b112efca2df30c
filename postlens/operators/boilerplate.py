"""Text that a company repeats across its postings."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalized

# Fixed values of the detector and the remover.
CHUNK, STEP, MIN_CHUNK = 150, 75, 50
MIN_DOCS, MIN_SHARE = 3, 0.40
MIN_WORDS, ANCHOR_WORDS, MARGIN = 5, 8, 50
TITLE_CHARS, TEXT_CHARS = 200, 2500
SEPARATOR = "\0"  # between listed chunks


def chunks(text: Column) -> Column:
    """Distinct normalised half-overlapping chunks of one text."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    cut = F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(CHUNK))), lambda c: F.length(c) >= STEP)
    return F.array_distinct(F.filter(F.transform(cut, normalized), lambda c: F.length(c) >= MIN_CHUNK))


def find_boilerplate(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, chunk, docs): chunks in at least max(2, 40%) of a group of three or more.

    A text yields each chunk once, so a plain count is a document count and is
    pre-aggregated before the shuffle however large the group is.
    """
    slim = df.select(group, text)
    sizes = slim.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_DOCS)
    counts = slim.select(group, F.explode(chunks(F.col(text))).alias("chunk")).groupBy(group, "chunk").agg(F.count(F.lit(1)).alias("docs"))
    needed = F.greatest(F.lit(2), F.floor(F.col("_n") * MIN_SHARE))
    return counts.filter(F.col("docs") >= 2).join(sizes, group).filter(F.col("docs") >= needed).drop("_n")


def _anchors(found: str) -> list[tuple[str, int]]:
    """(anchor, characters to cut) of chunks listed one after another."""
    return [(" ".join(words), len(chunk) + MARGIN) for chunk in found.split(SEPARATOR) if (words := chunk.split()[:ANCHOR_WORDS])]


def _mask(text: str | None, anchors: list[tuple[str, int]]) -> str:
    """Cut the spans that start at an anchor of a repeated chunk; a text without an anchor stays as it is."""
    low = (text or "").lower()
    words = low.split() if anchors else []
    flat = " ".join(words)
    found = []
    for anchor, length in anchors:
        at = flat.find(anchor)
        while at >= 0:
            found.append((at, length))
            at = flat.find(anchor, at + len(anchor))
    if not found:
        return text or ""
    if len(flat) != len(low):  # back to places in the text, whose words are wider apart
        starts = [m.start() for m in re.finditer(r"\S+", low)]
        firsts = [0, *accumulate(len(w) + 1 for w in words[:-1])]
        found = [(starts[w] + at - firsts[w], length) for at, length in found for w in [bisect_right(firsts, at) - 1]]
    kept, at = [], 0
    for start, length in sorted(found):
        kept.append(text[at:max(at, start)])
        at = max(at, start + length)
    return " ".join(("".join(kept) + text[at:]).split())


@F.pandas_udf(T.StringType())
def _mask_spans(text: pd.Series, found: pd.Series) -> pd.Series:
    out, held, anchors = [], "", []
    for t, f in zip(text, found):
        if f != held:  # rows of a group come together as a rule
            held, anchors = f, _anchors(f)
        out.append(_mask(t, anchors))
    return pd.Series(out, dtype=object)


def strip_boilerplate(df: DataFrame, boilerplate: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """Remove repeated chunks from each text; adds ``stripped_text``.

    Each text meets its group's chunks as one list.  As each of them stands in a fixed share of the group's
    texts, the list is no longer than a few average texts of the group, and the work grows with the texts.
    """
    listed = boilerplate.filter(F.size(F.split("chunk", " ")) >= MIN_WORDS).groupBy(group).agg(F.array_join(F.collect_set("chunk"), SEPARATOR).alias("_found"))
    joined = df.join(listed, group, "left").withColumn("stripped_text", _mask_spans(F.col(text), F.coalesce("_found", F.lit(""))))
    return joined.select(key, *[c for c in df.columns if c != key], "stripped_text")


def build_text(title: Column, stripped: Column, budget: int = TEXT_CHARS) -> Column:
    """Title plus text within one character budget."""
    head = F.substring(F.coalesce(title, F.lit("")), 1, TITLE_CHARS)
    body = F.substring(F.coalesce(stripped, F.lit("")), F.lit(1), F.lit(budget) - F.length(head) - 2)
    return F.concat(head, F.lit(". "), body)

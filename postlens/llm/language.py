"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_text, pieces_of

UNKNOWN = "und"


@dataclass
class Profiles:
    """rank[i, j]: place of gram i in the profile of language j, ``size`` if it is not there."""

    languages: list[str]
    grams: np.ndarray
    rank: np.ndarray
    size: int


def letters(text: Column) -> Column:
    """Lower-case letters; any run of other characters is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _grams(text: str) -> np.ndarray:
    """Packed 1- to 3-grams of the letters, with word edges as a space; no gram spans two words."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = points == 32
    shift = np.uint64(21)
    two = (points[:-1] << shift) | points[1:]
    three = (two[:-1] << shift) | points[2:]
    return np.concatenate([points[~edge], two, three[~edge[1:-1]]])


def _count(text: str, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts; a very long text is counted in parts cut at spaces."""
    if len(text) <= step:
        return np.unique(_grams(text), return_counts=True)
    at, parts = 0, []
    while at < len(text):
        stop = text.find(" ", at + step)
        stop = len(text) if stop < 0 else stop
        parts.append(np.unique(_grams(text[at:stop]), return_counts=True))
        at = stop + 1
    return _merge(parts)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400, held: int = 1 << 20) -> Profiles:
    """The ``size`` most frequent grams of each language over all the given documents.

    Tasks add up counts per language and pass them on when they hold ``held`` grams; Spark
    sums them, and only the profiles (``size`` rows a language) come to the driver.  Ties go
    to the smaller gram.  Rows without text or language teach nothing.
    """
    known = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), letters(F.col(f"`{text}`")).alias("body")).filter("lang is not null and body <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in sums.items():
                grams, counts = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
            sums.clear()

        for part in pieces_of(batches, 1, 4 << 20):
            names, bodies = np.array(part.column(0).to_pylist(), object), part.column(1).to_pylist()
            for name in set(names):
                sums.setdefault(name, []).append(_merge([_count(bodies[i]) for i in np.flatnonzero(names == name)]))
                if len(sums[name]) > 8:
                    sums[name] = [_merge(sums[name])]
            if sum(len(g) for parts in sums.values() for g, _ in parts) > held:
                yield from out()
        yield from out()

    counted = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size).toPandas()
    languages = sorted(top["lang"].unique())
    grams = np.unique(top["gram"].to_numpy(np.int64).view(np.uint64))
    rank = np.full((len(grams), len(languages)), size, np.int64)
    if len(top):
        rank[np.searchsorted(grams, top["gram"].to_numpy(np.int64).view(np.uint64)), [languages.index(x) for x in top["lang"]]] = top["place"].to_numpy() - 1
    return Profiles(languages, grams, rank, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", carry: list[str] | None = None, top: int = 400) -> DataFrame:
    """row, lang_pred, score for every document.

    The ``top`` most frequent grams of the whole text are compared with each profile: a gram
    costs the distance of its two places, and the profile's size if it is not there.  The
    smallest sum wins, ties go to the language first in order; the score is one minus that
    sum over the largest possible.  A text that is null or has no letter, or any text where
    nothing was learned, is ``und`` with score 0.
    """

    def make():
        def run(texts: pa.Array) -> list:
            names, scores = [], []
            for body in texts.to_pylist():
                if not body or not profiles.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                grams, counts = _count(body)
                first = grams[np.lexsort((grams, -counts))[:top]]
                at = np.minimum(np.searchsorted(profiles.grams, first), len(profiles.grams) - 1)
                rank = np.where((profiles.grams[at] == first)[:, None], profiles.rank[at], profiles.size)
                place = np.arange(len(first))[:, None]
                cost = np.where(rank < profiles.size, np.minimum(np.abs(rank - place), profiles.size), profiles.size).sum(0)
                names.append(profiles.languages[int(cost.argmin())])
                scores.append(1 - float(cost.min()) / (profiles.size * len(first)))
            return [names, scores]

        return run

    return map_text(docs, make, "lang_pred string, score double", letters(F.col(f"`{text}`")), carry)

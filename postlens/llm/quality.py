"""Quality rules: base rules, then boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import map_text

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# What the trees see, and how the chance of being good may move with each.
FEATURES: dict[str, int] = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_a_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "digit_share": 0,
    "capital_share": 0,
    "distinct_share": 0,
    "short_word_share": 0,
    "words_a_line": 0,
}
MONOTONE = tuple(FEATURES.values())
_DIGITS, _CAPITALS = b"0123456789", bytes(range(65, 91))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of one whole text."""
    if not text:
        return [0] * 5, [0.0] * len(FEATURES)
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    dense = data.translate(None, WHITE)
    symbols = len(dense) - len(dense.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    dup_lines = len(lines) - len(set(lines))
    hashed = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    repeated = 0
    if n > 3:
        windows = hashed[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[2:] * np.uint64(0x165667B19E3779F9)
        ordered = windows.argsort()
        same = windows[ordered[1:]] == windows[ordered[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[ordered[1:][same]] = twice[ordered[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    size = max(1, len(dense))
    counts = [n, len(text) - (len(data) - len(dense)), symbols, dup_lines, repeated]
    if n == 0:
        return counts, [0.0] * len(FEATURES)
    return counts, [
        float(np.log1p(n)), counts[1] / n, symbols / n, dup_lines / max(1, len(lines)), repeated / n,
        (size - len(dense.translate(None, _DIGITS))) / size, (size - len(dense.translate(None, _CAPITALS))) / size,
        len(np.unique(hashed)) / n, sum(len(w) < 4 for w in words) / n, n / max(1, len(lines)),
    ]


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, text: str = "text", key: str = "doc_id", label: str = "quality", **options) -> Trees | None:
    """Trees fitted on at most ``max_rows`` labelled documents, those first by a hash of their id.

    That bound is what lets the sample go to the driver.  None if the labels do not hold both
    classes.
    """
    sample = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    known = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(sample), "k")
    made = map_text(known, _features, "x array<double>", "t", ["k", "y"])
    rows = made.select("row.k", "row.y", "x").orderBy(F.xxhash64("k"), "k", "x").limit(max_rows).toPandas()
    if rows["y"].nunique() < 2:
        return None
    return fit(np.stack(rows["x"].to_list()), (rows["y"].to_numpy() > 0).astype(float), MONOTONE, **options)


def _features():
    return lambda texts: [[statistics(t)[1] for t in texts.to_pylist()]]


def judge(docs: DataFrame, trees: Trees | None, text: str = "text", carry: list[str] | None = None, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """row, the five counts, base_failed, good (probability), kept, for every document.

    A null or empty text has no words and fails the base rules.  Without trees (no usable
    labels) the base rules alone decide.  Nothing depends on ids, so repeated rows get the
    same verdict; extra columns ride along inside ``row``.
    """

    def make():
        def run(texts: pa.Array) -> list:
            found = [statistics(t) for t in texts.to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, 5)
            x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            good = trees.probability(x) if trees is not None else np.ones(len(x))
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
            return [*counts.T, failed, good, ~failed & (good >= threshold)]

        return run

    return map_text(docs, make, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, good double, kept boolean", text, carry)


def quality_filter(docs: DataFrame, trees: Trees | None, text: str = "text", **options) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    return judge(docs, trees, text, **options).filter("kept").select("row.*")

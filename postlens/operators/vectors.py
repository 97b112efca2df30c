"""Vectors and block-wise scoring: every left row against every right row, top k kept.

Scoring all pairs is the definition of exact search, so the work is a product;
what must not happen is materialising it.  Both sides are hashed into blocks of
bounded size, each task holds one (left block, right block) cell as matrices,
and only k rows per left row leave it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .relational import top_per_group

LEFT_BLOCK, RIGHT_BLOCK = 4_096, 8_192


def block_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
               left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK) -> DataFrame:
    """Apply ``fn`` to every cell of the block grid; right rows arrive in key order."""
    left, right = cut_lineage(left), cut_lineage(right)  # counted and then read: what is above runs once
    n_left = max(1, math.ceil(left.count() / left_block))
    n_right = max(1, math.ceil(right.count() / right_block))

    def own(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = left.withColumn("_lb", own(left_key, n_left)).withColumn("_rb", every(n_right))
    b = right.withColumn("_rb", own(right_key, n_right)).withColumn("_lb", every(n_left))
    empty = schema_columns(schema)

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if len(x) == 0 or len(y) == 0:
            return pd.DataFrame({c: [] for c in empty})
        return fn(x, y.sort_values(right_key, ignore_index=True))

    return a.groupBy("_lb", "_rb").cogroup(b.groupBy("_lb", "_rb")).applyInPandas(cell, schema)


def schema_columns(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def top_indexes(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns per row; of equal scores the first columns.

    Exactly k per row, so a group of identical items does not multiply the output.
    """
    k = min(k, score.shape[1])
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
    above, level = score > edge, score == edge
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def knn(queries: DataFrame, corpus: DataFrame, k: int, prefilter: int | None = None, eligible: DataFrame | None = None,
        query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector") -> DataFrame:
    """Exact cosine neighbours: (query_id, item_id, similarity, place).

    With ``prefilter`` the best that many are found first, then cut to
    ``eligible`` items, then to ``k``.
    """
    wide = prefilter or k

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        # Nine digits: products may differ in the last bits between block shapes.
        sim = np.round(unit_rows(q[vector]) @ unit_rows(c[vector]).T, 9)
        rows, cols = top_indexes(sim, wide)
        return pd.DataFrame({"query_id": q[query_id].to_numpy()[rows], "item_id": c[item_id].to_numpy()[cols], "similarity": sim[rows, cols]})

    kinds = dict(queries.dtypes)[query_id], dict(corpus.dtypes)[item_id]
    found = block_join(queries.select(query_id, vector), corpus.filter(F.col(vector).isNotNull()).select(item_id, vector), query_id, item_id, score,
                       f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double")
    order = [F.col("similarity").desc(), F.col("item_id")]
    best = top_per_group(found, ["query_id"], order, wide, rank_as="place")
    if eligible is None and wide == k:
        return best
    allowed = best.drop("place") if eligible is None else best.drop("place").join(eligible.select(F.col(item_id).alias("item_id")), "item_id", "left_semi")
    return top_per_group(allowed, ["query_id"], order, k, rank_as="place")


def sign_codes(df: DataFrame, key: str, vector: str, bits: int, seed: int) -> DataFrame:
    """key, vector (as doubles, unit length) and code_0..: the signs of ``bits`` random projections, 64 to a long."""
    words = bits // 64

    def run(frames):
        plane = None
        for frame in frames:
            if frame.empty:
                continue
            unit = unit_rows(frame["vector"])
            if plane is None:
                plane = np.random.default_rng(seed).standard_normal((unit.shape[1], bits))
            codes = np.packbits(unit @ plane > 0, axis=1).view(np.int64)
            yield pd.DataFrame({key: frame[key], "vector": list(unit), **{f"code_{i}": codes[:, i] for i in range(words)}})

    kind = dict(df.dtypes)[key]
    rows = df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInPandas(run, f"{key} {kind}, vector array<double>, " + ", ".join(f"code_{i} long" for i in range(words)))


def ann_candidates(queries: DataFrame, corpus: DataFrame, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector",
                   share: float = 0.10, least: int = 100, bits: int = 1024, seed: int = 7, block: int = 256, slice_rows: int = 200_000) -> DataFrame:
    """(query_id, item_id, similarity) of the items nearest by binary code, at most ``share`` of all for each query
    (of ``least`` items, where the corpus is small).

    Vectors are projected on random directions and cut to signs, so the bits in which two codes
    differ grow with the angle; that needs no structure in the vectors.  Every item is ranked
    by an XOR and a bit count in generated code.  Counting how many items lie at each distance
    (``bits`` + 1 numbers a query) gives the distance to stop at; only items up to there are
    scored exactly.  Queries come in blocks and items in slices, so a task sees one of each.
    """
    words = range(bits // 64)
    q = cut_lineage(sign_codes(queries, query_id, vector, bits, seed).withColumnsRenamed({query_id: "query_id", "vector": "_q", **{f"code_{i}": f"_q{i}" for i in words}}))
    c = cut_lineage(sign_codes(corpus, item_id, vector, bits, seed).withColumnsRenamed({item_id: "item_id", "vector": "_c", **{f"code_{i}": f"_c{i}" for i in words}}))
    total = c.count()
    blocks, slices = max(1, math.ceil(q.count() / block)), max(1, math.ceil(total / slice_rows))
    q = q.withColumns({"_b": F.pmod(F.xxhash64("query_id"), F.lit(blocks)), "_s": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})
    c = c.withColumns({"_s": F.pmod(F.xxhash64("item_id"), F.lit(slices)), "_b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    apart = sum((F.bit_count(F.col(f"_q{i}").bitwiseXOR(F.col(f"_c{i}"))) for i in words), F.lit(0))
    seen = c.drop("_c").join(q.drop("_q"), ["_b", "_s"]).groupBy("query_id", apart.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("d"))  # bits + 1 rows a query
    ends = seen.withColumn("upto", upto).filter(F.col("upto") <= max(total * share, least)).groupBy("query_id").agg(F.max("d").alias("_end"))
    near = c.join(q.join(ends, "query_id"), ["_b", "_s"]).filter(apart <= F.col("_end"))
    dot = F.aggregate(F.zip_with("_q", "_c", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return near.select("query_id", "item_id", F.round(dot, 9).alias("similarity"))


def ann(queries: DataFrame, corpus: DataFrame, k: int, **options) -> DataFrame:
    """Approximate cosine neighbours: (query_id, item_id, similarity, place), the best ``k`` of ``ann_candidates``."""
    return top_per_group(ann_candidates(queries, corpus, **options), ["query_id"], [F.col("similarity").desc(), F.col("item_id")], k, rank_as="place")


def embed(df: DataFrame, key: str, text: str, done: DataFrame, dims: int = 256) -> DataFrame:
    """Vectors for rows that have none yet: hashed token counts of unit length.

    A stand-in encoder with the interface of a real one; swap the two stages.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import words

    todo = df.join(done.select(key), key, "left_anti").select(key, words(F.col(text)).alias("_w"))
    stages = [HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims), Normalizer(inputCol="_tf", outputCol="_u")]
    out = Pipeline(stages=stages).fit(todo).transform(todo)
    return out.select(key, F.transform(vector_to_array("_u"), lambda x: x.cast("float")).alias("vector"))


class HashedTokens:
    """A stand-in encoder: counts of a text's tokens by the first digits of their MD5."""

    def __init__(self, dims: int = 256, token: str = "[a-z0-9]+"):
        self.dims, self.token = dims, token

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        import hashlib
        import re

        token, dims = re.compile(self.token), self.dims

        class Slots(dict):
            def __missing__(self, w: str) -> int:
                slot = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims
                if len(self) < 100_000:
                    self[w] = slot
                return slot

        slots = Slots()

        def encode(texts: np.ndarray) -> np.ndarray:
            places, counts = [], []
            for text in texts:
                words = token.findall((text or "").lower())
                places += map(slots.__getitem__, words)
                counts.append(len(words))
            cells = np.repeat(np.arange(len(texts)) * dims, counts) + np.array(places, np.int64)
            return np.bincount(cells, minlength=len(texts) * dims).reshape(-1, dims).astype(np.float32)

        return encode


def unit_encoder(encoder: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The encoder with its rows brought to length one; a row of zeroes stays so."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        encode = encoder()

        def run(texts: np.ndarray) -> np.ndarray:
            rows = np.asarray(encode(texts), np.float32)
            norm = np.sqrt((rows * rows).sum(1, dtype=np.float64, keepdims=True))
            return np.divide(rows, norm, out=rows.astype(np.float64), where=norm > 0).astype(np.float32)

        return run

    return make


_encoders: dict[str, Callable[[np.ndarray], np.ndarray]] = {}  # a worker's, by the id of the call


def encode_texts(df: DataFrame, text: str, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "vector", batch: int = 256, unit: bool = True) -> DataFrame:
    """Vectors by batch inference: ``encoder`` is called once a worker and gives a function from a batch of texts to rows of numbers.

    A null text is encoded like an empty one; a row of zeroes stays so.
    """
    name, make = uuid.uuid4().hex, unit_encoder(encoder) if unit else encoder

    @F.arrow_udf("array<float>")
    def infer(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _encoders:
            _encoders[name] = make()
        for part in texts:
            rows = [np.asarray(_encoders[name](part.slice(i, batch).to_numpy(zero_copy_only=False)), np.float32) for i in range(0, len(part), batch)]
            ends = np.cumsum([0, *(r.shape[1] for r in rows for _ in range(len(r)))], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.float32), *(r.ravel() for r in rows)])))

    return df.withColumn(out, infer(F.coalesce(F.col(text), F.lit(""))))


def embed_postings(postings: DataFrame, done: DataFrame, encoder: Callable = HashedTokens(), key: str = "job_id", company: str = "company_id", title: str = "role_name", text: str = "description_text", unit: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``carry``, model_text, vector) of postings that are not in ``done`` yet.

    What a company repeats is found over all its postings, done or not, and stripped from those
    to encode; title and rest share one budget of characters.
    """
    from .boilerplate import build_text, find_boilerplate, strip_boilerplate

    repeated = find_boilerplate(postings, company, text)
    todo = postings.select(*dict.fromkeys([key, company, title, text, *carry])).join(done.select(key), key, "left_anti")
    stripped = strip_boilerplate(todo, repeated, key, company, text).select(key, *carry, build_text(F.col(title), F.col("stripped_text")).alias("model_text"))
    return encode_texts(stripped, "model_text", encoder, unit=unit)


# Default titles that name a level, first match first, and the zone of confidence in which two levels' verdicts mean the one between.
TITLE_LEVELS = [("junior", r"\b(?:junior|jr|intern|trainee|graduate)\b"), ("lead", r"\b(?:lead|principal|staff|director|head)\b"), ("senior", r"\b(?:senior|sr)\b")]
MID_ZONE, UNSURE = (0.40, 0.60), 0.50


def title_level(title: Column, rules: list[tuple[str, str]] = TITLE_LEVELS) -> Column:
    """The level a title names; null if none."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(pattern), level) for level, pattern in rules])


def decide_level(title: Column, probability: Column, labels: list[str], rules: list[tuple[str, str]] = TITLE_LEVELS, zone: tuple[float, float] = MID_ZONE, unsure: float = UNSURE) -> Column:
    """Struct of level, confidence and the rule that decided, from a title and an array of probabilities.

    A junior title decides alone; a junior verdict never stands against a title of a higher
    level; where the title names no level, a junior or senior verdict inside the zone and any
    verdict below ``unsure`` mean mid.  Of equal probabilities the first label wins.
    """
    named = title_level(title, rules)
    best = F.array_max(probability)
    top = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(probability, best).cast("int"))
    between = top.isin("junior", "senior") & best.between(*zone)
    rule = (F.when(named == "junior", "title").when((top == "junior") & named.isNotNull(), "title_override").when(named.isNull() & between, "mid_zone")
            .when(named.isNull() & (best < unsure), "unsure").otherwise("model"))
    level = F.when(rule.isin("title", "title_override"), named).when(rule.isin("mid_zone", "unsure"), "mid").otherwise(top)
    return F.struct(level.alias("level"), best.alias("confidence"), rule.alias("rule"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row an actual label, one column a predicted one."""
    cells = df.groupBy(actual).pivot(predicted, labels).agg(F.count(F.lit(1)))
    return cells.na.fill(0, labels)


def train_title_levels(df: DataFrame, vector: str, title: str, labels: list[str], rules: list[tuple[str, str]] = TITLE_LEVELS, seed: int = 7) -> tuple[object, DataFrame]:
    """``train_level`` on the rows whose title names a level; the label is its place in ``labels``."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), title_level(F.col(title), rules)) - 1
    return train_level(df.withColumn("_label", place).filter("_label >= 0"), vector, "_label", seed)


def train_level(df: DataFrame, vector: str, label: str, seed: int = 7) -> tuple[object, DataFrame]:
    """Class-weighted logistic regression; returns (model, per-class precision, recall, F1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.xxhash64(vector).alias("_h"))
    totals = cut_lineage(rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")))
    shape = totals.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("c"))
    weights = totals.withColumns({"_t": shape.select("t").scalar(), "_c": shape.select("c").scalar()}).select("label", (F.col("_t") / (F.col("_c") * F.col("_n"))).alias("weight"))
    weighted = rows.join(F.broadcast(weights), "label")  # one row a label
    held_out = F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(5)) == 0
    model = LogisticRegression(maxIter=50, regParam=0.01, weightCol="weight").fit(weighted.filter(~held_out))
    return model, class_report(model.transform(weighted.filter(held_out)).select("label", "prediction"))


def class_report(predicted: DataFrame) -> DataFrame:
    cells = predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hits"))
    called = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("called"))
    p, r = F.col("hits") / F.col("called"), F.col("hits") / F.col("support")
    return truth.join(called, "label", "left").select("label", "support", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def predict_level(model, df: DataFrame, key: str, vector: str, title: str, labels: list[str], **rules) -> DataFrame:
    """key, level, confidence and rule of every row; see ``decide_level``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.select(key, title, array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    return scored.select(key, decide_level(F.col(title), vector_to_array("probability"), labels, **rules).alias("d")).select(key, "d.*")

"""SentencePiece over a table of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_text
from .pieces import SPACE, Model, PieceEncoder


def _lists(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None, piece_bytes: int = 2 << 20) -> DataFrame:
    """row, n_tokens, ids, round_trip for every document: whole texts, any length.

    A null or empty text has no ids.  ``round_trip`` says that decoding gives the text back;
    the one thing a model of this kind cannot keep is a space sign (U+2581) in the text
    itself, which comes back as a space and is compared as one.  Repeated rows are encoded
    alike; extra columns ride along in ``row``.
    """
    model = Model.load(model_path)

    def make():
        encoder = PieceEncoder(model)

        def run(texts: pa.Array) -> list:
            ids, starts = encoder.encode(texts)
            back = pa.array(encoder.decode(ids, starts), pa.string())
            same = pc.equal(back, pc.replace_substring(texts.fill_null(""), SPACE, " "))
            return [np.diff(starts), _lists(ids, starts), same]

        return run

    return map_text(docs, make, "n_tokens long, ids array<int>, round_trip boolean", text, carry, piece_bytes)


def decode_pieces(encoded: DataFrame, model_path: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """row and text, from lists of ids; null gives an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    model = Model.load(model_path)
    packed = encoded.select(F.struct(*[encoded[f"`{c}`"] for c in (carry or encoded.columns)]).alias("row"), encoded[f"`{ids}`"].cast("array<int>").alias("ids"))

    def run(batches):
        encoder = PieceEncoder(model)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            offsets = np.asarray(lists.offsets, np.int64)
            texts = encoder.decode(np.asarray(lists.flatten(), np.int64), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))

"""What several of the operators share: word rules, tables, byte helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def pack(docs: DataFrame, **named: Column) -> DataFrame:
    """The whole row as one struct ``row`` next to derived columns, so that no name can clash."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(whole, *[c.alias(n) for n, c in named.items()])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and where each row starts; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def pieces_of(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(text).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def map_text(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str, text: str | Column = "text", carry: list[str] | None = None, piece_bytes: int = 8 << 20) -> DataFrame:
    """``row`` (the carried columns as one struct) and what a function makes of the whole texts.

    ``make`` is called once in each task and gives a function from a column of texts to the
    columns named in ``fields``; it sees about ``piece_bytes`` of text at a time.
    """
    body = docs[f"`{text}`"] if isinstance(text, str) else text
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in (carry or docs.columns)]).alias("row"), body.cast("string").alias("body"))
    made = T.StructType.fromDDL(fields)
    types = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in pieces_of(batches, 1, piece_bytes):
            columns = [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(fn(part.column(1)), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", *types.names])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *made]))

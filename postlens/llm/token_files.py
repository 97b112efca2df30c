"""Token counts from flat token files that have no index: a scan for separators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of
from .files import make_folder, open_folder, task_file


def write_flat(docs: DataFrame, folder: str, encoder: Callable, separator: int, width: int, text: str = "text", key: str = "doc_id", piece_bytes: int = 8 << 20) -> DataFrame:
    """Encodes whole texts into one flat file a task, ``separator`` after each document.

    Returns a written table (name, ordinal, ident, n_bytes): the documents of each file in
    order and, with ordinal -1, one row a file with its size.
    """
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pieces_of(batches, 1, piece_bytes)
        part = next(parts, None)
        if part is None:
            return
        encode = encoder().encode
        system, path = open_folder(folder)
        name, ordinal, size = task_file("tokens"), 0, 0
        with system.open_output_stream(f"{path}/{name}") as out:
            while part is not None:
                ids, starts = encode(part.column(1))
                out.write(np.insert(ids.astype(f"<u{width}"), starts[1:], separator).tobytes())
                n = part.num_rows
                size += width * (len(ids) + n)
                yield pa.RecordBatch.from_pydict({"name": [name] * n, "ordinal": np.arange(ordinal, ordinal + n), "ident": part.column(0), "n_bytes": pa.nulls(n, pa.int64())})
                ordinal += n
                part = next(parts, None)
        yield pa.RecordBatch.from_pydict({"name": [name], "ordinal": pa.array([-1], pa.int64()), "ident": pa.nulls(1, pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("ident"), F.col(f"`{text}`").cast("string").alias("body"))
    rows.mapInArrow(write, "name string, ordinal long, ident long, n_bytes long").write.parquet(f"{folder}/order")
    return docs.sparkSession.read.parquet(f"{folder}/order")


def count_tokens(files: DataFrame, folder: str, separator: int, width: int, block: int = 1 << 21) -> DataFrame:
    """(name, ordinal, n_tokens, closed), one row a document, from (name, n_bytes).

    Files are cut into blocks of ``block`` tokens wherever that falls, and tasks find the
    separators of a block in one vectorised comparison.  Blocks are then stitched by a prefix
    scan over their summaries: the separators before a block number its documents, and the
    last separator before it is where its first document begins.  Tokens after a file's last
    separator are a document that is not closed.  A file without tokens has no document.
    """
    ids = F.floor(F.col("n_bytes") / width)
    blocks = files.select("name", ids.alias("n_ids")).filter("n_ids > 0").select("name", "n_ids", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_ids") - 1) / block))).alias("block"))
    dealt = blocks.repartition("name", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["block"] * block
                n = min(block, row["n_ids"] - begin)
                with system.open_input_file(f"{path}/{row['name']}") as f:
                    data = np.frombuffer(f.read_at(n * width, begin * width), f"<u{width}")
                if len(data) != n:
                    raise ValueError(f"{row['name']}: {len(data)} of {n} tokens at {begin}")
                ends = np.flatnonzero(data == separator) + begin
                yield pa.RecordBatch.from_pydict({"name": [row["name"]], "block": [row["block"]], "n_ids": [row["n_ids"]], "ends": pa.array([ends], pa.list_(pa.int64()))})

    found = dealt.mapInArrow(scan, "name string, block long, n_ids long, ends array<long>")
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n, last = F.size("ends"), F.when(F.size("ends") > 0, F.element_at("ends", -1))
    stitched = found.withColumns({"skip": F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"), "open_at": F.coalesce(F.max(last).over(before), F.lit(-1))})
    closed = stitched.select("name", "skip", F.posexplode(F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(F.col("open_at")) - 1)).alias("k", "n_tokens"))
    tails = found.groupBy("name").agg(F.sum(n).cast("long").alias("ordinal"), (F.max("n_ids") - 1 - F.coalesce(F.max(last), F.lit(-1))).alias("n_tokens")).filter("n_tokens > 0")
    return closed.select("name", (F.col("skip") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")).unionByName(tails.select("name", "ordinal", "n_tokens", F.lit(False).alias("closed")))

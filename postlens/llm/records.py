"""Token sequences in length-delimited binary records with checksums and an offset index.

A shard is two files.  ``NAME.rec`` holds records, one after the other:

    length of the payload   unsigned 64 bits
    masked CRC of those 8 bytes   unsigned 32 bits
    payload
    masked CRC of the payload     unsigned 32 bits

and a payload is: 1 byte that is 1 if there is an id, the id (signed 64 bits), bytes per token
(1 byte: 2 or 4), tokens.  ``NAME.idx`` holds the offset of each record, unsigned 64 bits, so
a shuffled reader can fetch any record with one ranged read.  All numbers are little-endian;
a CRC is CRC-32, masked as (rotated right by 15 bits) + 0xA282EAD8.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of
from .files import make_folder, open_folder, task_file

_HEAD, _TAIL, _META = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<?qB")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ident: int | None, ids: np.ndarray) -> bytes:
    width = ids.dtype.itemsize
    payload = _META.pack(ident is not None, ident or 0, width) + ids.astype(f"<u{width}", copy=False).tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((_HEAD.pack(len(payload), masked_crc(length)), payload, _TAIL.pack(masked_crc(payload))))


def parse(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(id, tokens, where the next record starts); ValueError if a checksum is wrong."""
    n, check = _HEAD.unpack_from(data, at)
    if masked_crc(bytes(data[at : at + 8])) != check:
        raise ValueError("damaged record length")
    start = at + _HEAD.size
    payload = bytes(data[start : start + n])
    if len(payload) != n or masked_crc(payload) != _TAIL.unpack_from(data, start + n)[0]:
        raise ValueError("damaged record")
    there, ident, width = _META.unpack_from(payload)
    return ident if there else None, np.frombuffer(payload, f"<u{width}", offset=_META.size), start + n + _TAIL.size


def write_records(docs: DataFrame, folder: str, encoder: Callable, vocabulary: int, end_id: int | None, text: str = "text", key: str = "doc_id", piece_bytes: int = 8 << 20) -> DataFrame:
    """Encodes whole texts and writes them in ascending order of ``key``; returns the manifest.

    ``encoder`` makes, in each task, an object with ``encode(texts)``; ``end_id`` is added to
    every sequence.  Rows are range-partitioned by key and sorted in their partition, each
    partition becomes a shard, and shards follow each other in key order (null first, rows
    with the same key by text).  Tokens take 2 bytes where the vocabulary allows.  The
    manifest has shard, name, n_records, n_tokens, n_bytes and start, the number of tokens in
    all shards before; it is a written table, so a lost executor never writes a shard twice.
    """
    make_folder(folder)
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("ident"), F.col(f"`{text}`").cast("string").alias("body")).repartitionByRange(F.col("ident").asc_nulls_first()).sortWithinPartitions(F.col("ident").asc_nulls_first(), F.col("body").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = pieces_of(batches, 1, piece_bytes)
        part = next(parts, None)
        if part is None:
            return
        encode = encoder().encode
        system, path = open_folder(folder)
        name = task_file("shard")
        offsets, at, tokens = [], 0, 0
        with system.open_output_stream(f"{path}/{name}.rec") as out:
            while part is not None:
                ids, starts = encode(part.column(1))
                ids, idents = ids.astype(kind), part.column(0).to_pylist()
                frames = []
                for i, ident in enumerate(idents):
                    own = ids[starts[i] : starts[i + 1]]
                    frames.append(frame(ident, own if end_id is None else np.append(own, kind(end_id))))
                    tokens += len(own) + (end_id is not None)
                    offsets.append(at)
                    at += len(frames[-1])
                out.write(b"".join(frames))
                part = next(parts, None)
        with system.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})

    written = ordered.mapInArrow(write, "shard int, name string, n_records long, n_tokens long, n_bytes long")
    written.write.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return docs.sparkSession.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def stored(folder: str, name: str, count: int, size: int, block: int = 8 << 20) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """All records of a shard in order, about ``block`` bytes at a time."""
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/{name}.idx") as f:
        offsets = np.append(np.frombuffer(f.read(), "<u8").astype(np.int64), size)
    if len(offsets) != count + 1:
        raise ValueError(f"{name}: {len(offsets) - 1} offsets for {count} records")
    with system.open_input_file(f"{path}/{name}.rec") as f:
        at = 0
        while at < count:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
            data = memoryview(f.read_at(int(offsets[stop] - offsets[at]), int(offsets[at])))
            yield [parse(data, int(o - offsets[at]))[:2] for o in offsets[at:stop]]
            at = stop


def read_one(folder: str, name: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, as a shuffled reader does."""
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/{name}.idx") as f:
        ends = np.frombuffer(f.read_at(16, 8 * number), "<u8")
    with system.open_input_file(f"{path}/{name}.rec") as f:
        size = f.size()
        start, end = int(ends[0]), int(ends[1]) if len(ends) > 1 else size
        return parse(memoryview(f.read_at(end - start, start)), 0)[:2]


def read_records(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """ident, start (tokens before it in the whole set), n_tokens, ids_crc32 and, if asked, ids.

    The CRC is of the tokens as little-endian unsigned 32-bit numbers.
    """
    shards = manifest.count()
    dealt = manifest.select("name", "n_records", "n_bytes", "start", "shard").repartitionByRange(max(1, shards), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for rows in stored(folder, row["name"], row["n_records"], row["n_bytes"]):
                    sizes = np.array([len(ids) for _, ids in rows], np.int64)
                    columns = {
                        "ident": pa.array([i for i, _ in rows], pa.int64()),
                        "start": pa.array(start + np.cumsum(sizes) - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array([zlib.crc32(ids.astype("<u4")) for _, ids in rows], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([ids.astype(np.int32) for _, ids in rows], pa.list_(pa.int32()))
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_pydict(columns)

    return dealt.mapInArrow(read, "ident long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

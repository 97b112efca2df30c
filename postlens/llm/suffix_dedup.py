"""Removes strings of 200 bytes that occur elsewhere, by suffix arrays over what can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import pieces_of, string_bytes
from .repeats import Rolling, anchored_ranges, mix
from .suffix_sort import suffix_array

SPANS = "array<struct<f:int,t:int>>"
CONTEXT = ["key", "c"]  # two hashes of 64 bits: a stretch is known by its anchor and by all its bytes


def _ranges(rows: DataFrame, width: int, gram: int, whole: bool, step: int = 1 << 22) -> DataFrame:
    """Anchored ranges of all texts: only their keys, or everything about them."""
    fields = "key long" + ", c long, r1 long, r2 int, a int, n int" * whole

    def cut(part: pa.RecordBatch) -> Iterator[dict]:
        data, offsets = string_bytes(part.column(2))
        if offsets[-1] <= step + width:
            yield anchored_ranges(data, offsets, width, gram)
            return
        for i in range(part.num_rows):  # a very long text, by its windows
            for at in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[i + 1]) - width + 1), step):
                piece = data[at : min(at + step + width - 1, offsets[i + 1])]
                found = anchored_ranges(piece, np.array([0, len(piece)]), width, gram)
                yield found | {"row": found["row"] + i, "a": found["a"] + (at - offsets[i])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, 2, 1 << 20):
            for found in cut(part):
                columns = {"key": found["key"]}
                if whole:
                    r1, r2 = (np.asarray(part.column(c))[found["row"]] for c in (0, 1))
                    columns |= {"c": found["c"], "r1": r1, "r2": r2, "a": found["a"].astype(np.int32), "n": found["n"].astype(np.int32)}
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select("r1", "r2", "body").mapInArrow(run, fields)


def _spans(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"f": int(f), "t": int(t) - 1} for f, t in zip(edges[::2], edges[1::2])]


def repeated_in_block(contexts: list[bytes], windows: np.ndarray, copies: np.ndarray, width: int, chunk: int = 1 << 14) -> list[np.ndarray]:
    """For each context, which of its first ``windows`` windows occur at two places or more.

    ``copies`` says how often a context occurs.  Windows are compared with their neighbour in
    the suffix array of all contexts; runs of equal ones add up their copies.
    """
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    text = raw.astype(np.int64) + 1
    text[starts + sizes - 1] = 0
    owner = np.full(len(raw), -1)
    at = np.repeat(starts, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    owner[at] = np.repeat(np.arange(len(contexts)), windows)

    order = suffix_array(text)
    order = order[owner[order] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(raw, width)
    differs = np.ones(len(order), bool)
    for i in range(1, len(order), chunk):
        now = order[i : i + chunk]
        differs[i : i + chunk] = (views[now] != views[order[i - 1 : i - 1 + len(now)]]).any(1)
    run = np.cumsum(differs) - 1
    total = np.bincount(run, copies[owner[order]])
    twice = np.zeros(len(raw), bool)
    twice[order] = total[run] >= 2
    return [twice[s : s + w] for s, w in zip(starts, windows)]


def _fetch(wanted: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """What is to be compared, dealt out by anchor: the bytes of each wanted context (i is -1),
    or, where it is ``wide``, the hash w of each of its windows i."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct(*CONTEXT, "m", "a", "n", "wide")).alias("wants"))
    joined = rows.join(lists, ["r1", "r2"]).select("r1", "r2", "ident", "body", "wants")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, 3, 1 << 22):
            for body, wants in zip(part.column(3).cast(pa.binary()), part.column(4)):
                data, wants = body.as_py(), wants.values
                every = {c: np.asarray(wants.field(c)) for c in (*CONTEXT, "m", "a", "n")}
                wide = np.asarray(wants.field("wide"))
                own = {c: v[~wide] for c, v in every.items()}
                k = len(own["n"])
                if k:
                    texts = [data[s : s + w + width - 1] for s, w in zip(own["a"].tolist(), own["n"].tolist())]
                    yield pa.RecordBatch.from_pydict({c: own[c] for c in (*CONTEXT, "m")} | {"n": own["n"], "context": pa.array(texts, pa.binary()), "i": np.full(k, -1, np.int32), "w": np.zeros(k, np.int64)})
                own = {c: np.repeat(v[wide], every["n"][wide]) for c, v in every.items()}
                if len(own["n"]):
                    n, rolling = every["n"][wide], Rolling(np.frombuffer(data, np.uint8))
                    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = own["a"] + i
                    yield pa.RecordBatch.from_pydict({c: own[c] for c in (*CONTEXT, "m")} | {"n": own["n"], "context": pa.nulls(len(i), pa.binary()), "i": i.astype(np.int32), "w": mix(rolling.of(at, at + width)).view(np.int64)})

    return joined.mapInArrow(run, "key long, c long, m long, n int, context binary, i int, w long").repartition(parts, "key", "w")


def _single_windows(fetched: DataFrame) -> DataFrame:
    """(context, spans) of the wide contexts: windows equal to another, by hash, occur twice.

    The rows are picked in a task and not by a filter, which Spark would move below the
    exchange, and then fetch everything a second time.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(batch.column("i"), 0)).select([*CONTEXT, "m", "i", "w"])

    each = fetched.mapInArrow(pick, "key long, c long, m long, i int, w long").dropDuplicates([*CONTEXT, "i"])
    twice = each.groupBy("key", "w").agg(F.sum("m").alias("n")).filter("n > 1").select("key", "w")
    return each.join(twice, ["key", "w"], "left_semi").groupBy(*CONTEXT).agg(F.collect_list(F.struct(F.col("i").alias("f"), F.col("i").alias("t"))).alias("spans"))


def _sorted_blocks(fetched: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """(context, spans): suffix arrays over blocks of whole anchor groups."""

    def solve(block: list[tuple]) -> pa.RecordBatch:
        block = list({x[:2]: x for x in block}.values())  # rows equal in id and text fetch a context twice
        masks = repeated_in_block([x[4] for x in block], np.array([x[3] for x in block]), np.array([x[2] for x in block]), width)
        found = [(*x[:2], _spans(m)) for x, m in zip(block, masks) if m.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)] + [pa.array([x[2] for x in found], pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())])))], names=[*CONTEXT, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        for batch in batches:
            own = batch.filter(pc.less(batch.column("i"), 0)).select([*CONTEXT, "m", "n", "context"])
            for row in zip(*(c.to_pylist() for c in own.columns)):
                if held >= block_bytes and row[0] != block[-1][0]:
                    yield solve(block)
                    block, held = [], 0
                block.append(row)
                held += len(row[4])
        if block:
            yield solve(block)

    return fetched.sortWithinPartitions(*CONTEXT, "i").mapInArrow(run, f"key long, c long, spans {SPANS}")


def repeated_spans(rows: DataFrame, width: int = 200, gram: int = 96, most: int = 2048, block_bytes: int = 48 << 10) -> DataFrame:
    """(r1, r2, spans): first and last of the runs of windows that occur elsewhere, by text.

    1. Each window of ``width`` bytes has an anchor, its ``gram``-byte string of smallest hash;
       neighbouring windows with the same anchor are a range.  Equal windows have equal
       anchors, so ranges whose anchor occurs once are done.
    2. Equal ranges are folded to one with a count, in the map tasks first.  An anchor group
       that is then a single range occurs twice as a whole.
    3. The other groups are dealt out by anchor, and blocks of them are suffix-sorted: windows
       equal to a neighbour in the suffix array, or in a folded range, occur twice.
    4. A group of over ``most`` different ranges (a passage in very many texts, at its edges)
       is split to single windows, for which folding equal ones leaves nothing to sort.
    """
    keys = _ranges(rows, width, gram, whole=False).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = cut_lineage(_ranges(rows, width, gram, whole=True).join(keys, "key", "left_semi"))
    folded = shared.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("r1", "r2", "a", "n")).alias("rep"))
    groups = folded.groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    contexts = cut_lineage(folded.join(groups, "key").select(*CONTEXT, "m", "rep.*", "d"))

    alone = contexts.filter("d = 1").select(*CONTEXT, F.array(F.struct(F.lit(0).alias("f"), (F.col("n") - 1).alias("t"))).cast(SPANS).alias("spans"))
    # From here on one plan: its parts share the exchange of the texts and that of the contexts.
    fetched = _fetch(contexts.filter("d > 1").withColumn("wide", F.col("d") > most), rows, width)
    results = alone.unionByName(_sorted_blocks(fetched, width, block_bytes)).unionByName(_single_windows(fetched))
    placed = shared.join(results, CONTEXT).select("r1", "r2", "a", F.explode("spans").alias("s"))
    return placed.groupBy("r1", "r2").agg(F.collect_list(F.struct((F.col("a") + F.col("s.f")).alias("f"), (F.col("a") + F.col("s.t")).alias("t"))).alias("spans"))


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 200, gram: int = 96, with_bytes: bool = False, **options) -> DataFrame:
    """ident, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (bytes), by document.

    A byte goes if a string of ``width`` bytes over it also starts somewhere else, in the same
    text or another; all strings are judged on the texts as given, and none spans two texts.
    A null text counts as empty.  Rows equal in key and text are documents of their own and
    repeat each other.  Texts shorter than ``width`` stay whole.  A null key is kept as it is.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = docs.select(F.col(f"`{key}`").alias("ident"), body.alias("body"))
    rows = named.select(F.xxhash64("ident", "body").alias("r1"), F.hash("body", "ident").alias("r2"), "ident", "body")
    spans = repeated_spans(rows, width, gram, **options)
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    joined = rows.join(spans, ["r1", "r2"], "left").select("ident", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, 1, 1 << 22):
            out: list[list] = [[], [], [], [], []]
            for data, found in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2)):
                removed = runs = 0
                left = data
                if found.is_valid:
                    change = np.zeros(len(data) + 1, np.int64)
                    np.add.at(change, np.asarray(found.values.field("f")), 1)
                    np.add.at(change, np.asarray(found.values.field("t")) + width, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(data), removed, runs, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out[: 4 + with_bytes], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["ident", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes])

    ident = joined.schema["ident"].dataType.simpleString()
    return joined.mapInArrow(run, f"ident {ident}, {fields}")

import uuid
import zlib

import numpy as np
import pytest

from postlens.llm.byte_bpe import ByteBpe, vocabulary_path
from postlens.llm.queries import QUERIES
from postlens.llm.records import frame, masked_crc, parse, read_one, read_records, write_records
from postlens.llm.token_files import count_tokens, write_flat

from .conftest import ROOT

PATH = vocabulary_path("byte_bpe_50k.json")
BPE = ByteBpe(PATH)


def encoder():
    path = PATH
    return lambda: ByteBpe(path)  # made in a function: the tasks cannot import this module


make = encoder()


def ids_of(text):
    return BPE.tokenizer.encode(text or "", add_special_tokens=False).ids


def write_file(folder, ids, width=2):
    path = folder / uuid.uuid4().hex
    path.write_bytes(np.array(ids, f"<u{width}").tobytes())
    return path.name, path.stat().st_size


def test_frame():
    ids = np.array([1, 2, 65535], np.uint16)
    data = frame(7, ids) + frame(None, ids[:0]) + frame(-3, np.array([1 << 20], np.uint32))
    at, got = 0, []
    while at < len(data):
        ident, found, at = parse(memoryview(data), at)
        got.append((ident, found.tolist()))
    assert got == [(7, [1, 2, 65535]), (None, []), (-3, [1 << 20])]
    for i in range(len(frame(7, ids))):
        broken = bytearray(frame(7, ids))
        broken[i] ^= 1
        with pytest.raises((ValueError, OverflowError)):
            parse(memoryview(bytes(broken)), 0)
    assert masked_crc(b"") == 0xA282EAD8


def test_query(spark, given):
    start = 0
    out = {r.doc_id: r for r in QUERIES["op5_binary_records"](spark, ROOT).collect()}
    assert len(out) == len(given[1])
    for row in sorted(given[1], key=lambda r: r["doc_id"]):
        ids = [*ids_of(row["text"]), 0]
        r = out[row["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_of_odd_rows(spark, make_docs, odd_rows, tmp_path):
    folder = f"file://{tmp_path}/r"
    manifest = write_records(make_docs(odd_rows).repartition(3), folder, make, 50_257, 0, piece_bytes=100)
    out = read_records(manifest, folder, with_ids=True).orderBy("start").collect()
    low = lambda x: (x is not None, x or 0)
    expected = sorted(odd_rows, key=lambda r: (low(r[0]), (r[1] is not None, r[1] or "")))
    assert [(r.ident, r.ids) for r in out] == [(r[0], [*ids_of(r[1]), 0]) for r in expected]
    shard = manifest.orderBy("shard").first()
    ident, ids = read_one(folder, shard["name"], shard["n_records"] - 1)
    assert (ident, ids.tolist()) == (expected[shard["n_records"] - 1][0], [*ids_of(expected[shard["n_records"] - 1][1]), 0])


def test_wide_vocabulary_and_empty_table(make_docs, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = write_records(make_docs([(1, "some text")]), folder, make, 100_000, None)
    assert read_records(manifest, folder, with_ids=True).first().ids == ids_of("some text")
    nothing = f"file://{tmp_path}/e"
    assert read_records(write_records(make_docs([]), nothing, make, 50_257, 0), nothing).count() == 0


def test_damage_is_found(make_docs, tmp_path):
    folder = f"file://{tmp_path}/d"
    manifest = write_records(make_docs([(1, "some text")]), folder, make, 50_257, 0)
    path = next((tmp_path / "d").glob("*.rec"))
    data = bytearray(path.read_bytes())
    data[-6] ^= 4
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        read_records(manifest, folder).collect()


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_scan_over_blocks(spark, tmp_path, block):
    sep = 9
    files = {}
    for ids in ([], [9], [1, 9], [1, 2], [1, 9, 9, 2, 3, 4, 5, 6, 7, 8, 1, 9, 5], [9] * 8, list(range(1, 9)) * 5 + [9]):
        name, size = write_file(tmp_path, ids)
        files[name] = (ids, size)
    df = spark.createDataFrame([(n, s) for n, (_, s) in files.items()], "name string, n_bytes long")
    expected = set()
    for name, (ids, _) in files.items():
        docs, run = [], 0
        for i in ids:
            if i == sep:
                docs.append((run, True))
                run = 0
            else:
                run += 1
        docs += [(run, False)] * (run > 0)
        expected |= {(name, k, n, c) for k, (n, c) in enumerate(docs)}
    got = count_tokens(df, f"file://{tmp_path}", sep, 2, block)
    assert {tuple(r) for r in got.select("name", "ordinal", "n_tokens", "closed").collect()} == expected


def test_counts_of_odd_rows(make_docs, odd_rows, tmp_path):
    folder = f"file://{tmp_path}/f"
    order = write_flat(make_docs(odd_rows).repartition(3), folder, make, 50_256, 2, piece_bytes=100)
    counts = count_tokens(order.filter("ordinal = -1").select("name", "n_bytes"), folder, 50_256, 2, block=64)
    out = order.filter("ordinal >= 0").join(counts, ["name", "ordinal"]).select("ident", "n_tokens").collect()
    assert sorted(map(tuple, out), key=str) == sorted(((r[0], len(ids_of(r[1]))) for r in odd_rows), key=str)
    nothing = f"file://{tmp_path}/n"
    assert write_flat(make_docs([]), nothing, make, 50_256, 2).count() == 0


def test_count_query(spark, given):
    out = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, ROOT).collect()}
    assert out == {r["doc_id"]: len(ids_of(r["text"])) for r in given[1]}

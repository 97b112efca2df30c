import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postlens.llm.byte_bpe import ByteBpe, vocabulary_path
from postlens.llm.queries import QUERIES

PATH = vocabulary_path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z<|endoftext|>", "one two", "", None, "no  marker <|endoftex|>", "<|endoftext|><|endoftext|> end"]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_op5_gives_what_the_library_gives(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op5_binary_records"](spark, str(tmp_path)).collect()}
    assert ids_of(TEXTS[0]) == [64, 220, 50256, 275]
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*ids_of(text), 0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("special", [True, False])
def test_separator_only_with_special(special):
    flat, starts = ByteBpe(PATH, special).encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        got = flat[starts[i] : starts[i + 1]].tolist()
        assert (got == ids_of(text)) if special else 50256 not in got

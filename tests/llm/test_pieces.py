import pyarrow as pa
import pytest
from hypothesis import given as each, settings
from hypothesis import strategies as st

from postlens.llm.byte_bpe import ByteBpe, vocabulary_path
from postlens.llm.piece_text import decode_pieces, encode_pieces
from postlens.llm.pieces import Model, PieceEncoder

from .conftest import long_text

PATH = vocabulary_path("piece_bpe_32k.model")
MODEL = Model.load(PATH)
ENCODER = PieceEncoder(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    ids, starts = ENCODER.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == library.encode(text or ""), repr(text)
    back = ENCODER.decode(ids, starts)
    assert back == [library.decode(library.encode(t or "")) for t in texts]
    assert back == [(t or "").replace("▁", " ") for t in texts]


ODD = ["", " ", "  ", "a", " a ", "a  b   c    d" + " " * 70 + "e", "\n\n \n", "日本語 🙂 \t", "foo▁bar ▁▁ baz", "x" * 500, "<s> </s> <0x0A> <unk>", "\0a\0", None, " " * 300]


def test_odd_texts(library):
    same(library, ODD)


@settings(max_examples=150, deadline=None)
@each(st.lists(st.text(alphabet="abe thonri\n▁é日.,'<0>", max_size=60), min_size=1, max_size=6))
def test_any_text(library, texts):
    same(library, texts)


def test_given_and_long(library, given):
    same(library, [r["text"] for r in given[1]] + [long_text(5000)])


def test_relaxing_agrees_with_merging():
    """Of the pairs of pieces, those that stand are those that plain BPE leaves alone."""
    import numpy as np

    from postlens.llm.pieces import merge

    rng = np.random.default_rng(1)
    rank = {MODEL.pieces[i]: MODEL.rank[i] for i in MODEL.ids if MODEL.rank[i] >= 0}
    a, b = rng.choice(MODEL.ids, 3000), rng.choice(MODEL.ids, 3000)
    left, right = MODEL.ids[MODEL.left[MODEL.ids] >= 0], MODEL.ids[MODEL.left[MODEL.ids] >= 0]
    a, b = np.concatenate([a, MODEL.left[left], MODEL.left[left][:-1]]), np.concatenate([b, MODEL.right[right], MODEL.right[right][1:]])
    pick = rng.choice(len(a), 4000, replace=False)
    for x, y, ok in zip(a[pick], b[pick], MODEL.stand(a[pick], b[pick])):
        assert ok == (merge(list(MODEL.pieces[x] + MODEL.pieces[y]), rank) == [MODEL.pieces[x], MODEL.pieces[y]])


def test_tables(spark, make_docs, odd_rows, library):
    docs = make_docs(odd_rows)
    made = encode_pieces(docs, PATH)
    out = made.collect()
    assert len(out) == len(odd_rows) and all(r.round_trip for r in out)
    assert all(r.ids == library.encode(r.row.text or "") and r.n_tokens == len(r.ids) for r in out)
    back = decode_pieces(made.select("row.doc_id", "ids"), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in odd_rows)
    assert encode_pieces(make_docs([]), PATH).count() == 0
    assert decode_pieces(made.select("ids").limit(0), PATH).count() == 0


SPACES = st.text(alphabet="abé1'.,;s \n\t\x0b\x1c\xa0　é", max_size=40)


@settings(max_examples=300, deadline=None)
@each(st.lists(SPACES, min_size=1, max_size=5))
def test_byte_bpe_is_the_library(texts):
    ids, starts = BPE.encode(pa.array([*texts, None]))
    for i, text in enumerate([*texts, ""]):
        assert ids[starts[i] : starts[i + 1]].tolist() == BPE.tokenizer.encode(text, add_special_tokens=False).ids


BPE = ByteBpe(vocabulary_path("byte_bpe_50k.json"))

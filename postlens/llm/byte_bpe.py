"""Byte-level BPE ids through the tokenizers library."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Encoded, WordStore, encode_split, interleave

CUT = "\0"
# A space after other white space, where a pre-token can reach over it, and texts with the cut mark.
UNSPLIT = r"\x{00}|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "

# A letter and the ASCII sign, digit or line end after it are never in one pre-token.
LETTER_END = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-@\[-`{-~\n])"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Encodes columns of texts.

    The pre-tokenizer starts a new token at every single space that follows a letter, digit
    or sign, and after a word's letters, so texts are cut there and each distinct part goes
    through the library once.  A text where a space follows other white space goes through
    it whole.  With ``special`` the tokenizer is used as loaded, and a text with the
    string of an added token goes through it whole; without, such a string is encoded as plain text, so that its id
    stands in no text and can be a separator.
    """

    def __init__(self, path: str, special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        self.unsplit = "|".join([UNSPLIT, *(re.escape(t.content) for t in added)])
        self.store = WordStore(self._library, 400_000)

    def _library(self, words: list[str]) -> Encoded:
        flat: list[np.ndarray] = []
        lengths: list[int] = []
        for at in range(0, len(words), 20_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
            lengths.extend(map(len, ids))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
        return np.concatenate([np.zeros(0, np.int32), *flat]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def encode(self, texts: pa.Array) -> Encoded:
        """Flat ids of all texts and where each text starts; null counts as empty."""
        texts = texts.fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, self.unsplit))
        even_at, odd_at = np.flatnonzero(~odd), np.flatnonzero(odd)
        marked = pc.replace_substring(pc.replace_substring_regex(texts.filter(pa.array(~odd)), LETTER_END, rf"\1{CUT}\2"), " ", f"{CUT} ")
        even = encode_split(marked, self.store, CUT)
        if not len(odd_at):
            return even
        return interleave([(even_at, even), (odd_at, self._library(texts.filter(pa.array(odd)).to_pylist()))], len(texts))


@lru_cache(maxsize=2)
def encoder_of(path: str, special: bool) -> ByteBpe:
    """One encoder a Python worker: its tasks load the vocabulary once and share the words met so far."""
    return ByteBpe(path, special)

"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` for the same file.  Before a white-space
character that follows another character the pre-tokenizer always cuts, so
a text may be encoded word by word; words come again and again, so a
bounded cache of words saves most of the work.  Words are encoded by
tiktoken, which has the same merges and is faster; a word with characters
beyond Latin, where the libraries' Unicode tables might differ, or a
special token, goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from webloom.llm.common import tokenizer_path

CACHE_WORDS = 400_000
_OTHER = re.compile("[^\x00-ɏ]|<\\|")


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = "byte_bpe_50k"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        with open(tokenizer_path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._own = Tokenizer.from_file(tokenizer_path(f"{name}.json"))
        self._words = _Words(self._plain)
        self._sizes = _Words(self._size)

    def _plain(self, text: str) -> bytes:
        if _OTHER.search(text):
            ids = self._own.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast(text)
        return np.array(ids, "<u4").tobytes()

    def _size(self, text: str) -> int:
        return len(self._plain(text)) // 4

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or not first[-1].isspace():
            try:
                words = b"".join(map(self._words.__getitem__, rest))
                return self._plain(first) + words if first else words
            except _NotAWord:
                pass
        return self._plain(text)

    def count(self, text: str) -> int:
        """How many ids the text has; only the numbers are cached."""
        first, *rest = text.split(" ")
        if not first or not first[-1].isspace():
            try:
                words = sum(map(self._sizes.__getitem__, rest))
                return self._size(first) + words if first else words
            except _NotAWord:
                pass
        return self._size(text)


class _NotAWord(Exception):
    pass


class _Words(dict):
    """Word to what ``make`` gives for the word with a space before it; bounded."""

    def __init__(self, make):
        self._make = make

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise _NotAWord
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self._make(" " + word)
        if len(word) <= 64:
            self[word] = out
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """One encoder for each Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]

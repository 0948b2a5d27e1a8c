"""Tokens of whole texts by the public vocabularies: ids as bytes, and exact spans of each token."""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache

import numpy as np

from .store import Kept

#: Runs kept by a worker, and the longest run kept.
KEPT, LONGEST = 400_000, 64


#: Below this, letters are the same to every Unicode version and change case one by one.
LATIN_END = "\u0250"


def _latin(text: str) -> bool:
    return text.isalpha() and max(text) < LATIN_END


class _Ids(Kept):
    """Ids of runs of characters other than white space; unknown ones are encoded when they are asked for.

    A run of Latin letters is one word to the vocabulary's splitter, so its model can be asked directly; a stop or
    comma after one is a word of its own. All other runs take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        own = Tokenizer.from_file(path)
        self._encode, self._word = own.encode, own.model.tokenize
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._bytes = {c: split(chr(c))[0][0] for c in range(0x41, 0x250) if chr(c).isalpha()}

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if len(run) <= LONGEST and run[-1:] in (b".", b",") and _latin(text[:-1] or "."):
            ids = self[run[:-1]] + self[run[-1:]]
        elif _latin(text) and _latin(low := text.lower()) and unicodedata.is_normalized("NFC", text):
            ids = np.array([t.id for t in self._word(low.translate(self._bytes))], "<u4").tobytes()
        else:
            ids = np.array(self._encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(run) <= LONGEST:
            self[run] = ids
        return ids


@lru_cache(2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def id_bytes(path: str, text: bytes) -> bytes:
    """Ids of the text as unsigned 32-bit little-endian integers, without special tokens.

    The vocabulary drops white space and never joins across it, so each run of other characters has the same ids
    wherever it stands; a worker keeps those of short runs.
    """
    known = _ids(path).ready(KEPT)
    return b"".join(map(known.__getitem__, text.split()))


@lru_cache(2)
def byte_encoder(path: str):
    """(encoder, bytes of each id) of a byte-level vocabulary given as ranks; no text counts as special."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, number in ranks.items():
        size[number] = len(token)
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoder, size

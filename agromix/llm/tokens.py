"""Token identifiers of whole texts with the public byte-level BPE of about 50,000 entries.

The tables are read from the tokenizers' folder given by ``TOKENIZERS`` in the environment of the caller or the
installed ``public_tokenizers``; nothing is copied. The rank file holds the same vocabulary as byte_bpe_50k.json.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

__all__ = ["ADDED", "END_OF_TEXT", "SEPARATOR", "encode_bytes", "rank_file"]

#: The identifier of the added token, which a text yields only where it holds its literal.
END_OF_TEXT = 50256
ADDED = "<|endoftext|>"
#: Above the vocabulary, within 16 bits: no text yields it.
SEPARATOR = 65535
#: Bound on memorised words, for each Python worker.
MEMO = 400_000


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Memo(dict):
    """Identifiers of a word with the blank before it, as little-endian 32-bit integers."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encoding.encode_ordinary(" " + word), dtype="<u4").tobytes()
        if len(self) < MEMO and len(word) < 64:
            self[word] = out
        return out


@lru_cache(maxsize=2)
def _tables(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, _Memo(encoding), re.compile(r"\s\s|\s\Z")


def encode_bytes(text: str, path: str, added: bool = True) -> bytes:
    """The text's identifiers as little-endian unsigned 32-bit integers.

    As in the library, the added token's literal is one identifier and parts what stands before and after it; without
    ``added`` it is spelled in pieces like any other text.

    The pattern that splits texts before merging always parts a word from what precedes the blank before it, as long as
    no two white-space characters touch. Such texts are cut at blanks and each word is looked up; others go whole.
    """
    if added and ADDED in text:
        return END_OF_TEXT.to_bytes(4, "little").join(encode_bytes(x, path) for x in text.split(ADDED))
    encoding, memo, touching = _tables(path)
    if not text or touching.search(text) or text[0].isspace():
        return np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()
    first, _, rest = text.partition(" ")
    head = np.array(encoding.encode_ordinary(first), dtype="<u4").tobytes()
    return head + b"".join(map(memo.__getitem__, rest.split(" "))) if rest else head
